"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: What the operators assume of any session. Partition counts follow the data through AQE.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", name: str = "tidemill", **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf overrides them (dots written as they are, through a dict)."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session (tests) may leave it unset and gets a temporary one; a cluster can't read a folder of one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir isn't set: a cluster needs a shared folder for cut lineage and streams")
    return tempfile.mkdtemp(prefix="tidemill-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder for checkpoints unless one is set already."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the files of shuffles and checkpoints that nothing refers to any more cleared now.

    Spark clears them only once the driver happens to collect its garbage, so a query of many steps would hold the files of all of them until its end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
