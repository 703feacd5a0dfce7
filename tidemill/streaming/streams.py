"""Structured Streaming counterparts: deduplication with overlap, sessions and daily counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.delivery import play_identifier
from tidemill.session import shared_folder


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files with the schema of `like`; plain times become instants, which watermarks need."""
    raw = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumns({f.name: F.col(f.name).cast("timestamp") for f in like.schema if f.dataType.typeName() == "timestamp_ntz"})


def plays_delivered_once(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Plays of overlapping fetches, each let through once: T02, T03, T06.

    The state holds one row per play for as long as copies may be late, then lets it go; it is keyed, so it spreads over all tasks. Plays further behind the
    latest one than `lateness` are late for good and are dropped: give a longer time to a stream that is replayed out of order.
    """
    ended = stream.filter(F.col("scrobbled_at_uts").isNotNull() & ~F.coalesce(F.col("is_now_playing"), F.lit(False)))
    # As structs with nothing joined, no two plays have the same key: ('a|b', 'c') isn't ('a', 'b|c'), and NULL isn't blank.
    parts = [x for c in play_identifier() for x in (c.isNull(), c)]
    keyed = ended.withColumns({"at": F.timestamp_seconds("scrobbled_at_uts"), "play_key": F.struct(F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts))})
    return keyed.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["play_key"])


def user_sessions(stream: DataFrame, user: str, at: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of each user; one is given out once the watermark has passed its end: T05.

    session_window ends a session `gap` after its last event, and merges events exactly `gap` apart, as the batch operator does.
    """
    windowed = stream.withWatermark(at, lateness).groupBy(F.session_window(at, gap).alias("w"), user)
    return windowed.agg(F.count("*").alias("event_count"), F.min(at).alias("session_start"), F.max(at).alias("session_end")).select(user, "event_count", "session_start", "session_end")


def daily_counts(stream: DataFrame, at: str, key: str, value: str, lateness: str = "1 hour") -> DataFrame:
    """Tumbling days: T08."""
    days = stream.withWatermark(at, lateness).groupBy(F.window(at, "1 day").alias("w"), key)
    return days.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").cast("date").alias("day"), key, "n", "total")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet in the shared folder, and read the result: T01, T04.

    Offsets and state live in a checkpoint beside it; files of a batch become visible only when it is committed.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def high_water_mark(rows: DataFrame, at: str, before: int | None = None, overlap_seconds: int = 300) -> tuple[int | None, int]:
    """(new mark, where the next fetch begins): the mark never falls, and the next fetch overlaps it: T01, S16."""
    latest = rows.agg(F.max(at)).first()[0]
    mark = max([x for x in (latest, before) if x is not None], default=None)
    return mark, max(0, (mark or 0) - overlap_seconds)


def run_available_complete(stream: DataFrame) -> DataFrame:
    """As run_available for aggregates that should show open windows too: the last complete result, written once per batch.

    Each batch overwrites the folder, so the result is that of the last one; it holds windows, not events.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
