"""Joins whose hot keys don't end up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is hot.
HOT_ROWS = 200_000
#: Most keys that are broadcast, the hottest first. A key that isn't among so many holds at most one row in MOST_SENT of all.
MOST_SENT = 10_000


def join_by_size(facts: DataFrame, keyed: DataFrame, key: str, size: str, hot_rows: int = HOT_ROWS, most_sent: int = MOST_SENT) -> DataFrame:
    """facts inner-joined with keyed, which has one row per key and in `size` the number of rows of facts with that key.

    Hot keys, but no more than most_sent of them, are broadcast, so their rows stay where they are; all other keys are shuffled.
    What is sent is thus bounded whatever the data, and a key left to the shuffle has hot_rows rows or one in most_sent of all rows at most.
    The result is the same for any hot_rows and most_sent. NULL keys match nothing.
    """
    ranked = keyed.filter(F.col(size) > hot_rows).orderBy(F.desc(size), key).limit(most_sent)
    hot = F.broadcast(ranked.select(key))
    cold = keyed.join(hot, key, "left_anti").drop(size)
    return facts.join(F.broadcast(ranked.drop(size)), key).unionByName(facts.join(hot, key, "left_anti").join(cold, key))


def without_keys(facts: DataFrame, keyed: DataFrame, key: str, size: str, most_sent: int = MOST_SENT) -> DataFrame:
    """facts without the keys of keyed, which has one row per key and in `size` its number of rows of facts: the most_sent hottest by broadcast, the others by a shuffle."""
    hot = F.broadcast(keyed.orderBy(F.desc(size), key).limit(most_sent).select(key))
    return facts.join(hot, key, "left_anti").join(keyed.join(hot, key, "left_anti").select(key), key, "left_anti")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """df over all cores, by hash of cols: for small inputs that a few file blocks hold but costly steps follow."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *cols)


def spread_few(df: DataFrame, *cols: str) -> DataFrame:
    """spread(df) only where its scan has fewer parts than there are cores; a large table is left where it lies.

    The number of parts is asked of the plan on the driver; no row is read for it. It changes where rows lie, never the result.
    """
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return spread(df, *cols) if few else df
