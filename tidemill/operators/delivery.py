"""Messages that were delivered at least once: exactly one copy of each is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nulls_last(*cols: str) -> Column:
    """A struct that sorts by cols with NULL after every value."""
    return F.struct(*[x for c in cols for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c))])


def kept_copies(df: DataFrame, identifier: list[Column], order: list[str], copy_id: str) -> DataFrame:
    """One row (kept_id, copies) per message: the copy_id of the copy that comes first by `order`.

    A hash aggregation by the identifier with min_by over a struct of delivery time and tie-breaks: each task
    first reduces its own rows to one per message, so a message with a third of all rows moves as one row per task.
    The identifier is shuffled as two 64-bit hashes (128 bits) in place of its texts.
    NULL parts of the identifier equal each other; NULL order columns come last; copy_id breaks what ties remain.
    An empty table gives no rows; other columns of df are not read.
    """
    # A field marker before each part keeps ('a', NULL) and (NULL, 'a') apart: xxhash64 skips NULL.
    parts = [x for c in identifier for x in (c.isNull(), c)]
    keyed = df.select(
        F.xxhash64(F.lit(1), *parts).alias("_h1"), F.xxhash64(F.lit(2), *parts).alias("_h2"), F.col(copy_id).alias("_copy"), nulls_last(*order, copy_id).alias("_at")
    )
    best = keyed.groupBy("_h1", "_h2").agg(F.min_by("_copy", "_at").alias("kept_id"), F.count("*").alias("copies"))
    return best.select("kept_id", "copies")


def deliver_once(df: DataFrame, identifier: list[Column], order: list[str], copy_id: str) -> DataFrame:
    """The rows of df that are kept, all columns unchanged. copy_id must be unique and not NULL."""
    kept = kept_copies(df, identifier, order, copy_id).select(F.col("kept_id").alias("_kept_id"))
    return df.join(kept, df[copy_id] == kept["_kept_id"], "left_semi")


def surplus_copies(df: DataFrame, identifier: list[Column], order: list[str], copy_id: str) -> DataFrame:
    """The rows of df that must go. The join is by the unique copy_id, so no key of it is hot."""
    kept = kept_copies(df, identifier, order, copy_id).select(F.col("kept_id").alias("_kept_id"))
    return df.join(kept, df[copy_id] == kept["_kept_id"], "left_anti")


def historical_plays(bronze: DataFrame) -> DataFrame:
    """Plays that ended: with a time, and not now playing. A NULL is_now_playing counts as played."""
    return bronze.filter(F.col("scrobbled_at_uts").isNotNull() & ~F.coalesce(F.col("is_now_playing"), F.lit(False)))


def play_identifier() -> list[Column]:
    """What makes two rows of bronze_scrobbles the same play: outer blanks and letter case ignored, blank album = none."""
    same = lambda c: F.lower(F.trim(F.col(c)))
    return [F.col("user_name"), F.col("scrobbled_at_uts"), same("artist"), same("track"), F.coalesce(same("album"), F.lit(""))]


PLAY_ORDER = ["ingested_at", "run_id", "source_page", "source_position"]
