"""Tags resolved to genres by a cascade of exact, aliased, compact and accent-free keys, and classified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import accent_key, compact_key, tag_key

# Tags that name a year or a decade.
ERA = r"^((19|20)\d{2}s?|\d{2}s)$"


def _unique(genres: DataFrame, key) -> DataFrame:
    """Genres by a key that only one of them has."""
    return genres.groupBy(key(F.col("genre")).alias("k")).agg(F.count("*").alias("n"), F.min("genre").alias("g")).filter("n = 1 AND k IS NOT NULL").select("k", "g")


def resolve_tags(tags: DataFrame, genres: DataFrame, aliases: DataFrame) -> DataFrame:
    """(tag_norm, canonical_genre, method) of distinct tags.tag: the vocabulary itself, an alias, a compact key, an accent-free key, else unresolved.

    genres: genre, normalized and distinct; aliases: tag_norm, canonical_genre. A key that several genres share resolves nothing. An alias to something that is no
    genre is ignored. The lists are vocabularies; tags are made distinct first. NULL and blank tags are left out.
    """
    t = tags.select(tag_key(F.col("tag")).alias("tag_norm")).filter(F.col("tag_norm").isNotNull()).distinct().withColumns({"ck": compact_key(F.col("tag_norm")), "ak": accent_key(F.col("tag_norm"))})
    steps = {
        "exact": (genres.select(F.col("genre").alias("k"), F.col("genre").alias("exact")), "tag_norm"),
        "manual_alias": (aliases.join(genres, F.col("canonical_genre") == F.col("genre"), "left_semi").select(F.col("tag_norm").alias("k"), F.col("canonical_genre").alias("manual_alias")), "tag_norm"),
        "compact_alias": (_unique(genres, compact_key).withColumnRenamed("g", "compact_alias"), "ck"),
        "accent_alias": (_unique(genres, accent_key).withColumnRenamed("g", "accent_alias"), "ak"),
    }
    for name, (table, key) in steps.items():
        t = t.join(table.withColumnRenamed("k", f"_{name}"), F.col(key) == F.col(f"_{name}"), "left").drop(f"_{name}")
    method = F.coalesce(*[F.when(F.col(n).isNotNull(), n) for n in steps], F.lit("unresolved"))
    return t.select("tag_norm", F.coalesce(*steps).alias("canonical_genre"), method.alias("method"))


def classify_tags(resolved: DataFrame, curated: DataFrame) -> DataFrame:
    """(tag_norm, tag_type, canonical_genre, classification_method): a genre, else as curated, else an era, else unknown.

    curated: tag_norm, tag_type, canonical_genre.
    """
    listed = curated.select("tag_norm", F.col("tag_type").alias("_type"), F.col("canonical_genre").alias("_genre"))
    joined = resolved.join(listed, "tag_norm", "left")
    genre, known, era = F.col("canonical_genre").isNotNull(), F.col("_type").isNotNull(), F.col("tag_norm").rlike(ERA)
    return joined.select(
        "tag_norm",
        F.when(genre, "genre").when(known, F.col("_type")).when(era, "era").otherwise("unknown").alias("tag_type"),
        F.coalesce("canonical_genre", F.when(known, F.col("_genre"))).alias("canonical_genre"),
        F.when(genre, F.col("method")).when(known, "curated").when(era, "era_rule").otherwise("unresolved").alias("classification_method"),
    )
