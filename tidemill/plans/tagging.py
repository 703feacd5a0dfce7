"""Queries of tag resolution and classification, and of seeded generators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import synthetic as Z
from tidemill.operators import taxonomy as X
from tidemill.plans.registry import Registry
from tidemill.sources.tables import Tables

R = Registry()

_CK = lambda c: f"nullif(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"
_AK = lambda c: _CK(f"strip_accents(lower({c}))")
_RESOLVED = f"""WITH tags AS (SELECT DISTINCT nullif(regexp_replace(lower(trim(tag_norm)), '\\s+', ' ', 'g'), '') AS tag_norm FROM dim_tag_taxonomy),
genres AS (SELECT DISTINCT nullif(regexp_replace(lower(trim(canonical_genre)), '\\s+', ' ', 'g'), '') AS genre FROM ref_genre),
compact AS (SELECT {_CK('genre')} AS k, min(genre) AS g FROM genres GROUP BY 1 HAVING count(*) = 1), accent AS (SELECT {_AK('genre')} AS k, min(genre) AS g FROM genres GROUP BY 1 HAVING count(*) = 1),
joined AS (SELECT tag_norm, e.genre AS e, c.g AS c, a.g AS a FROM tags LEFT JOIN genres e ON tag_norm = e.genre LEFT JOIN compact c ON {_CK('tag_norm')} = c.k LEFT JOIN accent a ON {_AK('tag_norm')} = a.k WHERE tag_norm IS NOT NULL),
resolved AS (SELECT tag_norm, coalesce(e, c, a) AS canonical_genre, CASE WHEN e IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'compact_alias' WHEN a IS NOT NULL THEN 'accent_alias' ELSE 'unresolved' END AS method FROM joined)"""


def _resolved(t: Tables) -> DataFrame:
    genres = t.ref_genre.select(X.tag_key(F.col("canonical_genre")).alias("genre")).filter("genre IS NOT NULL").distinct()
    none = t.spark.createDataFrame([], "tag_norm string, canonical_genre string")
    return X.resolve_tags(t.dim_tag_taxonomy.select(F.col("tag_norm").alias("tag")), genres, none)


@R.query("tag_resolution", f"{_RESOLVED} SELECT * FROM resolved")
def tag_resolution(t: Tables) -> DataFrame:
    """G19."""
    return _resolved(t)


@R.query("tag_classification", f"""{_RESOLVED}, curated AS (SELECT tag_norm, tag_type AS ty, canonical_genre AS cg FROM dim_tag_taxonomy WHERE classification_method = 'curated')
SELECT tag_norm, CASE WHEN canonical_genre IS NOT NULL THEN 'genre' WHEN ty IS NOT NULL THEN ty WHEN regexp_matches(tag_norm, '^((19|20)[0-9]{{2}}s?|[0-9]{{2}}s)$') THEN 'era' ELSE 'unknown' END AS tag_type, coalesce(canonical_genre, cg) AS canonical_genre,
    CASE WHEN canonical_genre IS NOT NULL THEN method WHEN ty IS NOT NULL THEN 'curated' WHEN regexp_matches(tag_norm, '^((19|20)[0-9]{{2}}s?|[0-9]{{2}}s)$') THEN 'era_rule' ELSE 'unresolved' END AS classification_method FROM resolved LEFT JOIN curated USING (tag_norm)""")  # fmt: skip
def tag_classification(t: Tables) -> DataFrame:
    """G20."""
    return X.classify_tags(_resolved(t), t.dim_tag_taxonomy.filter("classification_method = 'curated'"))


@R.query("synthetic_manifest")
def synthetic_manifest(t: Tables) -> DataFrame:
    """Counts over generated customers, leads, damage and spend."""
    people = Z.customers(t.spark, 2000)
    lead_rows = Z.leads(people, "2025-01-01", 500)
    damaged, log = Z.corrupted(lead_rows, "lead_id", {"name": 0.1, "email": 0.2, "phone": 0.3, "zip_code": 0.05})
    money = Z.spend(lead_rows, "2025-01-01", 500)
    count = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    return count(people, "customers").unionByName(count(damaged, "leads")).unionByName(count(log, "changes")).unionByName(count(money, "spend_rows"))
