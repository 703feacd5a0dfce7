"""Queries of the listening warehouse over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.dates import month_start
from tidemill.functions.maths import rounded
from tidemill.operators import warehouse as W
from tidemill.plans import adapters as A
from tidemill.plans.registry import Registry
from tidemill.sources.tables import Tables

R = Registry()

_STAGED = """
WITH placed AS (
    SELECT *, lower(trim(artist)) AS artist_norm, lower(trim(track)) AS track_norm, lower(nullif(trim(album), '')) AS album_norm, row_number() OVER (
        PARTITION BY user_name, scrobbled_at_uts, lower(trim(artist)), lower(trim(track)), coalesce(lower(nullif(trim(album), '')), '')
        ORDER BY ingested_at, run_id, source_page, source_position, observation_id) AS copy_rank
    FROM bronze_scrobbles WHERE scrobbled_at_uts IS NOT NULL AND NOT coalesce(is_now_playing, false)),
staged AS (
    SELECT md5(concat_ws('|', CAST(scrobbled_at_uts AS VARCHAR), artist_norm, track_norm, coalesce(album_norm, ''))) AS scrobble_id, user_name, trim(artist) AS artist, trim(track) AS track, nullif(trim(album), '') AS album,
        artist_norm, track_norm, album_norm, nullif(trim(artist_mbid), '') AS artist_mbid, nullif(trim(track_mbid), '') AS track_mbid, nullif(trim(album_mbid), '') AS album_mbid, scrobbled_at, scrobbled_at_uts, run_id, run_id AS source_run_id, track_url, source_page, source_position, source_file, ingested_at
    FROM placed WHERE copy_rank = 1)
"""
_US = lambda *names: ", ".join(f"epoch_us({n}) AS {n}" for n in names)


def _micros(df: DataFrame, *names: str) -> DataFrame:
    """Instants as microseconds since 1970, which every engine prints alike."""
    return df.withColumns({n: F.unix_micros(F.col(n).cast("timestamp")) for n in names})


def _six(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six digits: sums of doubles depend on their order beyond that."""
    return df.withColumns({n: rounded(F.col(n)) for n in names})


def _sql6(*names: str) -> str:
    return ", ".join(f"floor({n} * 1e6 + 0.5) / 1e6 AS {n}" for n in names)


_STG = ["scrobble_id", "user_name", "artist", "track", "album", "artist_norm", "track_norm", "album_norm", "artist_mbid", "track_mbid", "album_mbid", "scrobbled_at_uts", "source_run_id", "track_url", "source_page", "source_position", "source_file", "scrobbled_at", "ingested_at"]


@R.query("stg_scrobbles", _STAGED + f"SELECT * REPLACE ({_US('scrobbled_at', 'ingested_at')}) FROM (SELECT {', '.join(_STG)} FROM staged)")
def stg_scrobbles(t: Tables) -> DataFrame:
    """Q01."""
    return _micros(W.stage_plays(t.bronze_scrobbles).select(*_STG), "scrobbled_at", "ingested_at")


@R.query("staged_play_keys", _STAGED + "SELECT count(*) AS plays, count(*) AS play_ids, count(DISTINCT scrobble_id) AS scrobble_ids FROM staged")
def staged_play_keys(t: Tables) -> DataFrame:
    """Q01: every play has a play_id of its own."""
    return W.stage_plays(t.bronze_scrobbles).agg(F.count("*").alias("plays"), F.count_distinct("play_id").alias("play_ids"), F.count_distinct("scrobble_id").alias("scrobble_ids"))


_DIM = lambda keys, name, mbid, more="": f"arg_max({name}, (scrobbled_at_uts, {name})) FILTER ({name} IS NOT NULL) AS {name}_name, max({mbid}) AS {mbid}, epoch_us(min(scrobbled_at)) AS first_scrobble_at, epoch_us(max(scrobbled_at)) AS latest_scrobble_at, count(*) AS scrobble_count{more} FROM staged"


@R.query("dim_artist", _STAGED + f"SELECT md5(artist_norm) AS artist_id, artist_norm, {_DIM('', 'artist', 'artist_mbid')} GROUP BY artist_norm")
def dim_artist(t: Tables) -> DataFrame:
    """Q02."""
    return _micros(W.dim_artist(W.stage_plays(t.bronze_scrobbles)), "first_scrobble_at", "latest_scrobble_at")


@R.query("dim_album_built", _STAGED + f"SELECT md5(concat_ws('|', artist_norm, album_norm)) AS album_id, md5(artist_norm) AS artist_id, artist_norm, album_norm, {_DIM('', 'album', 'album_mbid')} WHERE album_norm IS NOT NULL GROUP BY artist_norm, album_norm")
def dim_album_built(t: Tables) -> DataFrame:
    """Q03."""
    return _micros(W.dim_album(W.stage_plays(t.bronze_scrobbles)), "first_scrobble_at", "latest_scrobble_at")


@R.query("dim_track_built", _STAGED + f"SELECT md5(concat_ws('|', artist_norm, track_norm)) AS track_id, md5(artist_norm) AS artist_id, artist_norm, track_norm, {_DIM('', 'track', 'track_mbid', ', count(DISTINCT album_norm) AS album_count')} GROUP BY artist_norm, track_norm")
def dim_track_built(t: Tables) -> DataFrame:
    """Q04."""
    return _micros(W.dim_track(W.stage_plays(t.bronze_scrobbles)), "first_scrobble_at", "latest_scrobble_at")


_FACT = _STAGED + """, fact AS (SELECT *, timezone('America/Sao_Paulo', scrobbled_at) AS wall FROM staged)
SELECT scrobble_id, user_name, md5(artist_norm) AS artist_id, md5(concat_ws('|', artist_norm, track_norm)) AS track_id, CASE WHEN album_norm IS NOT NULL THEN md5(concat_ws('|', artist_norm, album_norm)) END AS album_id,
    epoch_us(wall) AS scrobbled_at_local, CAST(wall AS DATE) AS listening_date, CAST(year(wall) AS INTEGER) AS listening_year, CAST(month(wall) AS INTEGER) AS listening_month, CAST(hour(wall) AS INTEGER) AS listening_hour,
    CAST(isodow(wall) AS INTEGER) AS weekday_iso, dayname(wall) AS weekday_name FROM fact"""


@R.query("fact_scrobble_built", _FACT, dates=("listening_date",))
def fact_scrobble_built(t: Tables) -> DataFrame:
    """Q07."""
    fact = W.fact_plays(W.stage_plays(t.bronze_scrobbles))
    return _micros(fact, "scrobbled_at_local").select("scrobble_id", "user_name", "artist_id", "track_id", "album_id", "scrobbled_at_local", "listening_date", "listening_year", "listening_month", "listening_hour", "weekday_iso", "weekday_name")


@R.query("build_metrics", _STAGED + """SELECT *, historical_rows - unique_plays AS removed_copies FROM (
    SELECT count(*) AS bronze_rows, count(*) FILTER (coalesce(is_now_playing, false)) AS now_playing_rows, count(*) FILTER (NOT coalesce(is_now_playing, false) AND scrobbled_at_uts IS NOT NULL) AS historical_rows, count(DISTINCT run_id) AS runs FROM bronze_scrobbles),
    (SELECT count(*) AS unique_plays FROM staged)""")  # fmt: skip
def build_metrics(t: Tables) -> DataFrame:
    """K09."""
    return W.build_metrics(t.bronze_scrobbles, W.stage_plays(t.bronze_scrobbles))


@R.query("star_orphans", "SELECT kind, count(DISTINCT id) AS orphans FROM (SELECT 'track' AS kind, track_id AS id FROM fact_scrobble WHERE track_id NOT IN (SELECT track_id FROM dim_track) UNION ALL SELECT 'album', album_id FROM fact_scrobble WHERE album_id IS NOT NULL AND album_id NOT IN (SELECT album_id FROM dim_album) UNION ALL SELECT 'none', NULL) GROUP BY kind")
def star_orphans(t: Tables) -> DataFrame:
    """A row for each kind with orphans, and one that is always there."""
    tracks = W.orphans(t.fact_scrobble, t.dim_track, "track_id").select(F.lit("track").alias("kind"), F.col("track_id").alias("id"))
    albums = W.orphans(t.fact_scrobble, t.dim_album, "album_id").select(F.lit("album").alias("kind"), F.col("album_id").alias("id"))
    always = t.spark.createDataFrame([("none", None)], "kind string, id string")
    return tracks.union(albums).union(always).groupBy("kind").agg(F.count("id").alias("orphans"))


_PLAYS = f"WITH RECURSIVE {A.PLAYS_SQL}"


@R.query("daily_listening", f"{_PLAYS} SELECT listening_date, count(*) AS scrobble_count, count(DISTINCT artist_id) AS distinct_artists, count(DISTINCT track_id) AS distinct_tracks, count(DISTINCT album_id) AS distinct_albums, count(DISTINCT listening_hour) AS active_hours, epoch_us(min(scrobbled_at_local)) AS first_scrobble_at_local, epoch_us(max(scrobbled_at_local)) AS latest_scrobble_at_local FROM plays GROUP BY listening_date", dates=("listening_date",))
def daily_listening(t: Tables) -> DataFrame:
    """Q08."""
    return _micros(W.daily_listening(A.plays(t)), "first_scrobble_at_local", "latest_scrobble_at_local")


@R.query("artist_summary", f"""{_PLAYS} SELECT artist_id, artist_name, count(*) AS scrobble_count, count(DISTINCT track_id) AS distinct_tracks, count(DISTINCT album_id) AS distinct_albums, count(DISTINCT listening_date) AS active_days,
    count(DISTINCT date_trunc('month', listening_date)) AS active_months, epoch_us(min(scrobbled_at_local)) AS first_scrobble_at_local, epoch_us(max(scrobbled_at_local)) AS latest_scrobble_at_local,
    date_diff('day', CAST(max(scrobbled_at_local) AS DATE), (SELECT max(listening_date) FROM plays)) AS days_since_last_scrobble, floor(100.0::DOUBLE * (count(*)::DOUBLE / (SELECT count(*) FROM plays)) * 1e4 + 0.5) / 1e4 AS scrobble_share_pct
    FROM plays JOIN artists USING (artist_id) GROUP BY artist_id, artist_name""")  # fmt: skip
def artist_summary(t: Tables) -> DataFrame:
    """Q09."""
    return _micros(W.artist_summary(A.plays(t), A.artists(t)), "first_scrobble_at_local", "latest_scrobble_at_local")


_HOURS = lambda keys, part, share: f"""{_PLAYS}, seasoned AS (SELECT *, CAST(date_trunc('month', listening_date) AS DATE) AS month_start, CAST(year(listening_date) + (month(listening_date) = 12)::INTEGER AS INTEGER) AS season_year, CAST((month(listening_date) % 12) // 3 + 1 AS INTEGER) AS season_order FROM plays),
hours AS (SELECT {keys} weekday_iso, weekday_name, listening_hour, count(*) AS scrobble_count, count(DISTINCT listening_date) AS active_days FROM seasoned GROUP BY ALL)
SELECT *, floor(scrobble_count::DOUBLE / active_days * 100 + 0.5) / 100 AS avg_scrobbles_per_active_day, floor(100.0::DOUBLE * (scrobble_count::DOUBLE / (sum(scrobble_count) OVER ({part}))::DOUBLE) * 1e4 + 0.5) / 1e4 AS {share} FROM hours"""  # noqa: E731


@R.query("listening_by_hour", _HOURS("", "", "scrobble_share_pct"))
def listening_by_hour(t: Tables) -> DataFrame:
    """Q10."""
    return W.by_hour(A.plays(t), [], [], "scrobble_share_pct")


@R.query("hour_by_month", _HOURS("month_start, season_year, season_order, ", "PARTITION BY month_start", "scrobble_share_within_month_pct"), dates=("month_start",))
def hour_by_month(t: Tables) -> DataFrame:
    """Q19."""
    return W.by_hour(W.with_season(A.plays(t)), ["month_start", "season_year", "season_order"], ["month_start"], "scrobble_share_within_month_pct")


_DISCOVERY = f"""{_PLAYS}, monthly AS (SELECT CAST(date_trunc('month', listening_date) AS DATE) AS month_start, artist_id, count(*) AS n FROM plays GROUP BY ALL),
firsts AS (SELECT artist_id, min(month_start) AS first_month FROM monthly GROUP BY artist_id),
summed AS (SELECT month_start, CAST(sum(n) AS BIGINT) AS scrobble_count, count(*) AS active_artists, count(*) FILTER (first_month = month_start) AS new_artists, CAST(coalesce(sum(n) FILTER (first_month = month_start), 0) AS BIGINT) AS new_artist_scrobbles FROM monthly JOIN firsts USING (artist_id) GROUP BY month_start),
discovery AS (SELECT *, active_artists - new_artists AS returning_artists, CAST(sum(new_artists) OVER (ORDER BY month_start ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_artists,
    floor(100.0::DOUBLE * (new_artists::DOUBLE / active_artists) * 100 + 0.5) / 100 AS discovery_rate_pct, floor(100.0::DOUBLE * (new_artist_scrobbles::DOUBLE / scrobble_count) * 100 + 0.5) / 100 AS new_artist_scrobble_share_pct FROM summed)"""


@R.query("monthly_discovery", _DISCOVERY + " SELECT * FROM discovery", dates=("month_start",))
def monthly_discovery(t: Tables) -> DataFrame:
    """Q11."""
    return W.monthly_discovery(A.plays(t))


_TAGS = f"{_PLAYS}, {A.TAGS_SQL}"


def evidence(t: Tables) -> DataFrame:
    """Tags of the albums of the test tables."""
    return W.tag_evidence(t.dim_album.select("album_id", "artist_id").distinct(), A.album_tags(t), A.artist_tags(t))


def weights(t: Tables) -> DataFrame:
    """Genre weights of the albums of the test tables."""
    return W.genre_weights(evidence(t), A.genres(t))


@R.query("album_tag_evidence", f"{_TAGS} SELECT album_id, artist_id, CAST(tag_rank AS INTEGER) AS tag_rank, tag_norm, tag_weight, tag_source FROM evidence")
def album_tag_evidence(t: Tables) -> DataFrame:
    """Q05."""
    return evidence(t)


@R.query("album_genre_weight", f"{_TAGS} SELECT album_id, artist_id, canonical_genre, tag_source, genre_weight_raw, {_sql6('genre_weight')}, source_tag_count, genre_rank FROM weights")
def album_genre_weight(t: Tables) -> DataFrame:
    """Q06."""
    return _six(weights(t), "genre_weight").select("album_id", "artist_id", "canonical_genre", "tag_source", "genre_weight_raw", "genre_weight", "source_tag_count", "genre_rank")


_GENRE = lambda period, name: f"""{_TAGS}, timed AS (SELECT *, {period} AS {name}_ FROM plays),
whole AS (SELECT {name}_, count(*) AS total_scrobbles, count(album_id) AS scrobbles_with_album, count(DISTINCT listening_date) AS active_days FROM timed GROUP BY 1),
covered AS (SELECT {name}_, count(*) AS genre_covered_scrobbles FROM timed WHERE album_id IN (SELECT album_id FROM weights) GROUP BY 1),
genre AS (SELECT {name}_, canonical_genre, sum(genre_weight) AS weighted_scrobbles, count(DISTINCT album_id) AS active_albums, count(DISTINCT w.artist_id) AS active_artists FROM timed JOIN weights w USING (album_id) GROUP BY ALL),
genre_periods AS (SELECT *, weighted_scrobbles / sum(weighted_scrobbles) OVER (PARTITION BY {name}_) AS genre_share, genre_covered_scrobbles::DOUBLE / total_scrobbles AS genre_coverage FROM genre JOIN covered USING ({name}_) JOIN whole USING ({name}_))"""  # noqa: E731
_GENRE_OUT = f"canonical_genre, {_sql6('weighted_scrobbles', 'genre_share', 'genre_coverage')}, active_albums, active_artists, genre_covered_scrobbles, total_scrobbles, scrobbles_with_album, active_days FROM genre_periods"


def genre_months(t: Tables) -> DataFrame:
    """Genres by month."""
    return W.genre_by(A.written_plays(t), weights(t), month_start(F.col("listening_date")), "month_start")


@R.query("genre_yearly", _GENRE("CAST(listening_year AS INTEGER)", "listening_year") + f" SELECT listening_year_ AS listening_year, {_GENRE_OUT}")
def genre_yearly(t: Tables) -> DataFrame:
    """Q13."""
    return _six(W.genre_by(A.written_plays(t), weights(t), F.col("listening_year"), "listening_year"), "weighted_scrobbles", "genre_share", "genre_coverage")


@R.query("genre_monthly", _GENRE("CAST(date_trunc('month', listening_date) AS DATE)", "month") + f" SELECT month_ AS month_start, {_GENRE_OUT}", dates=("month_start",))
def genre_monthly(t: Tables) -> DataFrame:
    """Q14."""
    return _six(genre_months(t), "weighted_scrobbles", "genre_share", "genre_coverage")


_SEASONALITY = _GENRE("CAST(date_trunc('month', listening_date) AS DATE)", "month") + """,
months AS (SELECT DISTINCT month_, CASE WHEN month(month_) = 12 THEN year(month_) + 1 ELSE year(month_) END AS season_year, CAST((month(month_) % 12) // 3 + 1 AS INTEGER) AS season_order, genre_covered_scrobbles, active_days, genre_coverage
    FROM genre_periods WHERE month_ < (SELECT CAST(date_trunc('month', max(listening_date)) AS DATE) FROM plays)),
grid AS (SELECT m.*, g.canonical_genre, coalesce(p.weighted_scrobbles, 0) AS weighted_scrobbles, coalesce(p.genre_share, 0) AS genre_share FROM months m CROSS JOIN (SELECT DISTINCT canonical_genre FROM weights) g LEFT JOIN genre_periods p ON p.month_ = m.month_ AND p.canonical_genre = g.canonical_genre),
base AS (SELECT canonical_genre, avg(genre_share) AS b FROM grid GROUP BY 1),
seasons AS (SELECT canonical_genre, season_order, count(*) AS observed_months, count(DISTINCT season_year) AS observed_years, CAST(sum(active_days) AS BIGINT) AS total_active_days, avg(genre_coverage) AS mean_genre_coverage, avg(genre_share) AS mean_monthly_genre_share,
    sum(weighted_scrobbles) AS weighted_scrobbles, sum(weighted_scrobbles) / nullif(sum(genre_covered_scrobbles), 0)::DOUBLE AS volume_weighted_genre_share FROM grid GROUP BY ALL),
seasonality AS (SELECT s.*, mean_monthly_genre_share / nullif(b, 0) AS seasonality_index FROM seasons s JOIN base USING (canonical_genre))"""
_SEASON_FLOATS = ["mean_genre_coverage", "mean_monthly_genre_share", "weighted_scrobbles", "volume_weighted_genre_share", "seasonality_index"]


def seasonality(t: Tables) -> DataFrame:
    """Seasonal shares of genres."""
    latest = A.written_plays(t).agg(month_start(F.max("listening_date")).alias("latest"))
    return W.genre_seasonality(genre_months(t), weights(t), latest)


@R.query("genre_seasonality", _SEASONALITY + f" SELECT canonical_genre, season_order, ['Summer', 'Autumn', 'Winter', 'Spring'][season_order] AS season_name, observed_months, observed_years, total_active_days, {_sql6(*_SEASON_FLOATS)} FROM seasonality")
def genre_seasonality(t: Tables) -> DataFrame:
    """Q15."""
    return _six(seasonality(t), *_SEASON_FLOATS)


_SEASON_YEARS = f"""{_TAGS}, raw AS (SELECT *, CAST(date_trunc('month', listening_date) AS DATE) AS m, CAST(year(listening_date) + (month(listening_date) = 12)::INTEGER AS INTEGER) AS season_year, CAST((month(listening_date) % 12) // 3 + 1 AS INTEGER) AS season_order FROM plays),
rs AS (SELECT season_year, season_order, count(*) AS season_total_scrobbles, count(DISTINCT listening_date) AS season_active_days, count(DISTINCT m) AS season_observed_months FROM raw GROUP BY ALL),
ry AS (SELECT season_year, count(*) AS season_year_total_scrobbles, count(DISTINCT listening_date) AS season_year_active_days, count(DISTINCT m) AS months_observed_in_season_year, count(DISTINCT season_order) AS seasons_observed_in_season_year FROM raw GROUP BY ALL),
c AS (SELECT season_year, season_order, scrobble_id, canonical_genre, genre_weight FROM raw JOIN weights USING (album_id)),
sg AS (SELECT season_year, season_order, canonical_genre, sum(genre_weight) AS season_genre_weighted_scrobbles, count(*) AS season_genre_distinct_scrobbles FROM c GROUP BY ALL),
st AS (SELECT season_year, season_order, sum(genre_weight) AS season_covered_scrobbles, count(DISTINCT scrobble_id) AS season_covered_distinct_scrobbles FROM c GROUP BY ALL),
yg AS (SELECT season_year, canonical_genre, sum(genre_weight) AS season_year_genre_weighted_scrobbles, count(*) AS season_year_genre_distinct_scrobbles FROM c GROUP BY ALL),
yt AS (SELECT season_year, sum(genre_weight) AS season_year_covered_scrobbles, count(DISTINCT scrobble_id) AS season_year_covered_distinct_scrobbles FROM c GROUP BY ALL),
j AS (SELECT *, season_genre_weighted_scrobbles / season_covered_scrobbles AS season_share, season_year_genre_weighted_scrobbles / season_year_covered_scrobbles AS season_year_share, months_observed_in_season_year = 12 AND seasons_observed_in_season_year = 4 AS is_full_season_year
    FROM sg JOIN st USING (season_year, season_order) JOIN yg USING (season_year, canonical_genre) JOIN yt USING (season_year) JOIN rs USING (season_year, season_order) JOIN ry USING (season_year)),
season_years AS (SELECT *, season_share / nullif(season_year_share, 0) AS seasonality_index_season_year FROM j)"""
_SY_FLOATS = ["season_genre_weighted_scrobbles", "season_covered_scrobbles", "season_year_genre_weighted_scrobbles", "season_year_covered_scrobbles", "season_share", "season_year_share", "seasonality_index_season_year"]


@R.query("genre_season_year", _SEASON_YEARS + f" SELECT * EXCLUDE ({', '.join(_SY_FLOATS)}), ['Summer', 'Autumn', 'Winter', 'Spring'][season_order] AS season_name, {_sql6(*_SY_FLOATS)} FROM season_years")
def genre_season_year(t: Tables) -> DataFrame:
    """Q18; ranks of nearly equal weights aren't compared."""
    return _six(W.genre_season_years(A.written_plays(t), weights(t)), *_SY_FLOATS).drop("genre_rank_in_season_year")


_TOP_GENRES = _SEASON_YEARS + """, placed AS (SELECT DISTINCT season_year, canonical_genre, season_year_genre_weighted_scrobbles AS w FROM season_years WHERE is_full_season_year),
ranked AS (SELECT season_year, canonical_genre, w, row_number() OVER (PARTITION BY season_year ORDER BY w DESC, canonical_genre) AS genre_rank_in_season_year FROM placed)
SELECT season_year, canonical_genre, genre_rank_in_season_year, floor(max(season_share) FILTER (season_order = 1) * 1e6 + 0.5) / 1e6 AS summer, floor(max(season_share) FILTER (season_order = 2) * 1e6 + 0.5) / 1e6 AS autumn, floor(max(season_share) FILTER (season_order = 3) * 1e6 + 0.5) / 1e6 AS winter, floor(max(season_share) FILTER (season_order = 4) * 1e6 + 0.5) / 1e6 AS spring
FROM ranked JOIN season_years USING (season_year, canonical_genre) WHERE genre_rank_in_season_year <= 10 AND w >= 25 GROUP BY ALL"""


@R.query("season_year_top_genres", _TOP_GENRES)
def season_year_top_genres(t: Tables) -> DataFrame:
    """The ten best ranked genres of whole season-years with enough support, by season."""
    whole = W.genre_season_years(A.written_plays(t), weights(t)).filter("is_full_season_year AND genre_rank_in_season_year <= 10 AND season_year_genre_weighted_scrobbles >= 25")
    return whole.groupBy("season_year", "canonical_genre", "genre_rank_in_season_year").pivot("season_order", [1, 2, 3, 4]).agg(rounded(F.first("season_share"))).withColumnsRenamed({"1": "summer", "2": "autumn", "3": "winter", "4": "spring"})


_LIFE = f"""{_PLAYS}, monthly AS (SELECT artist_id, CAST(date_trunc('month', listening_date) AS DATE) AS month_start, count(*) AS n FROM plays GROUP BY ALL),
indexed AS (SELECT month_start, row_number() OVER (ORDER BY month_start) AS i FROM (SELECT DISTINCT month_start FROM monthly)),
stats AS (SELECT artist_id, count(*) AS total_scrobbles, count(DISTINCT listening_date) AS active_days, count(DISTINCT listening_year) AS active_years, min(listening_date) AS first_observed_date, max(listening_date) AS last_observed_date FROM plays GROUP BY artist_id),
years AS (SELECT artist_id, CAST(year(month_start) AS INTEGER) AS y, CAST(sum(n) AS BIGINT) AS n FROM monthly GROUP BY ALL),
py AS (SELECT artist_id, y AS peak_year, n AS peak_year_scrobbles FROM years QUALIFY row_number() OVER (PARTITION BY artist_id ORDER BY n DESC, y) = 1),
pm AS (SELECT artist_id, month_start AS peak_month, n AS peak_month_scrobbles FROM monthly QUALIFY row_number() OVER (PARTITION BY artist_id ORDER BY n DESC, month_start) = 1),
placed AS (SELECT artist_id, month_start, i, i - lag(i) OVER (PARTITION BY artist_id ORDER BY i) - 1 AS gap FROM monthly JOIN indexed USING (month_start)),
gaps AS (SELECT artist_id, coalesce(max(gap), 0) AS longest_inactive_observed_months, max(i) AS last_i, count(*) AS active_months, min(month_start) AS first_observed_month, max(month_start) AS last_observed_month FROM placed GROUP BY artist_id),
lifecycle AS (SELECT stats.*, artist_name, peak_year, peak_year_scrobbles, peak_month, peak_month_scrobbles, longest_inactive_observed_months, active_months, first_observed_month, last_observed_month, date_diff('day', first_observed_date, last_observed_date) AS observed_span_days,
    (SELECT max(i) FROM indexed) - last_i AS observed_months_since_last, first_observed_month = (SELECT min(month_start) FROM indexed) AS first_seen_in_dataset_opening_month, last_observed_month = (SELECT max(month_start) FROM indexed) AS active_in_latest_observed_month
    FROM stats JOIN artists USING (artist_id) JOIN py USING (artist_id) JOIN pm USING (artist_id) JOIN gaps USING (artist_id))"""


@R.query("artist_lifecycle", _LIFE + " SELECT * FROM lifecycle", dates=("first_observed_date", "last_observed_date", "first_observed_month", "last_observed_month", "peak_month"))
def artist_lifecycle(t: Tables) -> DataFrame:
    """Q16."""
    return W.artist_lifecycle(A.written_plays(t), A.artists(t))


_YEARLY = _LIFE + """, totals AS (SELECT listening_year, count(*) AS year_total_scrobbles, count(DISTINCT listening_date) AS dataset_active_days FROM plays GROUP BY 1),
ys AS (SELECT artist_id, listening_year, count(*) AS scrobbles, count(DISTINCT listening_date) AS active_days, count(DISTINCT listening_month) AS active_months, count(DISTINCT track_id) AS distinct_tracks, count(DISTINCT album_id) AS distinct_albums FROM plays GROUP BY ALL),
artist_years AS (SELECT ys.*, year_total_scrobbles, dataset_active_days, artist_name, scrobbles::DOUBLE / year_total_scrobbles AS year_scrobble_share, scrobbles::DOUBLE / total_scrobbles AS artist_lifetime_share, ys.listening_year = peak_year AS is_peak_year,
    ys.listening_year = year(first_observed_date) AS is_first_observed_year, ys.listening_year = year(last_observed_date) AS is_last_observed_year, row_number() OVER (PARTITION BY ys.listening_year ORDER BY scrobbles DESC, artist_name, artist_id) AS artist_rank
    FROM ys JOIN totals USING (listening_year) JOIN lifecycle USING (artist_id))"""


def artist_years(t: Tables) -> DataFrame:
    """Years of artists."""
    return W.artist_yearly(A.written_plays(t), W.artist_lifecycle(A.written_plays(t), A.artists(t)))


@R.query("artist_yearly", _YEARLY + f" SELECT * REPLACE (floor(year_scrobble_share * 1e6 + 0.5) / 1e6 AS year_scrobble_share, floor(artist_lifetime_share * 1e6 + 0.5) / 1e6 AS artist_lifetime_share) FROM artist_years")
def artist_yearly(t: Tables) -> DataFrame:
    """Q17."""
    return _six(artist_years(t), "year_scrobble_share", "artist_lifetime_share")


_RELEASES = f"{_TAGS}, {A.RELEASES_SQL}"


def releases(t: Tables) -> DataFrame:
    """Release years of the albums of the test tables."""
    return W.release_years(t.dim_album.select("album_id").distinct(), A.looked_up_years(t), A.album_tags(t), A.AS_OF_YEAR)


@R.query("album_release_year", f"{_RELEASES} SELECT * FROM releases")
def album_release_year(t: Tables) -> DataFrame:
    """Q20."""
    return releases(t)


_DEC = lambda keys, p, more, stat_more: f"""{_RELEASES}, dated AS (SELECT plays.*, release_year, release_decade FROM plays LEFT JOIN releases USING (album_id)),
cover AS (SELECT {keys} count(*) AS {p}total_scrobbles, count(album_id) AS {p}scrobbles_with_album, count(release_year) AS {p}release_year_covered_scrobbles, count(*) FILTER (album_id IS NOT NULL AND release_year IS NULL) AS {p}release_year_unknown_scrobbles, count(*) FILTER (album_id IS NULL) AS {p}scrobbles_without_album {more} FROM dated GROUP BY ALL),
stats AS (SELECT {keys} release_decade, count(*) AS scrobble_count, count(DISTINCT track_id) AS distinct_tracks, count(DISTINCT album_id) AS distinct_albums, count(DISTINCT artist_id) AS distinct_artists {stat_more} FROM dated WHERE release_decade IS NOT NULL GROUP BY ALL)"""  # noqa: E731
_DEC_FLOATS = ["release_year_coverage", "release_year_dataset_coverage", "share_of_resolved_scrobbles", "share_of_album_scrobbles", "share_of_all_scrobbles"]


@R.query("decade", _DEC("", "", "", ", min(release_year) AS earliest_release_year, max(release_year) AS latest_release_year") + """ SELECT * EXCLUDE (a, b, c, d, e), floor(a * 1e6 + 0.5) / 1e6 AS release_year_coverage, floor(b * 1e6 + 0.5) / 1e6 AS release_year_dataset_coverage, floor(c * 1e6 + 0.5) / 1e6 AS share_of_resolved_scrobbles, floor(d * 1e6 + 0.5) / 1e6 AS share_of_album_scrobbles, floor(e * 1e6 + 0.5) / 1e6 AS share_of_all_scrobbles
    FROM (SELECT *, release_decade || 's' AS release_decade_label, rank() OVER (ORDER BY scrobble_count DESC, release_decade) AS decade_rank, release_year_covered_scrobbles::DOUBLE / scrobbles_with_album AS a, release_year_covered_scrobbles::DOUBLE / total_scrobbles AS b, scrobble_count::DOUBLE / release_year_covered_scrobbles AS c, scrobble_count::DOUBLE / scrobbles_with_album AS d, scrobble_count::DOUBLE / total_scrobbles AS e FROM stats CROSS JOIN cover)""")  # fmt: skip
def decade(t: Tables) -> DataFrame:
    """Q21."""
    return _six(W.by_decade(A.written_plays(t), releases(t)), *_DEC_FLOATS)


_DECY_FLOATS = ["release_year_coverage", "release_year_dataset_coverage", "decade_share_within_resolved_year", "decade_share_within_full_year"]


@R.query("decade_yearly", _DEC("listening_year,", "year_", ", count(DISTINCT listening_month) AS months_observed, count(DISTINCT listening_date) AS active_days, min(listening_date) AS first_listening_date, max(listening_date) AS last_listening_date", "") + """ SELECT * EXCLUDE (a, b, c, d), floor(a * 1e6 + 0.5) / 1e6 AS release_year_coverage, floor(b * 1e6 + 0.5) / 1e6 AS release_year_dataset_coverage, floor(c * 1e6 + 0.5) / 1e6 AS decade_share_within_resolved_year, floor(d * 1e6 + 0.5) / 1e6 AS decade_share_within_full_year
    FROM (SELECT *, release_decade || 's' AS release_decade_label, rank() OVER (PARTITION BY listening_year ORDER BY scrobble_count DESC, release_decade) AS decade_rank_in_year, months_observed = 12 AS is_full_calendar_year, year_release_year_covered_scrobbles::DOUBLE / year_scrobbles_with_album AS a, year_release_year_covered_scrobbles::DOUBLE / year_total_scrobbles AS b, scrobble_count::DOUBLE / year_release_year_covered_scrobbles AS c, scrobble_count::DOUBLE / year_total_scrobbles AS d FROM stats JOIN cover USING (listening_year))""", dates=("first_listening_date", "last_listening_date"))  # fmt: skip
def decade_yearly(t: Tables) -> DataFrame:
    """Q22."""
    return _six(W.by_decade(A.written_plays(t), releases(t), "listening_year"), *_DECY_FLOATS)
