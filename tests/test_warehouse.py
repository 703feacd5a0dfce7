"""Warehouse operators on small literals."""

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemill.functions import dates
from tidemill.operators import warehouse as W

UTC = timezone.utc
BRONZE = "observation_id string, run_id string, source_page int, source_position int, user_name string, artist string, track string, album string, artist_mbid string, track_mbid string, album_mbid string, scrobbled_at timestamp, scrobbled_at_uts long, track_url string, is_now_playing boolean, ingested_at timestamp, source_file string"


def observation(k, artist, track, album, at, run="r1", playing=False, user="u"):
    uts = None if playing else int(at.timestamp())
    return (f"{run}:{k}", run, 1, k, user, artist, track, album, " ", None, "mb", None if playing else at, uts, "url", playing, datetime(2025, 1, 2, tzinfo=UTC) + timedelta(hours=run == "r2"), "f")


def test_overlapping_runs(spark):
    at = datetime(2025, 1, 1, 12, tzinfo=UTC)
    data = [observation(1, "Ann", "T", "Al", at), observation(2, "Ann", "U", " ", at), observation(3, "Ann", "T", "Al", at + timedelta(minutes=4)), observation(1, "ANN ", "t", "al", at, "r2"), observation(2, "Ann", "V", None, at, "r2", True)]
    bronze = spark.createDataFrame(data, BRONZE)
    staged = W.stage_plays(bronze)
    got = W.build_metrics(bronze, staged).first().asDict()
    assert got == {"bronze_rows": 5, "now_playing_rows": 1, "historical_rows": 4, "runs": 2, "unique_plays": 3, "removed_copies": 1}
    assert rows(staged, "artist", "track", "album", "artist_mbid") == [("Ann", "T", "Al", None), ("Ann", "T", "Al", None), ("Ann", "U", None, None)]
    fact = W.fact_plays(staged)
    for dim, key in ((W.dim_artist(staged), "artist_id"), (W.dim_track(staged), "track_id"), (W.dim_album(staged), "album_id")):
        assert W.orphans(fact, dim, key).count() == 0
    assert rows(W.dim_artist(staged), "artist_name", "scrobble_count") == [("Ann", 3)]


def test_local_time_over_the_clock_change(spark):
    at = datetime(2018, 12, 31, 2, tzinfo=UTC)
    df = spark.createDataFrame([(at,), (datetime(2024, 1, 1, 2, tzinfo=UTC),)], "t timestamp")
    assert [r[0] for r in df.select(dates.local_time(F.col("t"))).collect()] == [datetime(2018, 12, 31, 0), datetime(2023, 12, 31, 23)]


def test_seasons(spark):
    df = spark.createDataFrame([(2024, m) for m in (1, 2, 3, 5, 6, 8, 9, 11, 12)], "y int, m int")
    order = dates.season_order(F.col("m"))
    got = df.select("m", dates.season_name(order).alias("s"), dates.season_year(F.col("y"), F.col("m")).alias("sy")).collect()
    assert [(r["m"], r["s"], r["sy"]) for r in got][-1] == (12, "Summer", 2025)
    assert [r["s"] for r in got[:8]] == ["Summer"] * 2 + ["Autumn"] * 2 + ["Winter"] * 2 + ["Spring"] * 2


def plays(spark, data):
    out = [(f"s{k}", "u", a, f"t{a}", al, datetime(d.year, d.month, d.day, 10), d, d.year, d.month, 10, d.isoweekday(), "x") for k, (a, al, d) in enumerate(data)]
    return spark.createDataFrame(out, "scrobble_id string, user_name string, artist_id string, track_id string, album_id string, scrobbled_at_local timestamp_ntz, listening_date date, listening_year int, listening_month int, listening_hour int, weekday_iso int, weekday_name string")


def test_discovery_adds_up(spark):
    p = plays(spark, [("A", None, date(2025, 1, 3)), ("A", None, date(2025, 2, 1)), ("B", None, date(2025, 2, 2))])
    got = rows(W.monthly_discovery(p), "month_start", "new_artists", "returning_artists", "cumulative_artists", "discovery_rate_pct")
    assert got == [(date(2025, 1, 1), 1, 0, 1, 100.0), (date(2025, 2, 1), 1, 1, 2, 50.0)]


def test_lifecycle_counts_observed_months(spark):
    # March is observed by B only; April by none, so it isn't silence.
    p = plays(spark, [("A", None, date(2025, 1, 3)), ("B", None, date(2025, 3, 1)), ("A", None, date(2025, 5, 1)), ("A", None, date(2025, 5, 2))])
    artists = spark.createDataFrame([("A", "Ann"), ("B", "Bob")], "artist_id string, artist_name string")
    got = {r["artist_name"]: r for r in W.artist_lifecycle(p, artists).collect()}
    assert (got["Ann"]["longest_inactive_observed_months"], got["Ann"]["peak_month"], got["Ann"]["observed_span_days"]) == (1, date(2025, 5, 1), 119)
    assert (got["Bob"]["observed_months_since_last"], got["Bob"]["active_in_latest_observed_month"]) == (1, False)


def test_tags_and_weights(spark):
    albums = spark.createDataFrame([("a", "x"), ("b", "x")], "album_id string, artist_id string")
    tags = "tag_rank int, tag_norm string, tag_weight long"
    evidence = W.tag_evidence(albums, spark.createDataFrame([("a", 1, "rock", 100), ("a", 2, "progressive rock", 50), ("a", 3, "prog", 40), ("a", 4, "zero", 0)], f"album_id string, {tags}"), spark.createDataFrame([("x", 1, "rock", 10)], f"artist_id string, {tags}"))
    assert rows(evidence.filter("album_id = 'b'"), "tag_norm", "tag_source") == [("rock", "artist_fallback")]
    taxonomy = spark.createDataFrame([("rock", "genre", "rock"), ("progressive rock", "genre", "prog"), ("prog", "genre", "prog"), ("zero", "genre", "zero"), ("1999", "era", None)], "tag_norm string, tag_type string, canonical_genre string")
    got = rows(W.genre_weights(evidence, taxonomy), "album_id", "canonical_genre", "genre_weight_raw", "source_tag_count", "genre_rank")
    assert got == [("a", "prog", 50, 2, 2), ("a", "rock", 100, 1, 1), ("b", "rock", 10, 1, 1)]
    assert all(abs(r[0] - 1) < 1e-12 for r in W.genre_weights(evidence, taxonomy).groupBy("album_id").agg(F.sum("genre_weight")).select("sum(genre_weight)").collect())


def test_release_years_and_decades(spark):
    albums = spark.createDataFrame([(c,) for c in "ABCD"], "album_id string")
    looked_up = spark.createDataFrame([("A", 1997, "mbid")], "album_id string, first_release_year int, resolution_method string")
    tags = spark.createDataFrame([("A", "1998"), ("B", "2004"), ("C", "1971"), ("C", "1972"), ("D", "rock"), ("D", "2999")], "album_id string, tag_norm string")
    releases = W.release_years(albums, looked_up, tags, 2026)
    got = rows(releases, "album_id", "release_year", "release_year_source", "lastfm_candidate_year_count", "exact_year_match", "same_decade")
    assert got == [("A", 1997, "musicbrainz", 1, False, True), ("B", 2004, "lastfm_year_tag", 1, None, None), ("C", None, "unknown", 2, None, None), ("D", None, "unknown", 0, None, None)]
    p = plays(spark, [("x", a, date(2024, 1, 1)) for a in ("A", "B", "C")] + [("x", None, date(2024, 1, 1))])
    decade = {r["release_decade_label"]: r for r in W.by_decade(p, releases).collect()}
    assert set(decade) == {"1990s", "2000s"}
    assert (decade["1990s"]["release_year_coverage"], decade["1990s"]["release_year_dataset_coverage"]) == (2 / 3, 1 / 2)
    yearly = W.by_decade(p, releases, "listening_year").first()
    assert (yearly["is_full_calendar_year"], yearly["decade_share_within_resolved_year"]) == (False, 0.5)


def test_empty_tables(spark):
    p = plays(spark, [("A", None, date(2025, 1, 3))]).limit(0)
    artists = spark.createDataFrame([], "artist_id string, artist_name string")
    for df in (W.daily_listening(p), W.monthly_discovery(p), W.artist_lifecycle(p, artists), W.artist_summary(p, artists)):
        assert df.count() == 0
