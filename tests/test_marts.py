"""Session contents, catalogue, heat maps and labels on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemill.operators import catalogue as C
from tidemill.operators import reads as V
from tidemill.operators import sessions as S

T0 = datetime(2024, 1, 1, 23, 50)


def test_session_content(spark):
    play = lambda u, m, k, a, b: (u, T0 + timedelta(minutes=m), k, a, b, "clash")
    data = [play("u", 0, "1", "x", None), play("u", 20, "2", "x", "p"), play("u", 20, "3", "y", "p"), play("u", 60, "4", "z", "q"), play(None, 0, "5", "x", "p"), play("u", 3000, "6", "x", "p"), ("u", None, "7", "n", "n", "clash"), ("u", T0, None, "n", "n", "clash")]
    events = spark.createDataFrame(data, "user string, at timestamp_ntz, id string, artist_id string, album_id string, u string")
    found = S.sweep_sessions(events, "user", "at", "id")
    got = rows(S.session_content(found, events, "user", "at", "id", ["artist_id", "album_id"]), "user", "session_number", "event_count", "distinct_artists", "distinct_albums")
    assert got == sorted([("u", 1, 3, 2, 1), ("u", 2, 1, 1, 1), ("u", 3, 1, 1, 1), (None, 1, 1, 1, 1)], key=str)
    ids = S.session_content(found, events, "user", "at", "id", ["artist_id"]).select("session_id")
    assert ids.filter("length(session_id) = 32").count() == 4
    empty = events.limit(0)
    assert S.session_content(S.sweep_sessions(empty, "user", "at", "id"), empty, "user", "at", "id", ["artist_id"]).count() == 0


def test_long_session_over_days(spark):
    events = spark.createDataFrame([("u", T0 + timedelta(minutes=25 * k), f"{k:04}", f"a{k % 3}") for k in range(200)], "user string, at timestamp_ntz, id string, artist_id string")
    got = S.session_content(S.sweep_sessions(events, "user", "at", "id"), events, "user", "at", "id", ["artist_id"])
    assert rows(got, "session_number", "event_count", "distinct_artists") == [(1, 200, 3)]


def test_build_and_exports(spark, tmp_path):
    built = C.build_tables(spark, str(tmp_path / "w"), {"base": lambda _: spark.range(5).toDF("n"), "double": lambda of: of("base").selectExpr("n * 2 AS n")})
    assert rows(built["double"]) == [(0,), (2,), (4,), (6,), (8,)]
    with pytest.raises(KeyError):
        C.build_tables(spark, str(tmp_path / "v"), {"a": lambda of: of("later"), "later": lambda _: spark.range(1)})
    assert C.export_all(str(tmp_path / "x"), {"down": (built["base"], [F.desc("n")])}) == ["down"]
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "x/down.parquet")).collect()] == [4, 3, 2, 1, 0]


def test_digests_labels_and_colours(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc")
    assert rows(C.file_digests(spark, str(tmp_path)), "length", "sha256") == [(3, hashlib.sha256(b"abc").hexdigest())]
    names = spark.createDataFrame([("hip hop", 2), ("r&b", 1), ("Other", 0), ("hip hop", 5), (None, 1)], "g string, at int")
    labels = names.filter("g IS NOT NULL").select(C.title_label(F.col("g"), {"R&B": "R&B"}).alias("l")).distinct()
    assert rows(labels) == [("Hip Hop",), ("Other",), ("R&B",)]
    assert rows(C.assigned_colours(names, "g", "at", ["red", "blue"], {"Other": "grey"})) == [("Other", "grey"), ("hip hop", "blue"), ("r&b", "red")]
    with pytest.raises(ValueError, match="palette"):
        C.assigned_colours(names, "g", "at", ["red"])


def test_heat_maps(spark):
    years = spark.createDataFrame([("a", 2020, 3), ("a", 2022, 1), ("b", 2021, 2), ("c", 2020, 1)], "name string, listening_year int, scrobbles long")
    assert rows(V.lifetime_heatmap(years, "name", 2)) == [("a", 2020, 0.75), ("a", 2021, 0.0), ("a", 2022, 0.25), ("b", 2020, 0.0), ("b", 2021, 1.0), ("b", 2022, 0.0)]
    seasons = spark.createDataFrame([("g", 1, 5.0, 0.5), ("g", 3, 1.0, 2.0), ("h", 1, 1.0, 9.0)], "g string, season_order int, w double, x double")
    assert rows(V.season_matrix(seasons, "g", "w", "x", 1)) == [("g", 0.5, None, 2.0, None)]
    cells = spark.createDataFrame([(2020, "g", 1, 600, 1, True, 30.0, 1.5), (2020, "h", 1, 600, 2, True, 9.0, 1.1), (2021, "g", 1, 499, 1, True, 30.0, 1.5), (2022, "g", 1, 600, 1, False, 30.0, 1.5)], "season_year int, canonical_genre string, season_order int, season_year_total_scrobbles int, genre_rank_in_season_year int, is_full_season_year boolean, season_year_genre_weighted_scrobbles double, seasonality_index_season_year double")
    assert rows(V.season_year_cells(cells, 2, 500, 25.0, True)) == [(2020, "g", 1, 1.5), (2020, "h", 1, None)]
    yearly = spark.createDataFrame([(2020, 1990, 3, 4, 10), (2020, 2000, 1, 4, 10), (2021, 1990, 1, 1, 10), (2025, 1990, 9, 9, 9)], "listening_year int, release_decade int, scrobble_count long, year_release_year_covered_scrobbles long, year_total_scrobbles long")
    assert rows(V.decade_window(yearly, 2020, 2021)) == [(1990, 4, 0.8, 0.25), (2000, 1, 0.2, 0.25)]
    sizes = spark.createDataFrame([(1, 1), (4, 2), (4, 4)], "n int, a int")
    assert rows(V.ratios_by_size(sizes, "n", {"r": "a"}, [1, 5], ["1", "2-5", "6+"])) == [("1", 1, 1.0), ("2-5", 2, 0.75)]


def test_queries_register_without_a_session():
    """The entry is read before any session begins."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, timeout=120).returncode == 0
