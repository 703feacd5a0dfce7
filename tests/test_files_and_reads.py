"""File sources, sinks, read-side shapes and streams."""

import json
from datetime import date, datetime

import pytest

from tests.conftest import rows
from tidemill.operators import reads as V
from tidemill.sources import files as S
from tidemill.streaming import streams as T


def track(name, uts=None, album="Al", playing=False):
    t = {"artist": {"mbid": "", "#text": "Ann"}, "album": {"mbid": "", "#text": album}, "mbid": "m", "name": name, "url": "u"}
    return t | ({"@attr": {"nowplaying": "true"}} if playing else {"date": {"uts": str(uts)}})


def test_pages_of_committed_runs(spark, tmp_path):
    for run, done, tracks in (("r1", True, [track("A", 100), track("B", 200, "")]), ("r2", True, track("C", playing=True)), ("r3", False, [track("D", 1)])):
        (tmp_path / run).mkdir()
        (tmp_path / run / "page_00001.json").write_text(json.dumps({"recenttracks": {"track": tracks, "@attr": {"user": "u", "page": "1"}}}))
        if done:
            (tmp_path / run / "manifest.json").write_text(json.dumps({"completed_at_utc": "2025-01-01T00:00:00Z"}))
    got = rows(S.read_pages(spark, str(tmp_path)), "observation_id", "track", "album", "scrobbled_at_uts", "is_now_playing", "artist_mbid", "user_name")
    assert got == [("r1:00001:0001", "A", "Al", 100, False, None, "u"), ("r1:00001:0002", "B", None, 200, False, None, "u"), ("r2:00001:0001", "C", "Al", None, True, None, "u")]


def test_tag_and_release_caches(spark, tmp_path):
    tags = [{"name": "Hip  Hop", "count": 100, "url": ""}, {"name": " ", "count": 9, "url": ""}, {"name": "Rap", "count": 8, "url": ""}]
    for k, (status, tag) in enumerate([("ok", tags), ("ok", tags[0]), ("error", None)]):
        (tmp_path / f"t{k}.json").write_text(json.dumps({"status": status, "artist_id": f"a{k}", "fetched_at_utc": "2025-01-01T00:00:00Z", "response": {"toptags": {"tag": tag}}}))
    enrichment, found = S.read_tag_cache(spark, str(tmp_path / "t*.json"), "artist_id")
    assert rows(enrichment, "artist_id", "status", "tag_count") == [("a0", "ok", 3), ("a1", "ok", 1), ("a2", "error", 0)]
    assert rows(found, "artist_id", "tag_rank", "tag_norm") == [("a0", 1, "hip hop"), ("a0", 3, "rap"), ("a1", 1, "hip hop")]
    for k, year in enumerate((1997, None)):
        (tmp_path / f"r{k}.json").write_text(json.dumps({"status": "ok", "album_id": f"b{k}", "first_release_year": year}))
    every, dated = S.read_release_cache(spark, str(tmp_path / "r*.json"))
    assert (every.count(), rows(dated, "album_id")) == (2, [("b0",)])


def test_csv_keeps_zeros_and_aliases(spark, tmp_path):
    (tmp_path / "c.csv").write_text('tag_norm,canonical_genre\nHip  hop,rap\n ,x\nhip hop,hip-hop\nz,\n"a, b",c\n')
    assert rows(S.read_alias_csv(spark, str(tmp_path / "c.csv"))) == [("a, b", "c"), ("hip hop", "hip-hop")]
    assert S.read_alias_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "v.json").write_text(json.dumps({"genres": [{"name": " Rock "}, {"name": "rock"}, {"name": ""}]}))
    assert rows(S.read_vocabulary(spark, str(tmp_path / "v.json"))) == [("rock",)]


def test_matrix_sheet(spark, tmp_path):
    (tmp_path / "m.csv").write_text("code,0191 Soy,0280 Wood,Total\n01911 soy,1.5,0,1.5\n02801,2,3,5\nTotal,3.5,3,6.5\n")
    cells = S.read_cells(spark, str(tmp_path / "m.csv"), 5, 4)
    assert rows(cells) == [("01911", "0191", 1.5), ("01911", "0280", 0.0), ("02801", "0191", 2.0), ("02801", "0280", 3.0)]
    S.checked_cells(cells, 2, 2)
    with pytest.raises(ValueError, match="expected"):
        S.checked_cells(cells, 3, 2)


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("01", 2), ("00", 1)], "zip string, n int")
    S.write_table(df, str(tmp_path / "p"))
    S.write_csv(df, str(tmp_path / "c"), ["zip"])
    S.write_metrics(df.orderBy("n").limit(1), str(tmp_path / "m.json"))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(S.read_csv(spark, str(tmp_path / "c"), "zip string, n int")) == [("00", 1), ("01", 2)]
    assert json.loads((tmp_path / "m.json").read_text()) == {"zip": "00", "n": 1}


def test_read_shapes(spark):
    df = spark.createDataFrame([("a", 2020, 5), ("a", 2022, 5), ("b", 2020, 9), ("c", 2021, 1)], "g string, y int, n long")
    assert rows(V.top_names(df, "g", "n", 2)) == [("a",), ("b",)]
    assert rows(V.with_other(df, "y", "g", "n", 1), "y", "g", "n") == [(2020, "Other", 9), (2020, "a", 5), (2021, "Other", 1), (2022, "a", 5)]
    assert rows(V.runs(df.select("g", "y"), ["g"], "y")) == [("a", 2020, 2020, 1), ("a", 2022, 2022, 1), ("b", 2020, 2020, 1), ("c", 2021, 2021, 1)]
    assert rows(V.runs(df.select("y"), [], "y")) == [(2020, 2022, 3)]
    assert rows(V.histogram(df, "n", [1, 5], ["1", "2-5", "6+"]), "bucket", "n") == [("1", 1), ("2-5", 2), ("6+", 1)]
    assert rows(V.ecdf(df.withColumnRenamed("n", "v"), "v"), "v", "n", "ecdf") == [(1, 1, 0.25), (5, 2, 0.75), (9, 1, 1.0)]
    months = spark.createDataFrame([(date(2024, 11, 1),), (date(2025, 2, 1),)], "m date")
    assert [r[0] for r in rows(V.month_range(months, "m"))] == [date(2024, 11, 1), date(2024, 12, 1), date(2025, 1, 1), date(2025, 2, 1)]


def test_stream_lets_each_play_through_once(spark, tmp_path):
    schema = "user_name string, artist string, track string, album string, scrobbled_at_uts long, is_now_playing boolean"
    for k, data in enumerate([[("u", "A", "T", None, 100, False), ("u", "A", "P", None, None, True)], [("u", " a", "t", "", 100, False), ("u", "A", "T", "x", 100, False)]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    like = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    assert T.run_available(T.plays_delivered_once(T.read_stream(spark, str(tmp_path / "in"), like)).select("track")).count() == 2


def test_stream_sessions_join_at_the_gap(spark, tmp_path):
    data = [("u", datetime(2024, 1, 1, 12)), ("u", datetime(2024, 1, 1, 12, 30)), ("u", datetime(2024, 1, 1, 13, 0, 1))]
    like = spark.createDataFrame(data, "u string, t timestamp_ntz")
    like.write.parquet(str(tmp_path / "in"))
    got = T.run_available_complete(T.user_sessions(T.read_stream(spark, str(tmp_path / "in"), like), "u", "t"))
    assert sorted(r[0] for r in got.select("event_count").collect()) == [1, 2]


def test_high_water_mark(spark):
    df = spark.createDataFrame([(1000,), (1100,)], "uts long")
    assert T.high_water_mark(df, "uts", 1200) == (1200, 900)
    assert T.high_water_mark(df.limit(0), "uts") == (None, 0)
