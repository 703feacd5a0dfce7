"""Repeated deliveries."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemill.operators.delivery import PLAY_ORDER, deliver_once, historical_plays, play_identifier, surplus_copies

SCHEMA = "observation_id string, run_id string, source_page int, source_position int, user_name string, artist string, track string, album string, scrobbled_at_uts long, is_now_playing boolean, ingested_at timestamp"
T0 = datetime(2025, 1, 1)


def bronze(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def found(spark, data):
    plays = historical_plays(bronze(spark, data))
    return [r[0] for r in rows(surplus_copies(plays, play_identifier(), PLAY_ORDER, "observation_id"), "observation_id")]


def test_overlap_of_two_runs(spark):
    data = [
        ("a", "r1", 1, 1, "u", "X", "T", "", 100, False, T0),
        ("b", "r2", 1, 1, "u", " x ", "t", None, 100, False, T0 + timedelta(hours=1)),
        ("c", "r2", 1, 2, "u", "X", "T", "Al", 100, False, T0),
        ("d", "r2", 1, 3, "v", "X", "T", "", 100, False, T0),
        ("e", "r2", 1, 4, "u", "X", "T", "", None, True, T0),
    ]
    assert found(spark, data) == ["b"]


def test_ties_nulls_and_clashing_columns(spark):
    data = [
        ("b", "r", 1, 1, None, None, None, None, 1, None, None),
        ("a", "r", 1, 1, None, None, None, " ", 1, None, None),
        ("c", "r", 1, 1, None, None, None, None, 1, None, T0),
        ("d", "r", 1, 1, None, "", None, None, 1, None, T0),
    ]
    # A missing time comes last, so c stays; an empty artist isn't a missing one.
    assert found(spark, data) == ["a", "b"]
    plays = historical_plays(bronze(spark, data)).withColumns({"_h1": F.lit(1), "copies": F.lit(2), "kept_id": F.lit("z")})
    assert rows(deliver_once(plays, play_identifier(), PLAY_ORDER, "observation_id"), "observation_id", "_h1", "kept_id") == [("c", 1, "z"), ("d", 1, "z")]


def test_empty(spark):
    assert found(spark, []) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["u", "v"]), st.integers(1, 2), st.sampled_from(["A", " a", "b"]), st.integers(0, 3)), max_size=25))
def test_exactly_one_stays(spark, plays):
    data = [(f"o{k:03}", f"r{k % 3}", 1, k, u, a, "T", None, t, False, T0 + timedelta(hours=h)) for k, (u, t, a, h) in enumerate(plays)]
    best = {}
    for r in sorted(data, key=lambda r: (r[10], r[1], r[2], r[3], r[0])):
        best.setdefault((r[4], r[8], r[5].strip().lower()), r[0])
    assert found(spark, data) == sorted(r[0] for r in data if r[0] not in best.values())
