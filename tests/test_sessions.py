"""Sessions by sweep-line deltas against a plain walk."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tidemill.operators.sessions import sweep_sessions

T0 = datetime(2024, 2, 28, 22, 0)


def walk(events):
    """Sessions of (user, id, minutes) by the definition."""
    out = []
    for user in {e[0] for e in events}:
        first = {}
        for u, i, m in events:
            if u == user and m is not None and i is not None:
                first[i] = min(m, first.get(i, m))
        last = None
        for m, i in sorted((m, i) for i, m in first.items()):
            if last is None or m - last > 30:
                out.append([user, i, i, 0])
            out[-1][2], out[-1][3], last = i, out[-1][3] + 1, m
    return sorted(map(tuple, out), key=str)


def swept(spark, events):
    data = [(u, i, None if m is None else T0 + timedelta(minutes=m)) for u, i, m in events]
    df = spark.createDataFrame(data, "u string, id string, t timestamp_ntz")
    return rows(sweep_sessions(df, "u", "t", "id"), "u", "first_event_id", "last_event_id", "event_count")


def test_gap_of_exactly_thirty_minutes_joins(spark):
    df = spark.createDataFrame([("u", "a", datetime(2024, 1, 1, 12)), ("u", "b", datetime(2024, 1, 1, 12, 30)), ("u", "c", datetime(2024, 1, 1, 13, 0, 1))], "u string, id string, t timestamp_ntz")
    assert rows(sweep_sessions(df, "u", "t", "id"), "event_count", "duration_seconds") == [(1, 0.0), (2, 1800.0)]


def test_midnight_repeats_ties_and_nulls(spark):
    events = [("u", "a", 110), ("u", "b", 125), ("u", "b", 125), ("u", "c", None), (None, "d", 5), (None, "d", 5), ("u", None, 3), ("u", "z", 125), ("v", "e", 120)]
    assert swept(spark, events) == walk(events)


def test_session_over_several_days(spark):
    events = [("u", f"e{k:04}", k * 29) for k in range(200)] + [("u", "x", 10_000)]
    assert swept(spark, events) == walk(events)
    assert len(walk(events)) == 2


def test_empty(spark):
    assert swept(spark, []) == []


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["u", "v"]), st.integers(0, 60).map(lambda k: f"e{k:02}"), st.integers(0, 6000)), max_size=60))
def test_equals_the_walk(spark, events):
    once = {(u, i): m for u, i, m in events}
    events = [(u, i, m) for (u, i), m in once.items()]
    assert swept(spark, events) == walk(events)
