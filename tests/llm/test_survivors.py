"""Survivors of duplicate groups."""

from datetime import datetime, timedelta

import numpy as np

from tests.conftest import rows
from tidemill.llm import survivors as S

SCHEMA = "track_id string, track_name string, track_norm string, track_mbid string, latest_scrobble_at timestamp, scrobble_count long, dup_group string, posterior int"
T0 = datetime(2024, 1, 1)
ID = "0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f"


def table(spark, extra):
    names = [("Good Song Name", "good song name"), ("Unknown", "other song"), ("Some So…", "some song here"), ("Br�ken Song", "broken song"), ("", "x y"), (None, None), ("07", "real name"), ("GOOD LIVE (Live)", "good live (live)")]
    base = [(f"b{k:03}", *names[k % 8], ID if k % 2 else "n/a", T0, 1, f"x{k // 4}", 1) for k in range(160)]
    return spark.createDataFrame(base + extra, SCHEMA)


def claims(df):
    return S.claims_of(df, "track_id", "track_name", "track_norm", "track_mbid")


def test_fields_survive_apart(spark):
    extra = [
        ("t1", "Old Song", "old song", ID.upper(), T0, 5, "g", 1),
        ("t2", "Old  Song ", "old  song", "00000000-0000-0000-0000-000000000000", T0 + timedelta(days=2), 5, "g", 1),
        ("t3", "[untitled]", "old song", ID[:-2] + "zq", T0 + timedelta(days=9), 5, "g", 1),
        ("t4", "Tie", "tie", None, T0, 5, "h", 1),
        ("t5", "Tie", "tie", "", T0, 9, "h", 1),
        ("t6", "Tie", "tie", " " + ID, None, 9, "h", 1),
        ("t8", "Tie", "tie", None, T0, 9, "h", 1),
        ("t9", "n/a", "real", None, T0, 1, "i", 1),
        ("t0", "Ungrouped", "ungrouped", ID, T0, 1, None, 1),
    ]
    got = {r["dup_group"]: (r["name_from"], r["mbid_from"]) for r in S.survivors(claims(table(spark, extra))).collect()}
    assert (got["g"], got["h"], got["i"]) == (("t2", "t1"), ("t5", ""), ("", ""))
    assert None not in got


def test_several_values_stay_true(spark):
    extra = [("t1", "One Name", "one name", ID, T0, 1, "g", 1), ("t2", "Other Name", "other name", ID, T0, 1, "g", 1)]
    kept = S.true_values(claims(table(spark, extra))).filter("dup_group = 'g'")
    assert rows(kept, "id", "name_true") == [("t1", True), ("t2", True)]


def test_sensitivity_and_specificity_are_found():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.6
    sens, spec = np.array([0.98, 0.95, 0.7, 0.9]), np.array([0.9, 0.5, 0.95, 0.6])
    votes = np.where(truth[:, None], rng.random((20_000, 4)) < sens, rng.random((20_000, 4)) > spec).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, a, b = S.fit_sources(patterns, counts.astype(float))
    assert np.abs(a - sens).max() < 0.05 and np.abs(b - spec).max() < 0.08


def test_sources_judge_what_no_pattern_tells(spark):
    """A name that looks like any other is denied by the sources that know the record; a stand-in that no list names is denied by the other groups too."""
    extra = [("t1", "Wholly Different Words", "real title here", None, T0 + timedelta(days=9), 5, "g", 1), ("t2", "Real Title Here", "real title here", None, T0, 5, "g", 1)]
    extra += [(f"u{k}", "Zzyzx Placeholder" if k % 2 else f"Title {'abcdefghij'[k % 10]}lpha{k}", f"title {'abcdefghij'[k % 10]}lpha{k - k % 2}", None, T0, 1, f"u{k // 2}", 1) for k in range(20)]
    judged = {(r["dup_group"], r["value"]): r for r in S.value_sets(claims(table(spark, extra))).filter("field = 'name'").collect()}
    assert not judged["g", "wholly different words"]["is_true"] and judged["g", "real title here"]["is_true"]
    assert not any(r["is_true"] for (_, v), r in judged.items() if v == "zzyzx placeholder")
    assert all(0 <= r["posterior"] <= 1 for r in judged.values())


def test_sets_of_values(spark):
    extra = [("t1", "One Name", "one name", ID, T0, 1, "g", 1), ("t2", "one name ", "one name", ID.upper(), T0, 1, "g", 1), ("t3", "One Name (Live)", "one name (live)", "n/a", T0, 1, "g", 1), ("t4", None, None, "", T0, 1, "g", 1)]
    got = S.value_sets(claims(table(spark, extra))).filter("dup_group = 'g'")
    assert rows(got, "field", "value", "records", "is_true") == sorted([("name", "one name", 2, True), ("name", "one name (live)", 1, True), ("mbid", ID, 2, True), ("mbid", "n/a", 1, False)], key=str)


def test_hot_values_and_groups(spark, monkeypatch):
    """A group and a value with a third of all rows come out the same when hot keys are broadcast."""
    extra = [(f"h{k}", "Untitled" if k % 2 else "Large Group Song", "large group song", "n/a", T0, k, "large", 1) for k in range(100)]
    want = rows(S.survivors(claims(table(spark, extra))))
    whole = S.join_by_size
    monkeypatch.setattr(S, "join_by_size", lambda a, b, key, size: whole(a, b, key, size, hot_rows=5, most_sent=3))
    assert rows(S.survivors(claims(table(spark, extra)))) == want
    assert ("large", "h98", "", "Large Group Song", None) in want


def test_empty(spark):
    assert S.survivors(claims(spark.createDataFrame([], SCHEMA))).count() == 0
