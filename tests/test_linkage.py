"""Rule-based linkage and components."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemill.functions.text import lcs_length, name_key, phone_key, similarity_ratio, zip_key
from tidemill.operators import linkage as K
from tidemill.operators.components import connected_components, number_in_order

T0 = datetime(2025, 5, 1, 10)
FIELDS = "name string, email string, phone string, zip_code string, service string"


def test_normal_forms(spark):
    df = spark.createDataFrame([("(212) 555-0101", "José D'Ávila", "01234-999"), ("+1 212 555 0101", None, "123"), ("2125550101 ", "", None), ("12", "  ", "98765")], "p string, n string, z string")
    got = df.select(phone_key(F.col("p")).alias("p"), name_key(F.col("n")).alias("n"), zip_key(F.col("z")).alias("z")).collect()
    assert [tuple(r) for r in got] == [("2125550101", "josedavila", "01234"), ("2125550101", None, None), ("2125550101", None, None), (None, None, "98765")]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(row[j], prev[j + 1])
    return row[-1]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abé1", max_size=9), st.text("abé1", max_size=9)), min_size=1, max_size=12))
def test_similarity_equals_dynamic_program(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", lcs_length(F.col("a"), F.col("b")).alias("l"), similarity_ratio(F.col("a"), F.col("b")).alias("s")).collect():
        assert r["l"] == lcs(r["a"], r["b"])
        assert abs(r["s"] - (1.0 if r["a"] == r["b"] else 2 * lcs(r["a"], r["b"]) / (len(r["a"]) + len(r["b"])))) < 1e-12


def leads(spark):
    crm = [("C1", T0, "Ann Lee", "a@x.com", "2125550101", "01234", "s"), ("C2", T0, "Bob Ray", None, "2125550102", "01234", "s"), ("C3", T0, "Zed", None, None, None, "s"), ("C4", T0, None, None, None, None, None)]
    mkt = [("M1", T0 + timedelta(hours=24, seconds=59), "Ann Lee", "A@x.com ", "(212) 555-0101", "01234", "s"), ("M2", T0 + timedelta(hours=25), "Bob Ray", None, "2125550102", "01234", "s"), ("M3", T0 + timedelta(hours=2), "Bob Ray", "b@x.com", None, "01234-11", "s"), ("M4", T0, None, "", "0", None, "s")]
    return spark.createDataFrame(crm, f"crm_record_id string, created_at timestamp_ntz, {FIELDS}"), spark.createDataFrame(mkt, f"marketing_record_id string, captured_at timestamp_ntz, {FIELDS}")


def test_exact_rules_window_and_strongest(spark):
    crm, mkt = (K.normalized(x) for x in leads(spark))
    assert rows(K.exact_candidates(crm, mkt)) == [("C1", "M1", 1440, "email_phone_time", 1.0), ("C2", "M3", 120, "name_zip_time", 0.85)]


def test_resolution_thresholds(spark):
    exact = spark.createDataFrame([("C1", "M1", 5, "email_time", 0.95)], "crm_record_id string, marketing_record_id string, time_delta_minutes long, match_rule string, match_score double")
    fuzzy = spark.createDataFrame([("C2", "M2", 1, 0.94, 3), ("C3", "M3", 1, 0.84, 2), ("C4", "M4", 1, 0.70, 4), ("C5", "M5", 1, 0.99, 1), ("C6", "M6", 1, 0.75, 2), ("C7", "M7", 1, 0.90, 2)], "crm_record_id string, marketing_record_id string, time_delta_minutes long, fuzzy_score double, evidence_count long")
    assert rows(K.resolved(exact, fuzzy), "crm_record_id", "review_status") == [("C1", "auto_match"), ("C2", "auto_match"), ("C3", "manual_review"), ("C6", "manual_review"), ("C7", "auto_match")]


def links(spark, pairs):
    return spark.createDataFrame([(a, b, m, s) for a, b, m, s in pairs], "crm_record_id string, marketing_record_id string, match_method string, review_status string")


def test_clusters_of_five_edges(spark):
    found = links(spark, [("CRM1", "MKT1", "exact", "auto_match"), ("CRM2", "MKT1", "fuzzy", "auto_match"), ("CRM3", "MKT2", "exact", "auto_match"), ("CRM3", "MKT3", "exact", "auto_match"), ("CRM4", "MKT4", "fuzzy", "manual_review")])
    members = K.cluster_members(found)
    assert rows(members) == [("RCL0000001", "crm", "CRM1"), ("RCL0000001", "crm", "CRM2"), ("RCL0000001", "marketing", "MKT1"), ("RCL0000002", "crm", "CRM3"), ("RCL0000002", "marketing", "MKT2"), ("RCL0000002", "marketing", "MKT3")]
    got = rows(K.clusters(found, members), "crm_record_count", "marketing_record_count", "match_edge_count", "fuzzy_edge_count", "has_crm_duplicates", "has_marketing_duplicates", "is_many_to_many")
    assert got == [(1, 2, 2, 0, False, True, False), (2, 1, 2, 1, True, False, False)]
    assert K.cluster_members(links(spark, [])).count() == 0


def test_ledger_prefers_marketing(spark):
    crm = spark.createDataFrame([("C1", T0, "s1", "c", "v"), ("C2", T0, "s2", None, "v")], "crm_record_id string, created_at timestamp_ntz, source string, campaign string, service string")
    mkt = spark.createDataFrame([("M1", T0, "m1", None, "w"), ("M2", T0, "m2", None, None)], "marketing_record_id string, captured_at timestamp_ntz, source_label string, campaign string, service string")
    members = spark.createDataFrame([("R1", "crm", "C1"), ("R1", "marketing", "M1")], "reconciled_lead_id string, system string, record_id string")
    assert rows(K.ledger(crm, mkt, members), "ledger_id", "ledger_kind", "source", "campaign", "service") == [("R1", "both", "m1", "c", "w"), ("crm:C2", "crm_only", "s2", None, "v"), ("marketing:M2", "marketing_only", "m2", None, None)]


def test_duplicates_within_minutes(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    data = [("M1", at(0), "A", "a@x.com", None, None, "s"), ("M2", at(7), "A", "a@x.com", None, None, "s"), ("M3", at(60 * 24 * 21), "A", "a@x.com", None, None, "s"), ("M4", at(1), "A", "a@x.com", None, None, "other"), ("M5", None, None, None, None, None, None)]
    mkt = K.normalized(spark.createDataFrame(data, f"marketing_record_id string, captured_at timestamp_ntz, {FIELDS}"))
    assert rows(K.duplicate_groups(mkt, "marketing_record_id", "captured_at", 15)) == [("M1", "M1"), ("M2", "M1"), ("M3", "M3"), ("M4", "M4"), ("M5", "M5")]


def test_evaluation_counts(spark):
    pairs = spark.createDataFrame([("C1", "M1"), ("C2", "M1"), ("C3", "M9")], "crm_record_id string, marketing_record_id string")
    truth = "record_id string, truth string"
    got = K.evaluate_pairs(pairs, spark.createDataFrame([("C1", "t1"), ("C2", "t2"), ("C3", None)], truth), spark.createDataFrame([("M1", "t1"), ("M2", "t2")], truth)).first()
    assert (got["pair_predicted"], got["pair_true_positives"], got["pair_possible"], got["lead_possible"], got["lead_recovered"]) == (3, 1, 2, 2, 1)
    assert abs(got["pair_f1"] - 0.4) < 1e-12


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return sorted((x, find(x)) for x in parent)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=18), st.sampled_from([1, 200_000]))
def test_components_equal_union_find(spark, pairs, hot):
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b", hot_rows=hot)
    assert sorted(map(tuple, got.collect())) == union_find(pairs)


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(f"k{k:03}",) for k in range(57)], "k string").repartition(5)
    assert rows(number_in_order(df, "k", "no")) == [(f"k{k:03}", k + 1) for k in range(57)]
