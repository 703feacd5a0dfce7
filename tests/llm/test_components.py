"""Hash-to-min against union-find."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_linkage import union_find
from tidemill.llm.components import hash_to_min, record_groups


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20), st.sampled_from([1, 200_000]))
def test_equals_union_find(spark, pairs, hot):
    got = hash_to_min(spark.createDataFrame(pairs, "src long, dst long"), hot_rows=hot)
    assert sorted(map(tuple, got.collect())) == union_find(pairs)


def test_long_chain_and_hub(spark):
    chain = [(k, k + 1) for k in range(100, 180)]
    hub = [(1, k) for k in range(2, 60)]
    got = dict(map(tuple, hash_to_min(spark.createDataFrame(chain + hub, "src long, dst long"), hot_rows=10).collect()))
    assert set(got.values()) == {1, 100} and len(got) == 81 + 59


PAIRS = "crm_record_id string, marketing_record_id string, review_status string, match_score string"
MEMBERS = "reconciled_lead_id string, system string, record_id string, extra int"


def test_archive(spark):
    pairs = spark.createDataFrame([(" r1 ", "R9", "AUTO_MATCH ", None), ("R1", "R9", "auto_match", None), ("R2", "R8", "review", None), ("R3", None, "confirmed", None), (None, None, None, None)], PAIRS)
    members = spark.createDataFrame([("L1", "crm", "R2", 1), (" l1", "Marketing", "r9\t", 1), (None, "crm", "R5", 1), ("  ", "crm", "R6", 1), ("L7", "crm", "R7", 1), ("L7", "crm", "R7", 1), ("L8", None, "R1", 1)], MEMBERS)
    got = rows(record_groups(pairs, members), "system", "record_id", "group_key")
    assert got == [("crm", "R1", "crm:R1"), ("crm", "R2", "crm:R1"), ("crm", "R3", "crm:R3"), ("crm", "R5", "crm:R5"), ("crm", "R6", "crm:R6"), ("crm", "R7", "crm:R7"), ("marketing", "R8", "marketing:R8"), ("marketing", "R9", "crm:R1")]


def test_empty(spark):
    assert record_groups(spark.createDataFrame([], PAIRS), spark.createDataFrame([], MEMBERS)).count() == 0


def test_shared_id_doesnt_square(spark):
    members = spark.range(3000).select(F.lit("L").alias("reconciled_lead_id"), F.lit("crm").alias("system"), F.format_string("R%05d", "id").alias("record_id"))
    got = record_groups(spark.createDataFrame([], PAIRS), members)
    assert got.count() == 3000 and got.select("group_key").distinct().count() == 1
