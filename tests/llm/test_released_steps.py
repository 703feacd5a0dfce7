"""Steps of problem 4 leave neither the files of earlier steps nor pairs whose names no abbreviation joins."""

import time

from tests.conftest import rows
from tests.llm.test_people import PLAIN
from tidemill.llm import people
from tidemill.llm.components import hash_to_min
from tidemill.session import release


def test_rounds_leave_no_files_of_earlier_rounds(spark):
    """Rounds of grouping a chain hold the files of a few rounds only, not of all."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    def settled(least):
        for _ in range(40):
            if files() <= least:
                break
            time.sleep(0.25)
        return files()

    release(spark)
    time.sleep(2)
    before = files()
    edges = spark.createDataFrame([(k, k + 1) for k in range(400)], "src long, dst long")
    grouped = hash_to_min(edges)
    assert settled(before + 60) <= before + 60
    assert rows(grouped.select("group_key").distinct()) == [(0,)]


def test_letters_alone_are_no_abbreviation(spark):
    """A word whose letters another holds abbreviates it only with the same initial; initials and beginnings still do."""
    names = ["Omar Novak", "Marandow Novak", "O Novak", "Oma Novak", "Omarandow Novak"]
    known = people.marked(people.prepared(spark.createDataFrame([(f"P{k}", n, None, "2125550101", None) for k, n in enumerate(names)], PLAIN), "crm_record_id"))
    side = lambda s: known.select(*[known[c].alias(f"{s}_{c}") for c in ("id", *people._MARKS)])
    met = rows(side("a").crossJoin(side("b")).filter(f"a_id < b_id AND {people.NAMES_MAY}"), "a_id", "b_id")
    assert ("P0", "P1") not in met
    assert {("P0", "P2"), ("P0", "P3"), ("P2", "P4"), ("P3", "P4")} <= set(met)
