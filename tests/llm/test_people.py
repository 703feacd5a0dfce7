"""Names, persons and enquiries."""

from datetime import datetime, timedelta

import pytest

from tests.conftest import rows
from tidemill.llm import linkage, people

CASES = [
    ("ann lee", "lee ann", 4), ("bill gray", "william gray", 4), ("katherine nova", "kathrine nova", 3), ("k nova", "katherine nova", 2), ("philip nova", "rebecca nova", 0), ("", "ann lee", -1),
    ("red barn nova bakery", "red barn nova bakr bakery", 4), ("red barn nova phys", "red barn nova physiotherapy", 2), ("nova", "ann nova", 1), ("marianova", "maria nova", 3), ("w nova", "bill nova", 2),
]


@pytest.mark.parametrize(("a", "b", "level"), CASES)
def test_name_levels(a, b, level):
    assert people.name_level(a.split(), b.split()) == level
    assert people.name_level(b.split(), a.split()) == level


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(row[j], prev[j + 1])
    return row[-1]


def test_bit_parallel_lcs():
    import random

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcé") for _ in range(r.randint(0, n))) for n in (30, 90))
        assert people.lcs(a, b) == plain_lcs(a, b)


CRM = "crm_record_id string, created_at timestamp_ntz, name string, email string, phone string, zip_code string, service string, links int"
T0 = datetime(2024, 1, 1)
PEOPLE = [
    ("C1", T0, "Bill Novadow", "bill@x.test", "2125550101", "01234", "s", 1),
    ("C2", T0, "Novadow, William", None, "(212) 555-0101", "01234-9999", "s", 1),
    ("C3", T0, "WilliamNovadow", "bill+home@x.test", None, "99999", "s", 1),
    ("C4", T0, "Rebecca Novadow", "bill@x.test", "2125550101", "01234", "s", 1),
    ("C5", T0, "William Novadow", "other@y.test", "9995550111", "55555", "s", 1),
    ("C6", T0, "Wiliam Novadow", None, None, "1234", "s", 1),
    ("C7", T0, None, None, None, None, None, 1),
    ("C8", T0, "homeowner", "bill@x.test", "12125550101", None, "s", 1),
    ("C9", T0, "x" * 3000, "none@none.test", "000-000-0000", "", "s", 1),
    ("C9", T0, "x" * 3000, "none@none.test", "000-000-0000", "", "s", 1),
]


def test_entities(spark):
    got = {r["crm_record_id"]: r["entity_id"] for r in people.entities(spark.createDataFrame(PEOPLE, CRM), "crm_record_id").collect()}
    same = lambda *ids: len({got[i] for i in ids}) == 1
    assert same("C1", "C2", "C3", "C6")
    assert len({got[i] for i in ("C1", "C5", "C7", "C9")}) == 4
    assert len(got) == 9


def test_common_keys_lose_no_link(spark):
    df = spark.createDataFrame(PEOPLE[:6], CRM)
    records = people.prepared(df, "crm_record_id")
    linked = lambda common: rows(people.same_person(people.compared(people.candidate_pairs(records, common), records, records)), "a", "b")
    assert set(linked(1)) >= {("C1", "C2"), ("C1", "C3")}
    assert set(linked(1)) <= set(linked(1000))


def test_pairs_and_empty(spark):
    grouped = spark.createDataFrame([("b", "e"), ("a", "e"), ("c", "f")], "crm_record_id string, entity_id string")
    assert rows(people.entity_pairs(grouped, "crm_record_id")) == [("a", "b")]
    assert people.entities(spark.createDataFrame([], CRM), "crm_record_id").count() == 0


MKT = "marketing_record_id string, captured_at timestamp_ntz, name string, email string, phone string, zip_code string, service string"


def test_enquiries(spark):
    crm, mkt = [], []
    for k in range(40):
        at = T0 + timedelta(days=9 * k)
        person = (f"Given{'abcdefghij'[k % 10]} Sur{'klmnopqrst'[k // 10]}name{'uvwxyzabcd'[k % 10]}", f"p{k}@x.test", f"212555{k:04}", f"{10000 + k}", "s")
        crm.append((f"C{k:02}", at, *person, 1))
        mkt.append((f"M{k:02}", at + timedelta(hours=k % 50), person[0].upper(), person[1] if k % 2 else None, person[2] if k % 3 else None, person[3], "s"))
        # Someone else of the same zip in the same days, and the same person's next enquiry eight days on.
        mkt.append((f"N{k:02}", at + timedelta(hours=3), f"Other{'klmnopqrst'[k % 10]} Fam{'uvwxyzabcd'[k // 10]}name{'uvwxyzabcd'[k % 10]}", None, None, person[3], "t"))
        if k % 10 == 0:
            mkt.append((f"O{k:02}", at + timedelta(days=8, hours=1), *person))
    crm.append(("CX", None, "A B", None, None, None, None, 1))
    got = linkage.match_records(spark.createDataFrame(crm, CRM), spark.createDataFrame(mkt, MKT))
    assert rows(got, "crm_record_id", "marketing_record_id") == [(f"C{k:02}", f"M{k:02}") for k in range(40)]
    assert all(0.5 <= r[0] <= 1 for r in got.select("confidence").collect())


def test_enquiries_of_empty_tables(spark):
    assert linkage.match_records(spark.createDataFrame([], CRM), spark.createDataFrame([], MKT)).count() == 0


def crowd(n, seed=1):
    """n records on one phone: two of each person, the second spelled with a slip in the name and in the address or zip."""
    import random

    r = random.Random(seed)
    syllable = lambda: r.choice("bdfgklmnprstvz") + r.choice("aeiou") + r.choice(["", "n", "r", "s"])
    word = lambda k: "".join(syllable() for _ in range(k)).capitalize()
    slip = lambda w: (lambda i: w[:i] + r.choice("aeiou") + w[i + 1 :])(r.randrange(1, len(w)))
    out = []
    for k in range(n // 2):
        first, last, mail, code = word(2), word(3), f"{word(3)}{k}@x.test".lower(), f"{r.randrange(100000):05}"
        out.append((f"A{k:06}", f"{first} {last}", mail, "2125550101", code))
        out.append((f"B{k:06}", f"{slip(first)} {slip(last)}" if k % 3 else f"{first[0]} {last}", mail if k % 2 else None, "2125550101", code if k % 5 else None))
    return out


PLAIN = "crm_record_id string, name string, email string, phone string, zip_code string"


def test_one_phone_equals_all_pairs(spark):
    """On a phone that all share, refined blocks lose at most one in a hundred of the links that comparing all pairs gives."""
    import itertools

    records = people.prepared(spark.createDataFrame(crowd(600), PLAIN), "crm_record_id").cache()
    every = spark.createDataFrame(list(itertools.combinations(sorted(r[0] for r in crowd(600)), 2)), "a string, b string")
    brute = set(rows(people.same_person(people.compared(every, records, records, linkable=True)), "a", "b"))
    found = set(rows(people.same_person(people.compared(people.candidate_pairs(records, 20), records, records, linkable=True)), "a", "b"))
    assert found <= brute and len(brute - found) <= len(brute) / 100
    assert len(brute) >= 250


def test_hot_phone_leaves_no_large_block(spark):
    """20,000 records on one phone: no block is larger than the limit, nothing that grows with the square of the block is made, and the planted links are compared."""
    records = people.prepared(spark.createDataFrame(crowd(20_000), PLAIN), "crm_record_id").cache()
    blocks, pivots = people.refined_blocks(people.block_keys(records), people.record_parts(records), 300)
    assert blocks.groupBy("key").count().agg({"count": "max"}).first()[0] <= 300
    assert pivots.count() <= 20_000 * 40
    pairs = people.candidate_pairs(records, 300)
    met = pairs.filter("substring(a, 1, 1) = 'A' AND substring(b, 1, 1) = 'B' AND substring(a, 2, 6) = substring(b, 2, 6)").count()
    assert met >= 9_900
    assert people.entities(spark.createDataFrame(crowd(2_000), PLAIN), "crm_record_id").count() == 2_000


def test_copies_are_one_text(spark):
    """Copies follow their text; copies that say too little stay apart; links count different texts."""
    given = [("A1", "Ann Novadow", "ann@x.test", None, None), ("A2", "Ann  NOVADOW", "ann@x.test", None, None), ("A3", "Anne Novadow", "ann@x.test", None, None)]
    given += [(f"B{k}", "Just Name", None, None, None) for k in range(3)] + [(f"D{k}", None, None, None, None) for k in range(2)]
    given += [(f"E{k}", "One Firm Here", "firm@x.test", "2125550101", "12345") for k in range(50)] + [("A1", "Ann Novadow", "ann@x.test", None, None), (None, "Ann Novadow", "ann@x.test", None, None)]
    got = {r["crm_record_id"]: (r["entity_id"], r["links"]) for r in people.entities(spark.createDataFrame(given, PLAIN), "crm_record_id").collect()}
    assert got["A1"] == got["A2"] == got["A3"] == ("A1", 1)
    assert all(got[k] == (k, 0) for k in ("B0", "B1", "B2", "D0", "D1"))
    assert all(got[f"E{k}"] == ("E0", 0) for k in range(50)) and len(got) == 3 + 3 + 2 + 50
