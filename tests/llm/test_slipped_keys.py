"""Links of abbreviated or misspelt names that differ by a slip in another field too are compared at all."""

import itertools

from tests.conftest import rows
from tidemill.llm import people

FIELDS = "crm_record_id string, name string, email string, phone string, zip_code string"
# Pairs of records, the first two letters of the id name the pair.
RECORDS = [
    ("aa1", "Christopher Ostasen", "ostasenruth@netnook.test", "8200096795", "87885"), ("aa2", "C Ostasen", "ostasenruth@netnok.test", "8100096795", "87885"),
    ("bb1", "Michael Peleca", "michaelpeleca43@lumenmail.example", None, "44917"), ("bb2", "M Peleca", None, "5030276119", "44917"),
    ("cc1", "Antonio Casowick", "antoniocasowick@oakpost.test", "5701640763", "60912"), ("cc2", "Antonio Casawick", "antoniocasawick@oakpost.test", "7261720968", "73209"),
    ("dd1", "William Quelandow", "williamquelandow@lumenmail.example", "3681681467", None), ("dd2", "Will Quelandow", None, "3681861467", "65688"),
    ("ee1", "Luiz Rudormont", None, "2601402046", "72124"), ("ee2", "Rudormont L", "lrudormont@postbrook.example", "9601402046", None),
]


def test_slipped_links_equal_all_pairs(spark):
    df = spark.createDataFrame(RECORDS, FIELDS)
    records = people.prepared(df, "crm_record_id")
    every = spark.createDataFrame([p for p in itertools.combinations(sorted(r[0] for r in RECORDS), 2)], "a string, b string")
    want = rows(people.same_person(people.compared(every, records, records)), "a", "b")
    assert want == [(f"{k}1", f"{k}2") for k in ("aa", "bb", "cc", "dd", "ee")]
    assert rows(people.entity_links(df, "crm_record_id")) == want
