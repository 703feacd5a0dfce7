"""Common phones, addresses and zips lose no link and no match: blocks are cut into tiles, not capped."""

import itertools
import random
from datetime import datetime, timedelta

from tests.conftest import rows
from tests.llm.test_people import CRM, MKT, PLAIN, crowd
from tidemill.llm import linkage, people


def linked(pairs, records):
    return set(rows(people.same_person(people.compared(pairs, records, records)), "a", "b"))


def test_one_phone_loses_no_link(spark):
    """On a phone that all share, every link that comparing all pairs gives is found, whatever the size of a tile."""
    given = crowd(500) + [(f"N{k}", None, None, "2125550101", None) for k in range(3)] + [(f"O{k}", "Ann Bly-Novak", f"x{k}@y.test", "2125550101", f"{10000 + 997 * k}") for k in range(60)]
    records = people.prepared(spark.createDataFrame(given, PLAIN), "crm_record_id").cache()
    every = spark.createDataFrame(list(itertools.combinations(sorted(r[0] for r in given), 2)), "a string, b string")
    want = linked(every, records)
    assert len(want) >= 60 * 59 // 2 + 200
    assert linked(people.candidate_pairs(records, 20), records) == want == linked(people.candidate_pairs(records), records)


def test_marks_rule_out_no_link(spark):
    """Conditions of the passes hold for every pair that they are asked of and that is linked."""
    r = random.Random(5)
    slip = lambda w: (lambda i, c: r.choice([w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :]]))(r.randrange(1, len(w)), r.choice("aeiou" if w.isalpha() else "0123456789"))
    words = ["katherine", "william", "bill", "marenkova", "silultti", "schndale", "ann", "lee", "luiz", "nova", "k", "w", "christopherson", "kit"]
    out = []
    for k in range(400):
        name = " ".join(r.sample(words, r.randint(1, 4)))
        phone, code, mail = "".join(r.choice("0123456789") for _ in range(r.choice([7, 8, 9, 10, 10, 12]))), f"{r.randrange(100000):05}", f"{name.replace(' ', '.')}{r.choice(['', '7', '1984'])}@lumenmail.example"
        out.append((f"A{k:03}", name, mail, phone, code))
        out.append((f"B{k:03}", slip(name) if k % 3 and len(name) > 1 else name, slip(mail) if k % 2 else mail, slip(phone), slip(code)))
    records = people.prepared(spark.createDataFrame(out, PLAIN), "crm_record_id").cache()
    known = people.marked(records).cache()
    side = lambda s: known.select(*[known[c].alias(f"{s}_{c}" if c != "id" else s) for c in ("id", *people._MARKS, "mail_mark", "phone_mark", "zip_mark")])
    both = side("a").crossJoin(side("b")).filter("substring(a, 2, 3) = substring(b, 2, 3) AND a < b")
    levels = people.compared(both.select("a", "b"), records, records).join(both, ["a", "b"])
    for level, mark, condition in (("name_level", None, people.NAMES_MAY), ("phone_level", "phone_mark", people.PHONES_MAY), ("mail_level", "mail_mark", people.MAILS_MAY), ("zip_level", "zip_mark", people.ZIPS_MAY)):
        agree = levels.filter(f"{level} >= 1")
        assert agree.count() > 100
        of = agree if mark is None else agree.withColumnsRenamed({f"a_{mark}": "a_v", f"b_{mark}": "b_v"})
        assert of.filter(f"NOT ({condition})").count() == 0


def test_swapped_phones_meet(spark):
    """Phones within a slip or a swap share a key of the pass of phones."""
    phones = ["2125550199", "9125550192", "2125550919", "212555019", "21255501999", "5550199", "555019", "5559019", "2125559109", "21255501", "21955501"]
    df = spark.createDataFrame([(f"P{k:02}", "Ann Novak", None, p, None) for k, p in enumerate(phones)], PLAIN)
    records = people.prepared(df, "crm_record_id").cache()
    every = spark.createDataFrame(list(itertools.combinations([f"P{k:02}" for k in range(len(phones))], 2)), "a string, b string")
    assert linked(people.candidate_pairs(records, 1), records) == linked(every, records)


def test_common_key_of_enquiries_loses_no_candidate(spark):
    """Enquiries on one phone within a few days: every pair that shares it is a candidate, also where nothing else is alike."""
    r = random.Random(2)
    at = lambda k: datetime(2024, 1, 1) + timedelta(hours=k % 48)
    word = lambda: "".join(r.choice("bcdfgklmnprstv") + r.choice("aeiou") for _ in range(3)).capitalize()
    crm = [(f"C{k:03}", at(k), f"{word()} {word()}", f"{word()}{k}@a.test", "2125550101", f"{r.randrange(100000):05}", "s", 1) for k in range(350)]
    mkt = [(f"M{k:03}", at(k), f"{word()} {word()}", f"{word()}{k}@b.test", "2125550101", f"{r.randrange(100000):05}", "s") for k in range(350)]
    a = linkage.numbered(people.prepared(spark.createDataFrame(crm, CRM).withColumnRenamed("created_at", "at"), "crm_record_id", "service", "at"))
    b = linkage.numbered(people.prepared(spark.createDataFrame(mkt, MKT).withColumnRenamed("captured_at", "at"), "marketing_record_id", "service", "at"))
    assert linkage.candidates(a, b).count() == 350 * 350
    assert linkage.candidates(a, b, 100).count() == 350 * 350
