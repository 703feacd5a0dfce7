"""Candidates of problem 6 leave out only pairs with another mailbox that agree in no field outright."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import rows
from tests.llm.test_people import CRM, MKT
from tidemill.llm import linkage, people

T0 = datetime(2024, 1, 1)


def tables(spark, crm, mkt):
    a = linkage.numbered(people.prepared(spark.createDataFrame(crm, CRM).withColumnRenamed("created_at", "at"), "crm_record_id", "service", "at"))
    b = linkage.numbered(people.prepared(spark.createDataFrame(mkt, MKT).withColumnRenamed("captured_at", "at"), "marketing_record_id", "service", "at"))
    return a, b


def test_strangers_of_one_first_name_are_no_candidates(spark):
    """One first name and one beginning of the zip, all else different: none of the 3,600 pairs is made."""
    at = lambda k: T0 + timedelta(hours=k % 48)
    crm = [(f"C{k:02}", at(k), f"Rebecca {'bdfg'[k % 4]}{'aeiou'[k % 5]}ppo", f"x{k}@a.test", f"21255{k:05}", f"201{k:02}", "s", 1) for k in range(60)]
    mkt = [(f"M{k:02}", at(k), f"Rebecca {'ntrs'[k % 4]}{'aeiou'[k % 5]}lkenhurst", f"y{k + 100}@b.test", f"97833{k:05}", f"209{k:02}", "s") for k in range(60)]
    assert linkage.candidates(*tables(spark, crm, mkt)).count() == 0


def test_all_that_agree_outright_are_candidates(spark):
    """Of all pairs within six days that share a key, those with an outright agreement or a missing mailbox are candidates, whatever the size of a tile; times lie about the edges of spans."""
    r = random.Random(4)
    slip = lambda w: (lambda i: w[:i] + r.choice("aeiou") + w[i + 1 :])(r.randrange(1, len(w)))
    first, last = ["Katherine", "William", "Bill", "Rebecca", "Luiz", "K"], ["Marenkova", "Silultti", "Schndale", "Novadow", "Casowick"]
    crm, mkt = [], []
    for k in range(120):
        name, mail, phone, code = f"{r.choice(first)} {r.choice(last)}", f"{r.choice(last)}{r.randrange(40)}@x.test".lower(), f"21255{r.randrange(40):05}", f"201{r.randrange(20):02}"
        at = datetime(2024, 1, 1) + timedelta(days=r.choice([0, 5.9, 6, 12, 18, 24, 30]), seconds=r.randrange(3) - 1)
        crm.append((f"C{k:03}", at, name, mail if k % 4 else None, phone, code, "s", 1))
        mkt.append((f"M{k:03}", at + timedelta(days=r.choice([-6, -3, 0, 0, 3, 6])), slip(name) if k % 3 else name, slip(mail) if k % 2 else mail, phone if k % 5 else None, code if k % 7 else None, "s"))
    a, b = tables(spark, crm, mkt)
    near = a.select(F.col("no").alias("a"), F.col("at").alias("s"), F.col("keys").alias("k")).crossJoin(b.select(F.col("no").alias("b"), F.col("at").alias("t"), F.col("keys").alias("l"))).filter("arrays_overlap(k, l) AND abs(unix_micros(cast(s AS timestamp)) - unix_micros(cast(t AS timestamp))) <= 6L * 86400000000")
    by_no = lambda df: df.withColumn("id", F.col("no"))
    outright = "mail_level <> 0 OR name_level >= 3 OR phone_level = 2 OR zip_level = 2"
    plain = set(rows(people.compared(near.select("a", "b"), by_no(a), by_no(b)).filter(outright), "a", "b"))
    assert 200 < len(plain) < near.count()
    for tile in (20, people.TILE):
        met = linkage.candidates(a, b, tile)
        assert plain <= set(rows(met, "a", "b"))
        # By their marks, names go to Python only if they may agree: the levels are the same.
        levels = lambda *more: rows(people.compared(met, by_no(a), by_no(b), *more).select("a", "b", "name_level", "name_ratio", "mail_level", "phone_level", "zip_level"))
        assert levels() == levels(*people._MARKS)
