"""Records of two tables without a shared key: probabilistic linkage with a confidence for each match."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import people
from tidemill.session import cut, release

#: Days within which two records may belong to one enquiry.
WITHIN_DAYS = 6
FIELDS = ["name_level", "mail_level", "phone_level", "zip_level", "service_level", "gap_level"]


def fit_levels(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior match probability of each pattern of agreement levels (-1: not comparable), by expectation-maximisation.

    Fields are taken as independent given match or non-match. start: first guess of each pattern's posterior.
    """
    posterior = start.astype(float)
    for _ in range(rounds):
        m, u = posterior * counts, (1 - posterior) * counts
        score = np.full(len(patterns), np.log((m.sum() + 1) / (u.sum() + 1)))
        for f in range(patterns.shape[1]):
            levels = np.unique(patterns[:, f][patterns[:, f] >= 0])
            known = patterns[:, f] >= 0
            for level in levels:
                at = patterns[:, f] == level
                pm = (m[at].sum() + 0.5) / (m[known].sum() + 0.5 * len(levels))
                pu = (u[at].sum() + 0.5) / (u[known].sum() + 0.5 * len(levels))
                score[at] += np.log(pm / pu)
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(new - posterior).max(initial=0) < 1e-7:
            break
        posterior = new
    return posterior


def numbered(records: DataFrame) -> DataFrame:
    """Records with a time, a number `no` each, their marks and keys."""
    return cut(people.near_keys(people.with_marks(records.filter(F.col("at").isNotNull()))))


#: False only for two records with another mailbox that agree in no field outright: their names don't agree but for spelling, nor are phone or zip equal.
OUTRIGHT_MAY = f"(a_v IS NULL OR b_v IS NULL OR {people.MAILS_MAY} OR a_phone = b_phone OR a_zip = b_zip OR {people.NAMES_AGREE})"


def candidates(crm: DataFrame, marketing: DataFrame, tile: int = people.TILE) -> DataFrame:
    """Distinct (a, b), numbers of all records of the two numbered tables that share a key of any pass, lie within WITHIN_DAYS of each other and, by their marks, may agree in a field outright.

    The passes are those of people.near_keys, each met within spans of four times WITHIN_DAYS: a span is part of the key, and a record of the second table stands in every span that
    it is near to. No block is capped, see people.meet; the result is the same for any tile.
    """
    width = WITHIN_DAYS * 86_400_000_000
    at = F.unix_micros(F.col("at").cast("timestamp"))
    span = lambda t: F.floor(t / F.lit(4 * width))
    marks = [F.col("mail_mark").alias("v"), *people._MARKS, F.when(F.col("phone").isNotNull(), F.xxhash64("phone")).alias("phone"), F.col("zip").cast("int").alias("zip")]
    of = lambda df, n, spans: df.withColumn("key", F.explode("keys")).select("key", "no", F.lit(n).alias("of"), at.alias("at"), *marks, F.explode(spans).alias("span"))
    rows = of(crm, 0, F.array(span(at))).unionByName(of(marketing, 1, F.array_distinct(F.array(span(at - width), span(at + width)))))
    return people.meet(rows.withColumn("key", F.xxhash64("key", "span")).drop("span"), f"abs(a_at - b_at) <= {width} AND {OUTRIGHT_MAY}", left="of = 0", right="of = 1", tile=tile)


def match_records(crm_leads: DataFrame, marketing_leads: DataFrame, least: float = 0.5) -> DataFrame:
    """(crm_record_id, marketing_record_id, confidence) of records that describe the same enquiry.

    With another mailbox, a match agrees in the name but for spelling, or in another field outright. Only counts of agreement patterns reach the driver; their number is bounded by the levels of the six fields. Records without an id or
    a time match none; missing fields count for neither side. Empty tables give no rows.
    """
    a = numbered(people.prepared(crm_leads.withColumn("at", F.col("created_at")), "crm_record_id", "service", "at"))
    b = numbered(people.prepared(marketing_leads.withColumn("at", F.col("captured_at")), "marketing_record_id", "service", "at"))
    by_no = lambda df: df.withColumn("record", F.col("id")).withColumn("id", F.col("no"))
    pairs = cut(candidates(a, b))
    release(pairs.sparkSession)
    both = people.compared(pairs, by_no(a), by_no(b), "record", "service", "at", *people._MARKS)
    service = F.when(F.col("a_service").isNull() | F.col("b_service").isNull(), -1).otherwise((F.lower(F.trim("a_service")) == F.lower(F.trim("b_service"))).cast("int"))
    hours = F.abs(F.unix_micros(F.col("a_at").cast("timestamp")) - F.unix_micros(F.col("b_at").cast("timestamp"))) / F.lit(3_600_000_000)
    gap = F.when(hours <= 3, 3).when(hours <= 24, 2).when(hours <= 72, 1).otherwise(0)
    # Near misses in every field with another mailbox are no match: the fields aren't independent there, as the model takes them to be.
    outright = (F.col("mail_level") != 0) | (F.col("name_level") >= 3) | (F.col("phone_level") == 2) | (F.col("zip_level") == 2)
    levels = cut(both.filter(outright).withColumn("service_level", service).withColumn("gap_level", gap).select("a_record", "b_record", "name_ratio", *FIELDS))
    guess = people.same_person(levels).groupBy(*FIELDS).count().withColumnRenamed("count", "same")
    table = levels.groupBy(*FIELDS).count().join(guess, FIELDS, "left").collect()
    if not table:
        return levels.select(F.col("a_record").alias("crm_record_id"), F.col("b_record").alias("marketing_record_id"), F.lit(None).cast("double").alias("confidence"))
    counts = np.array([r["count"] for r in table], float)
    start = np.clip(np.array([r["same"] or 0 for r in table]) / counts, 0.02, 0.98)
    posterior = fit_levels(np.array([[r[f] for f in FIELDS] for r in table]), counts, start)
    learned = levels.sparkSession.createDataFrame([(*[int(r[f]) for f in FIELDS], float(p)) for r, p in zip(table, posterior)], ", ".join(f"{f} int" for f in FIELDS) + ", confidence double")
    return levels.join(F.broadcast(learned), FIELDS).filter(F.col("confidence") >= least).select(F.col("a_record").alias("crm_record_id"), F.col("b_record").alias("marketing_record_id"), "confidence")
