"""Seeded synthetic leads: every value is a function of seed, row and field, so any partition gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sources with their shares, and services.
SOURCES = [("Google", 0.38), ("Organic", 0.24), ("Facebook", 0.20), ("Direct", 0.18)]
SERVICES = ["interior painting", "exterior painting", "drywall repair", "deck staining"]
SYLLABLES = ["ba", "ne", "ro", "li", "du", "ka", "mi", "so", "ta", "ve"]


def uniform(seed: int, field: str, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of seed, field and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(field), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def pick(u: Column, weighted: list[tuple[str, float]]) -> Column:
    """The value whose share of the cumulated weights holds u."""
    total, upto, out = sum(w for _, w in weighted), 0.0, None
    for value, w in weighted[:-1]:
        upto += w / total
        out = F.when(u < upto, value) if out is None else out.when(u < upto, value)
    return out.otherwise(weighted[-1][0]) if out is not None else F.lit(weighted[0][0])


def customers(spark: SparkSession, n: int, seed: int = 20260907) -> DataFrame:
    """customer_id, name, email, phone, zip_code; e-mail and phone are unique as they hold the number of the row."""
    base = spark.range(n).withColumnRenamed("id", "k")
    part = lambda f, j: F.element_at(F.array(*map(F.lit, SYLLABLES)), (F.floor(uniform(seed, f"{f}{j}", F.col("k")) * len(SYLLABLES)) + 1).cast("int"))
    first, last = (F.initcap(F.concat(*[part(f, j) for j in range(3)])) for f in ("first", "last"))
    return base.select(
        F.format_string("CUST%07d", F.col("k") + 1).alias("customer_id"), F.concat_ws(" ", first, last).alias("name"), F.lower(F.concat(first, F.lit("."), last, F.col("k").cast("string"), F.lit("@mail.example"))).alias("email"),
        F.format_string("2%09d", F.pmod(F.col("k") * 7919 + F.floor(uniform(seed, "phone", F.lit(0)) * 1e6), F.lit(1_000_000_000))).alias("phone"), F.format_string("%05d", (F.floor(uniform(seed, "zip", F.col("k")) * 90000) + 10000).cast("int")).alias("zip_code"),
    )


def leads(people: DataFrame, start: str, days: int, seed: int = 20260907, most: int = 3, gap_days: int = 14) -> DataFrame:
    """One to `most` leads of each customer, at least gap_days apart, those after the end left out."""
    count = F.floor(uniform(seed, "count", F.col("customer_id")) * most).cast("int")
    each = people.withColumn("n", F.explode(F.sequence(F.lit(0), count)))
    u = lambda f: uniform(seed, f, F.col("customer_id"), F.col("n"))
    first = uniform(seed, "first", F.col("customer_id")) * days
    # A later lead follows the first by whole gaps and a part of one that it doesn't share.
    day = first + F.col("n") * (gap_days * 2) + F.when(F.col("n") > 0, u("later") * gap_days * 0.99).otherwise(0.0)
    at = (F.unix_micros(F.to_timestamp(F.lit(start))) + (F.floor(day) * 86_400 + F.floor((8 + u("hour") * 12) * 3600)) * 1_000_000).cast("long")
    return each.filter(day < days).select(
        F.concat(F.regexp_replace("customer_id", "CUST", "LEAD"), F.lit("-"), F.col("n").cast("string")).alias("lead_id"), "customer_id", F.timestamp_micros(at).cast("timestamp_ntz").alias("created_at"),
        pick(u("source"), SOURCES).alias("source"), F.element_at(F.array(*map(F.lit, SERVICES)), (F.floor(u("service") * len(SERVICES)) + 1).cast("int")).alias("service"), "name", "email", "phone", "zip_code",
    )


def corrupted(rows: DataFrame, key: str, rates: dict[str, float], seed: int = 20260907) -> tuple[DataFrame, DataFrame]:
    """(rows with damaged name, email, phone and zip_code, log of what was changed): Z05, Z06.

    rates: share of rows damaged by field. The log has one row for each changed value: key, field, before, after.
    """
    damage = {
        "name": lambda c: F.upper(c),
        "email": lambda c: F.lit(None).cast("string"),
        "phone": lambda c: F.concat(F.lit("("), F.substring(c, 1, 3), F.lit(") "), F.substring(c, 4, 3), F.lit("-"), F.substring(c, 7, 4)),
        "zip_code": lambda c: F.concat(F.substring(c, 1, 4)),
    }
    hit = {f: uniform(seed, f"damage {f}", F.col(key)) < rates.get(f, 0.0) for f in damage}
    changed = rows.withColumns({f"_{f}": F.when(hit[f], fn(F.col(f))).otherwise(F.col(f)) for f, fn in damage.items()})
    entries = F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("before"), F.col(f"_{f}").alias("after"), hit[f].alias("hit")) for f in damage]), lambda e: e["hit"]))
    log = changed.select(key, entries.alias("e")).select(key, "e.field", "e.before", "e.after")
    return changed.withColumns({f: F.col(f"_{f}") for f in damage}).drop(*[f"_{f}" for f in damage]), log


def spend(lead_rows: DataFrame, start: str, days: int, seed: int = 20260907) -> DataFrame:
    """One row for each paid source and day with spend, clicks and conversions, none negative."""
    calendar = lead_rows.sparkSession.range(days).select(F.date_add(F.to_date(F.lit(start)), F.col("id").cast("int")).alias("date"))
    paid = lead_rows.sparkSession.createDataFrame([("Google", 120.0), ("Facebook", 75.0)], "source string, cost double")
    won = lead_rows.groupBy(F.col("created_at").cast("date").alias("date"), "source").agg(F.count("*").alias("leads"))
    grid = calendar.crossJoin(F.broadcast(paid)).join(won, ["date", "source"], "left").na.fill(0, ["leads"])
    u = uniform(seed, "spend", F.col("date"), F.col("source"))
    money = F.round(F.col("cost") * (0.5 + u) * (1 + F.col("leads")), 2)
    return grid.select("date", "source", money.alias("spend"), F.floor(money / 3 * (0.8 + u)).alias("clicks"), F.greatest(F.lit(0), F.col("leads") - (u > 0.9).cast("long")).alias("platform_conversions"))
