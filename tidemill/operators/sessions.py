"""Sessions separated by gaps of inactivity, by sweep-line deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def sweep_sessions(events: DataFrame, user: str, at: str, event_id: str, gap_minutes: int = 30, bucket_micros: int = DAY) -> DataFrame:
    """One row per session: user, first/last event id, count of events, start, end, duration in seconds.

    Every event adds one to a running sum at its time and takes it off again `gap` later; where the sum is back at
    zero, the session is closed. At equal times the additions come first, so a gap of exactly `gap` doesn't split.

    The line is swept by user and bucket of time (a day, wider than the gap), not by user: a user with a third of all rows is
    spread over as many tasks as there are days. What a bucket needs from the one before is only the events whose
    subtraction falls into it; these travel as second rows. A bucket gives partial sessions; those open at an edge
    (two per user and day at most, whatever the number of events) are chained in a second, small window.

    Each event_id of a user counts once, at its earliest time. Rows with NULL time or id don't count; NULL users form one
    group. Order is (time, id). An empty table gives no rows; other columns of events are not read.
    """
    gap = gap_minutes * 60_000_000
    if not 0 < gap < bucket_micros:
        raise ValueError("the gap must be positive and shorter than the bucket")
    once = (
        events.filter(F.col(at).isNotNull() & F.col(event_id).isNotNull())
        .select(F.col(user).alias("u"), F.col(event_id).alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
        .groupBy("u", "id")
        .agg(F.min("t").alias("t"))
    )
    # own: the bucket holds the event itself; else only its subtraction.
    own, carried = F.floor(F.col("t") / F.lit(bucket_micros)), F.floor((F.col("t") + gap) / F.lit(bucket_micros))
    sent = once.select("u", "id", "t", F.explode(F.when(carried > own, F.array(own, carried)).otherwise(F.array(own))).alias("b"))
    placed = sent.repartition("u", "b").withColumn("own", F.floor(F.col("t") / F.lit(bucket_micros)) == F.col("b"))
    # The +1 and -1 rows of a bucket. A carried event was added before the bucket began: its +1 stands at the edge.
    edge = F.col("b") * F.lit(bucket_micros)
    plus = F.struct(F.when(F.col("own"), F.col("t")).otherwise(edge - 1).alias("at"), F.lit(1).alias("d"))
    minus = F.struct((F.col("t") + gap).alias("at"), F.lit(-1).alias("d"))
    deltas = placed.select(
        "u", "b", "id", "t", "own", F.explode(F.when(F.floor((F.col("t") + gap) / F.lit(bucket_micros)) == F.col("b"), F.array(plus, minus)).otherwise(F.array(plus))).alias("x")
    ).select("u", "b", "id", "t", "own", F.col("x.at").alias("at"), F.col("x.d").alias("d"))
    sweep = Window.partitionBy("u", "b").orderBy("at", F.col("d").desc(), "t", "id")
    summed = deltas.withColumn("level", F.sum("d").over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    closes = F.when((F.col("level") == 0) & (F.col("d") == -1), 1).otherwise(0)
    numbered = summed.withColumn("closes", closes).withColumn("no", F.sum("closes").over(sweep.rowsBetween(Window.unboundedPreceding, 0)) - F.col("closes"))
    played = (F.col("d") == 1) & F.col("own")
    place = F.struct("t", "id")
    partial = numbered.groupBy("u", "b", "no").agg(
        F.min(F.when(played, place)).alias("first"),
        F.max(F.when(played, place)).alias("last"),
        F.count(F.when(played, 1)).alias("n"),
        F.max(~F.col("own")).alias("open_left"),
        (F.max("closes") == 0).alias("open_right"),
    )
    # Closed partial sessions keep to their bucket; the open ones of a user meet and are chained.
    apart = F.when(F.col("open_left") | F.col("open_right"), F.lit(None)).otherwise(F.col("b"))
    chain = Window.partitionBy("u", "apart").orderBy("b", "no").rowsBetween(Window.unboundedPreceding, 0)
    chained = partial.withColumn("apart", apart).withColumn("g", F.sum(F.when(F.col("open_left"), 0).otherwise(1)).over(chain))
    whole = chained.groupBy("u", "apart", "g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return whole.select(
        F.col("u").alias(user),
        F.col("first.id").alias("first_event_id"),
        F.col("last.id").alias("last_event_id"),
        F.col("n").cast("long").alias("event_count"),
        F.timestamp_micros("first.t").cast("timestamp_ntz").alias("session_start"),
        F.timestamp_micros("last.t").cast("timestamp_ntz").alias("session_end"),
        ((F.col("last.t") - F.col("first.t")) / F.lit(1e6)).alias("duration_seconds"),
    )


def session_content(sessions: DataFrame, events: DataFrame, user: str, at: str, event_id: str, contents: list[str]) -> DataFrame:
    """sessions of sweep_sessions with session_number, session_id and, for each of contents, distinct_<name>: how many of it the session holds (Q12).

    Numbers count up from 1 within a user in order of start. Events find their session by user, day and time, so a user with a third of all rows is spread over days; a session
    stands under each day it touches, and of one user's sessions on a day only few overlap a given time: the bounds decide.
    NULL users form one group; NULL contents aren't counted.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    day = lambda c: F.floor(c / F.lit(DAY))
    known = sessions.select(F.col(user).alias("u"), "*", micros("session_start").alias("a"), micros("session_end").alias("b")).withColumn("key", F.xxhash64(F.col("u").isNull(), "u"))
    # Numbering in two steps: how many sessions a user's earlier days have, then the place within the day.
    daily = known.groupBy("key", day(F.col("a")).alias("d")).agg(F.count("*").alias("n"))
    before = daily.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("d")) - F.col("n")).select("key", "d", "before")
    numbered = known.withColumn("d", day(F.col("a"))).join(before, ["key", "d"])
    place = F.row_number().over(Window.partitionBy("key", "d").orderBy("a", "first_event_id"))
    numbered = numbered.withColumn("session_number", F.col("before") + place).drop("before", "d")
    once = events.filter(F.col(at).isNotNull() & F.col(event_id).isNotNull()).select(F.xxhash64(F.col(user).isNull(), user).alias("key"), micros(at).alias("t"), *contents)
    spans = numbered.select("key", "session_number", "a", "b", F.explode(F.sequence(day(F.col("a")), day(F.col("b")))).alias("d"))
    held = once.withColumn("d", day(F.col("t"))).join(spans, ["key", "d"]).filter("t BETWEEN a AND b").groupBy("key", "session_number").agg(*[F.count_distinct(c).alias(f"distinct_{c.removesuffix('_id')}s") for c in contents])
    start = F.date_format("session_start", "yyyy-MM-dd HH:mm:ss")
    named = numbered.join(held, ["key", "session_number"]).withColumn("session_id", F.md5(F.concat(F.col("session_number").cast("string"), F.lit("|"), start)))
    return named.drop("key", "a", "b", "u")
