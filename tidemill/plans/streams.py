"""Streaming queries, run over whole tables and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.maths import rounded
from tidemill.plans.registry import Registry
from tidemill.sources.tables import Tables
from tidemill.streaming import streams as S

R = Registry()


def stream_of(t: Tables, name: str) -> DataFrame:
    """The table's file as a stream."""
    like = getattr(t, name)
    return S.read_stream(t.spark, f"{t.folder}/{name}*.parquet", like)


@R.query("stream_dedup", "SELECT user_name, count(*) AS plays FROM (SELECT DISTINCT user_name, scrobbled_at_uts, lower(trim(artist)), lower(trim(track)), coalesce(lower(trim(album)), '') FROM bronze_scrobbles WHERE scrobbled_at_uts IS NOT NULL AND NOT coalesce(is_now_playing, false)) GROUP BY 1")
def stream_dedup(t: Tables) -> DataFrame:
    """The stream lets every play through once. A whole history is replayed, in whatever order its files come, so nothing in it is late."""
    once = S.run_available(S.plays_delivered_once(stream_of(t, "bronze_scrobbles"), "3650 days").select("user_name", "play_key"))
    return once.groupBy("user_name").agg(F.count("*").alias("plays"))


@R.query("stream_daily", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total FROM events GROUP BY ALL", dates=("day",))
def stream_daily(t: Tables) -> DataFrame:
    """T08; complete mode also gives out days that the watermark hasn't closed."""
    days = S.run_available_complete(S.daily_counts(stream_of(t, "events"), "ts", "event_type", "value"))
    return days.withColumn("total", rounded(F.col("total"), 4))


@R.query("stream_sessions", """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM f),
x AS (SELECT user_id, no, count(*) AS n FROM g GROUP BY ALL) SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM x GROUP BY 1""")  # fmt: skip
def stream_sessions(t: Tables) -> DataFrame:
    """T05; complete mode also gives out open sessions."""
    found = S.run_available_complete(S.user_sessions(stream_of(t, "events"), "user_id", "ts"))
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("event_count").alias("events"))
