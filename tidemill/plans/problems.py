"""Queries of the two general problems: repeated deliveries and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.delivery import PLAY_ORDER, deliver_once, historical_plays, play_identifier, surplus_copies
from tidemill.operators.sessions import sweep_sessions
from tidemill.plans.registry import Registry
from tidemill.sources.tables import Tables

R = Registry()

_RANKED = """
SELECT *, row_number() OVER (
    PARTITION BY user_name, scrobbled_at_uts, lower(trim(artist)), lower(trim(track)), coalesce(lower(trim(album)), '')
    ORDER BY ingested_at NULLS LAST, run_id NULLS LAST, source_page NULLS LAST, source_position NULLS LAST, observation_id) AS copy_rank
FROM bronze_scrobbles WHERE scrobbled_at_uts IS NOT NULL AND NOT coalesce(is_now_playing, false)
"""


@R.query("p1_found", f"SELECT observation_id FROM ({_RANKED}) WHERE copy_rank > 1")
def p1_found(t: Tables) -> DataFrame:
    """Observations that must go."""
    return surplus_copies(historical_plays(t.bronze_scrobbles), play_identifier(), PLAY_ORDER, "observation_id").select("observation_id")


@R.query(
    "p1_delivered_once",
    f"SELECT observation_id, user_name, scrobbled_at_uts, artist, track, album, run_id, epoch_us(ingested_at) AS ingested_at_us FROM ({_RANKED}) WHERE copy_rank = 1",
)
def p1_delivered_once(t: Tables) -> DataFrame:
    """Exactly one observation of each play."""
    once = deliver_once(historical_plays(t.bronze_scrobbles), play_identifier(), PLAY_ORDER, "observation_id")
    return once.select("observation_id", "user_name", "scrobbled_at_uts", "artist", "track", "album", "run_id", F.unix_micros("ingested_at").alias("ingested_at_us"))


_SESSIONS = """
WITH plays AS (
    SELECT user_name, scrobble_id, min(scrobbled_at_local) AS t FROM fact_scrobble
    WHERE scrobbled_at_local IS NOT NULL AND scrobble_id IS NOT NULL GROUP BY ALL),
flagged AS (
    SELECT *, CASE WHEN t - lag(t) OVER w > INTERVAL 30 MINUTE OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS starts
    FROM plays WINDOW w AS (PARTITION BY user_name ORDER BY t, scrobble_id)),
numbered AS (
    SELECT *, sum(starts) OVER (PARTITION BY user_name ORDER BY t, scrobble_id ROWS UNBOUNDED PRECEDING) AS no FROM flagged),
sessions AS (
    SELECT user_name, arg_min(scrobble_id, (t, scrobble_id)) AS first_scrobble_id, arg_max(scrobble_id, (t, scrobble_id)) AS last_scrobble_id,
           CAST(count(*) AS BIGINT) AS scrobble_count, min(t) AS session_start, max(t) AS session_end,
           (epoch_us(max(t)) - epoch_us(min(t))) / 1e6 AS duration_seconds
    FROM numbered GROUP BY user_name, no)
"""


def play_sessions(t: Tables) -> DataFrame:
    """Listening sessions of each user: more than 30 minutes without a play start a new one."""
    found = sweep_sessions(t.fact_scrobble, "user_name", "scrobbled_at_local", "scrobble_id")
    return found.withColumnsRenamed({"first_event_id": "first_scrobble_id", "last_event_id": "last_scrobble_id", "event_count": "scrobble_count"})


@R.query("p7_found", _SESSIONS + "SELECT user_name, first_scrobble_id, last_scrobble_id, scrobble_count FROM sessions")
def p7_found(t: Tables) -> DataFrame:
    """One row per session."""
    return play_sessions(t).select("user_name", "first_scrobble_id", "last_scrobble_id", "scrobble_count")


@R.query("p7_session_spans", _SESSIONS + "SELECT * FROM sessions")
def p7_session_spans(t: Tables) -> DataFrame:
    """Sessions with start, end and duration."""
    return play_sessions(t)
