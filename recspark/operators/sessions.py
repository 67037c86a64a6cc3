"""Sessionization that stays balanced when one user owns a third of the events.

A session ends after ``gap`` of inactivity.  ``session_window`` (and any
per-user window) sorts all events of a user in one task; here every step is
either an exact per-user position (range-partitioned, see ``ordering``), an
equi-join on a unique (user, position) key, or a partial aggregate:

1. number each user's events 0..n-1 in (ts, event_id) order,
2. join each event with its predecessor (user, pos - 1): a gap of at least
   ``gap`` (or no predecessor) starts a session,
3. number the session starts per user and join each start with the next one:
   a session ends just before the next start (or at the user's last event),
4. join the end position back to its timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.operators.ordering import global_positions


def _micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def sessions(events: DataFrame, user_col: str = "user_id", ts_col: str = "ts",
             tiebreak: str = "event_id", gap_seconds: float = 1800.0) -> DataFrame:
    """One row per session: user, session_index, start_ts, end_ts, n_events,
    length_seconds."""
    ev = events.select(F.col(user_col).alias("_u"), F.col(ts_col).alias("_ts"),
                       F.col(tiebreak).alias("_tb"))
    pos = global_positions(ev, ["_ts", "_tb"], by=["_u"], name="_pos")
    prev = pos.select("_u", (F.col("_pos") + 1).alias("_pos"), F.col("_ts").alias("_prev_ts"))
    flagged = pos.join(prev, ["_u", "_pos"], "left")
    gap_us = int(gap_seconds * 1_000_000)
    is_start = F.col("_prev_ts").isNull() | (
        (_micros("_ts") - _micros("_prev_ts")) >= F.lit(gap_us))
    starts = flagged.filter(is_start).select("_u", F.col("_pos").alias("_start"),
                                             F.col("_ts").alias("start_ts"))
    starts = global_positions(starts, ["_start"], by=["_u"], name="session_index")
    nxt = starts.select("_u", (F.col("session_index") - 1).alias("session_index"),
                        F.col("_start").alias("_next"))
    last = pos.groupBy("_u").agg(F.max("_pos").alias("_last"))
    bounds = (starts.join(nxt, ["_u", "session_index"], "left").join(last, "_u")
              .withColumn("_end", F.coalesce(F.col("_next") - 1, F.col("_last"))))
    ends = pos.select("_u", F.col("_pos").alias("_end"), F.col("_ts").alias("end_ts"))
    out = bounds.join(ends, ["_u", "_end"])
    return out.select(
        F.col("_u").alias(user_col), "session_index", "start_ts", "end_ts",
        (F.col("_end") - F.col("_start") + 1).alias("n_events"),
        ((_micros("end_ts") - _micros("start_ts")) / 1e6).alias("length_seconds"))
