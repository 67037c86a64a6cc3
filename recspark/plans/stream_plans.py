"""Streaming query plans (T1, T2).  Each replays a table derived from the
benchmark tables as a time-ordered file feed: time ranges are appended one
after another and the stream is advanced (availableNow) after each, so state
is carried across micro-batches through the checkpoint.  Their results must
equal the batch operators, so they share the batch oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.plans.registry import ORACLE, register
from recspark.plans.serving_plans import SV, _BATCHES, _CLASSIFIED, _EMA, _METRICS
from recspark.session import scratch_path
from recspark.sources import load_table, prediction_log_view, request_log_view
from recspark.streaming import monitor_stream as ms

CHUNKS = 4


@register("stream_degradation_batches", _BATCHES + " SELECT * FROM d", ["ratings", "prediction_log"],
          round_cols=["batch_mae", "baseline_mae", "degradation_pct"])
def stream_degradation_batches(spark, sf):
    """Streaming batches of 100 per model with O(1) state; equals V6."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("pred_feed", "pred_batches", "pred_ckpt"))
    out = None
    for part in ms.time_chunks(prediction_log_view(spark, sf), "ts", CHUNKS):
        part.write.mode("append").parquet(src)
        out = ms.degradation_stream(spark, src, sink, ckpt, baseline=1.1)
    return out


def _classified_stream(spark, sf):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("req_feed", "req_classified", "req_ckpt"))
    out = None
    for part in ms.time_chunks(request_log_view(spark, sf), "ts", CHUNKS):
        part.write.mode("append").parquet(src)
        out = ms.request_classification_stream(spark, src, sink, ckpt)
    return sink, out


@register("stream_request_metrics_daily", "WITH " + _CLASSIFIED + _METRICS.format(
    by="strftime(ts, '%Y-%m-%d') AS day,", group="GROUP BY 1").replace(
        ", sum(cold_start_fallback::INT)::BIGINT AS cold_start_fallbacks", "").replace(
        """,
       CASE WHEN count(*) > 0 THEN sum(cache_hit::INT) / count(*)::DOUBLE ELSE 0.0 END AS cache_hit_rate,
       CASE WHEN count(*) > 0 THEN sum(error::INT) / count(*)::DOUBLE ELSE 0.0 END AS error_rate""", ""),
          SV)
def stream_request_metrics_daily(spark, sf):
    """Streaming cache classification, then daily windowed counters with a watermark."""
    classified_dir, _ = _classified_stream(spark, sf)
    sink, ckpt = scratch_path(spark, "req_daily"), scratch_path(spark, "req_daily_ckpt")
    daily = ms.request_metrics_stream(spark, classified_dir, sink, ckpt, "1 hour", "1 day")
    return daily.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "requests",
                        "cache_hits", "cache_misses", "errors")


@register("stream_latency_ema", "WITH RECURSIVE " + _CLASSIFIED + "," + _EMA + " SELECT * FROM ema_last", SV,
          round_cols=["avg_latency_ms"])
def stream_latency_ema(spark, sf):
    """Latency EMA folded by a streaming state; equals V3."""
    classified_dir, _ = _classified_stream(spark, sf)
    sink, ckpt = scratch_path(spark, "ema"), scratch_path(spark, "ema_ckpt")
    res = ms.latency_ema_stream(spark, classified_dir, sink, ckpt)
    return res.select("avg_latency_ms", "n_updates")


@register("stream_user_sessions", """
WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
f AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS session_index FROM e)
SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS length_seconds
FROM f GROUP BY user_id, session_index""", [], round_cols=["length_seconds"], bigint_cols=["n_events"])
def stream_user_sessions(spark, sf):
    """Sessions closed by a watermark; equals user_sessions.  An event of
    nobody after the last one closes the sessions that are open at the end."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("event_feed", "sessions", "sessions_ckpt"))
    events = load_table(spark, sf, "events").select("user_id", "ts")
    for part in ms.time_chunks(events, "ts", CHUNKS):
        part.write.mode("append").parquet(src)
        ms.session_stream(spark, src, sink, ckpt)
    last = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(None).cast("long").alias("user_id"), "ts")
    last.write.mode("append").parquet(src)
    out, _ = ms.session_stream(spark, src, sink, ckpt)
    return out.where("user_id IS NOT NULL")


__all__ = ["ORACLE"]
