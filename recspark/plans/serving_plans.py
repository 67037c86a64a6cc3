"""Query plans for serving tables and model monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.operators import monitor, scoring, serving
from recspark.plans.registry import register
from recspark.plans.scoring_plans import _POP_KNOWN, _topn_sql
from recspark.sources import (global_mean, item_factors_view, prediction_log_view, ratings_view,
                              request_log_view, user_factors_view)
from recspark.session import scratch_path

SV = ["ratings", "user_factors", "item_factors", "mu", "request_log"]

_KNOWN_REQ = "(SELECT DISTINCT user_id AS userId FROM request_log WHERE user_id IN (SELECT userId FROM user_factors))"
_GRP = ("CASE WHEN ('0x' || right(md5(cast(user_id AS VARCHAR) || '_default'), 1))::INT % 2 = 0 "
        "THEN 'treatment' ELSE 'control' END")


_SERVED = f"""
SELECT user_id, movieId, score, rank, strategy, 10::BIGINT AS n, {_GRP} AS experiment_group FROM (
  SELECT userId AS user_id, movieId, predicted_rating AS score, rank, 'collaborative_filtering' AS strategy
  FROM ({_topn_sql("AND NOT EXISTS (SELECT 1 FROM ratings r WHERE r.userId = u.userId AND r.movieId = i.movieId)",
                   10, _KNOWN_REQ)}) cf
  UNION ALL
  SELECT u.user_id, p.movieId, p.score, p.rank, 'popular_fallback'
  FROM (SELECT DISTINCT user_id FROM request_log WHERE user_id NOT IN (SELECT userId FROM user_factors)) u
  CROSS JOIN ({_POP_KNOWN}) p) s"""


@register("serve_batch", _SERVED, SV, round_cols=["score"], bigint_cols=["rank"])
def serve_batch(spark, sf):
    """V1: materialised top-10 with strategy and experiment group for every requesting user."""
    ratings = ratings_view(spark, sf, persist=True)
    uf, itf = user_factors_view(spark, sf, ratings), item_factors_view(spark, sf)
    popular = scoring.popular_items(ratings, 10, items=itf)
    return serving.serve_batch(request_log_view(spark, sf), uf, itf, global_mean(ratings), popular, 10,
                               seen=ratings.select("userId", "movieId"))


@register("serve_refresh", _SERVED, SV, round_cols=["score"], bigint_cols=["rank"])
def serve_refresh(spark, sf):
    """V1 refresh: the table of the first half of the log, without the last 90
    days' ratings, then only the users refreshed who have new ratings or are new
    to the log; the same rows as serve_batch over everything."""
    ratings = ratings_view(spark, sf, persist=True)
    log = request_log_view(spark, sf)
    # the model stays as it is between refreshes
    uf, itf, mu = user_factors_view(spark, sf, ratings), item_factors_view(spark, sf), global_mean(ratings)
    recent = F.col("timestamp") > ratings.agg(F.max("timestamp")).first()[0] - 90 * 86400
    at = F.col("ts").cast("timestamp").cast("double")
    first, last = log.agg(F.min(at), F.max(at)).first()
    everyone = log.select(F.col("user_id").alias("userId")).distinct()
    known = (log.where(at <= (first + last) / 2)
             .select(F.col("user_id").alias("userId")).distinct())
    old = ratings.where(~recent)
    path = scratch_path(spark, "served")
    serving.write_served(path, known, uf, itf, mu, scoring.popular_items(old, 10, items=itf), 10,
                         seen=old.select("userId", "movieId"))
    changed = (everyone.join(known, "userId", "left_anti")
               .unionByName(known.join(ratings.where(recent).select("userId"), "userId", "left_semi")))
    serving.refresh_served(path, changed, uf, itf, mu, scoring.popular_items(ratings, 10, items=itf), 10,
                           seen=ratings.select("userId", "movieId"))
    return serving.read_served(spark, path)


_CLASSIFIED = """
cl AS (SELECT *, coalesce(sum(CASE WHEN NOT is_error THEN 1 ELSE 0 END) OVER (
                   PARTITION BY user_id, n, experiment_group ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS cache_hit
       FROM request_log),
cl2 AS (SELECT *, NOT cache_hit AS cache_miss, NOT cache_hit AND is_error AS error,
               NOT cache_hit AND NOT is_error AND user_id NOT IN (SELECT userId FROM user_factors) AS cold_start_fallback,
               NOT cache_hit AND NOT is_error AS latency_update
        FROM cl)"""
_METRICS = """
SELECT {by} count(*) AS requests, sum(cache_hit::INT)::BIGINT AS cache_hits, sum(cache_miss::INT)::BIGINT AS cache_misses,
       sum(error::INT)::BIGINT AS errors, sum(cold_start_fallback::INT)::BIGINT AS cold_start_fallbacks,
       CASE WHEN count(*) > 0 THEN sum(cache_hit::INT) / count(*)::DOUBLE ELSE 0.0 END AS cache_hit_rate,
       CASE WHEN count(*) > 0 THEN sum(error::INT) / count(*)::DOUBLE ELSE 0.0 END AS error_rate
FROM cl2 {group}"""


def _classified(spark, sf):
    ratings = ratings_view(spark, sf, persist=True)
    uf = user_factors_view(spark, sf, ratings)
    return serving.classify_requests(request_log_view(spark, sf), uf)


@register("request_metrics", "WITH " + _CLASSIFIED + _METRICS.format(by="", group=""), SV,
          round_cols=["cache_hit_rate", "error_rate"])
def request_metrics(spark, sf):
    """V2: request counters and rates over the whole request log."""
    return serving.request_metrics(_classified(spark, sf))


@register("request_metrics_daily", "WITH " + _CLASSIFIED + _METRICS.format(
    by="strftime(ts, '%Y-%m-%d') AS day, experiment_group,", group="GROUP BY 1, 2"), SV,
          round_cols=["cache_hit_rate", "error_rate"])
def request_metrics_daily(spark, sf):
    """V2 by day and experiment group."""
    c = _classified(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return serving.request_metrics(c, by=["day", "experiment_group"])


_EMA = """
sm AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS rn, latency_ms FROM cl2 WHERE latency_update),
ema(rn, v) AS (SELECT 0::BIGINT, 0.0::DOUBLE
               UNION ALL
               SELECT s.rn, CASE WHEN e.v = 0 THEN s.latency_ms ELSE 0.1e0 * s.latency_ms + 0.9e0 * e.v END
               FROM ema e JOIN sm s ON s.rn = e.rn + 1),
ema_last AS (SELECT v AS avg_latency_ms, (SELECT count(*) FROM sm) AS n_updates FROM ema
             WHERE rn = (SELECT max(rn) FROM ema))"""


@register("latency_ema", "WITH RECURSIVE " + _CLASSIFIED + "," + _EMA + " SELECT * FROM ema_last", SV,
          round_cols=["avg_latency_ms"])
def latency_ema(spark, sf):
    """EMA (alpha 0.1) of latency over successful cache misses."""
    return serving.latency_ema(_classified(spark, sf))


@register("health_status", "WITH RECURSIVE " + _CLASSIFIED + "," + _EMA + f""",
m AS ({_METRICS.format(by="", group="")})
SELECT CASE WHEN m.error_rate < 0.05 AND e.avg_latency_ms < 100 THEN 'healthy' ELSE 'unhealthy' END AS status,
       TRUE AS model_loaded, m.requests, m.error_rate, e.avg_latency_ms
FROM m, ema_last e""", SV, round_cols=["error_rate", "avg_latency_ms"])
def health_status(spark, sf):
    """V4: health from error rate and latency average."""
    c = _classified(spark, sf)
    return serving.health_status(serving.request_metrics(c), serving.latency_ema(c))


_BATCHES = """
WITH pl AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY ts, user_id, movie_id) - 1 AS pos
            FROM prediction_log WHERE actual IS NOT NULL),
b AS (SELECT model_id, floor(pos / 100)::BIGINT AS batch, count(*) AS n, max(ts) AS batch_end_ts,
             avg(abs(predicted - actual)) AS batch_mae
      FROM pl GROUP BY 1, 2 HAVING count(*) = 100),
d AS (SELECT model_id, batch, n, batch_end_ts, batch_mae, 1.1e0 AS baseline_mae,
             (batch_mae - 1.1e0) / 1.1e0 * 100.0 AS degradation_pct, (batch_mae - 1.1e0) / 1.1e0 > 0.1 AS alert
      FROM b)"""


def _batches(spark, sf):
    log = prediction_log_view(spark, sf, ratings_view(spark, sf, persist=True))
    return monitor.degradation_batches(log, monitor.baselines(log, 1.1), 100, 0.1)


@register("degradation_batches", _BATCHES + " SELECT * FROM d", ["ratings", "prediction_log"],
          round_cols=["batch_mae", "baseline_mae", "degradation_pct"])
def degradation_batches(spark, sf):
    """V5/V6 + W7: MAE of each full batch of 100 predictions per model vs a 1.1 baseline."""
    return _batches(spark, sf)


@register("degradation_alerts", _BATCHES + """
SELECT model_id, batch, batch_end_ts AS "timestamp", 'MAE' AS metric, baseline_mae AS baseline,
       batch_mae AS current, degradation_pct,
       printf('Model degradation detected! MAE increased by %.1f%%', degradation_pct) AS message
FROM d WHERE alert""", ["ratings", "prediction_log"], round_cols=["baseline", "current", "degradation_pct"])
def degradation_alerts(spark, sf):
    """V7: alerts raised (degradation above 10 %)."""
    return monitor.degradation_alerts(_batches(spark, sf))
