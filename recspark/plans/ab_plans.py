"""Query plans for A/B assignment, tests, power planning and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.functions.hashing import ab_group
from recspark.operators import ab, metrics, prep, scoring
from recspark.plans.registry import register
from recspark.plans.stats_sql import TTEST_ROUND, simpson_p_sql, ttest_sql
from recspark.sources import (global_mean, item_factors_view, load_table, ratings_view,
                              user_factors_view)


def _grp_sql(col: str, salt: str) -> str:
    return (f"CASE WHEN ('0x' || right(md5(cast({col} AS VARCHAR) || '_{salt}'), 1))::INT % 2 = 0 "
            f"THEN 'treatment' ELSE 'control' END")


@register("ab_assignment", f"""
SELECT userId, {_grp_sql('userId', 'default')} AS group_default,
       {_grp_sql('userId', 'experiment_001')} AS group_experiment_001
FROM (SELECT DISTINCT userId FROM ratings) u""", ["ratings"])
def ab_assignment(spark, sf):
    """B1/B2: md5 assignment of every rating user for two experiment salts."""
    users = ratings_view(spark, sf).select("userId").distinct()
    return users.select("userId", ab_group(F.col("userId"), "default").alias("group_default"),
                        ab_group(F.col("userId"), "experiment_001").alias("group_experiment_001"))


def _user_mean_values(spark, sf):
    per_user = ratings_view(spark, sf).groupBy("userId").agg(F.avg("rating").alias("value"))
    return ab.assign_groups(per_user, "default").withColumn("metric", F.lit("avg_rating"))


_USER_MEAN_SQL = (f"SELECT 'avg_rating' AS metric, {_grp_sql('userId', 'default')} AS g, avg(rating) AS value "
                  "FROM ratings GROUP BY userId")


@register("ab_moments", f"""
SELECT metric, g AS experiment_group, count(value) AS n, avg(value) AS mean,
       var_samp(value) AS var_samp, var_pop(value) AS var_pop
FROM ({_USER_MEAN_SQL}) v GROUP BY metric, g""", ["ratings"],
          round_cols=["mean", "var_samp", "var_pop"])
def ab_moments(spark, sf):
    """B3 moments of per-user mean rating by md5 group (salt 'default')."""
    return ab.ab_moments(_user_mean_values(spark, sf), by=["metric"])


@register("ab_ttest", ttest_sql(_USER_MEAN_SQL), ["ratings"], round_cols=TTEST_ROUND)
def ab_ttest(spark, sf):
    """B3 + B4: t-test, lift, p-value, CI of per-user mean rating, treatment vs control."""
    return ab.ab_ttest(_user_mean_values(spark, sf), by=["metric"])


_Z = ab.z_constants(0.8, 0.05)
_ZZ = (_Z[0] + _Z[1]) ** 2


@register("power_plan", f"""
SELECT experiment_group, baseline_rate, mde,
       ceil({_ZZ!r} * (baseline_rate * (1 - baseline_rate) + baseline_rate * (1 + mde) * (1 - baseline_rate * (1 + mde)))
            / ((baseline_rate - baseline_rate * (1 + mde)) * (baseline_rate - baseline_rate * (1 + mde))))::BIGINT
         AS required_n_per_group
FROM (SELECT {_grp_sql('user_id', 'default')} AS experiment_group,
             avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS baseline_rate
      FROM events GROUP BY 1) r, (SELECT unnest([0.05, 0.1]) AS mde) m""", [],
          round_cols=["baseline_rate", "mde"])
def power_plan(spark, sf):
    """Sample size per group for purchase-rate baselines per experiment group."""
    ev = load_table(spark, sf, "events")
    rates = (ev.withColumn("experiment_group", ab_group(F.col("user_id"), "default"))
             .groupBy("experiment_group")
             .agg(F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("baseline_rate")))
    rates = rates.withColumn("mde", F.explode(F.array(F.lit(0.05), F.lit(0.1))))
    return ab.power_plan(rates, power=0.8, alpha=0.05)


def _model_errors(spark, sf):
    ratings = ratings_view(spark, sf, persist=True)
    uf, itf = user_factors_view(spark, sf, ratings), item_factors_view(spark, sf)
    test = prep.temporal_split(ratings).filter(F.col("split") == "test").select(
        "userId", "movieId", "rating")
    exp = scoring.predict_explicit(test, uf, itf, global_mean(ratings)).select(
        "userId", "movieId", "rating", F.col("predicted_rating").alias("explicit_pred"))
    imp = scoring.predict_implicit(test, uf, itf).select(
        "userId", "movieId", F.col("score").alias("implicit_pred"))
    j = exp.join(imp, ["userId", "movieId"])
    return j.select("userId", "movieId", "rating", "explicit_pred", "implicit_pred",
                    F.abs(F.col("explicit_pred") - F.col("rating")).alias("explicit_error"),
                    F.abs(F.col("implicit_pred") - F.col("rating")).alias("implicit_error"))


_ERRORS_SQL = """
SELECT userId, movieId, rating, explicit_pred, implicit_pred,
       abs(explicit_pred - rating) AS explicit_error, abs(implicit_pred - rating) AS implicit_error
FROM (
  SELECT t.userId, t.movieId, t.rating,
         greatest(0.5, least(5.0, (SELECT mu FROM mu) + coalesce(uf.bias, 0) + coalesce(i.bias, 0)
                  + coalesce(list_dot_product(uf.features, i.features), 0))) AS explicit_pred,
         CASE WHEN uf.features IS NULL OR i.features IS NULL THEN 3.5
              ELSE greatest(0.0, least(5.0, list_dot_product(uf.features, i.features))) END AS implicit_pred
  FROM temporal_split t LEFT JOIN user_factors uf ON t.userId = uf.userId
  LEFT JOIN item_factors i ON t.movieId = i.movieId WHERE t.split = 'test') p"""
MV = ["ratings", "user_factors", "item_factors", "mu", "temporal_split"]


@register("paired_errors", _ERRORS_SQL, MV,
          round_cols=["rating", "explicit_pred", "implicit_pred", "explicit_error", "implicit_error"])
def paired_errors(spark, sf):
    """Both models' predictions and absolute errors on the same test rows."""
    return _model_errors(spark, sf)


@register("model_ab_test", ttest_sql(
    "SELECT 'abs_error' AS metric, 'control' AS g, explicit_error AS value FROM (" + _ERRORS_SQL + ") e "
    "UNION ALL SELECT 'abs_error', 'treatment', implicit_error FROM (" + _ERRORS_SQL + ") e"),
    MV, round_cols=TTEST_ROUND)
def model_ab_test(spark, sf):
    """Unpaired t-test of absolute errors, explicit (control) vs implicit (treatment)."""
    e = _model_errors(spark, sf)
    stacked = e.select(F.lit("abs_error").alias("metric"), F.explode(F.array(
        F.struct(F.lit("control").alias("experiment_group"), F.col("explicit_error").alias("value")),
        F.struct(F.lit("treatment").alias("experiment_group"), F.col("implicit_error").alias("value"))
    )).alias("s")).select("metric", "s.experiment_group", "s.value")
    return ab.ab_ttest(stacked, by=["metric"])


@register("paired_ttest", f"""
SELECT n, mean_diff, sd_diff, t_statistic, df, {simpson_p_sql('t_statistic', 'df')} AS p_value FROM (
  SELECT count(*) AS n, avg(implicit_error - explicit_error) AS mean_diff,
         stddev_samp(implicit_error - explicit_error) AS sd_diff,
         avg(implicit_error - explicit_error) / (stddev_samp(implicit_error - explicit_error) / sqrt(count(*))) AS t_statistic,
         (count(*) - 1)::DOUBLE AS df
  FROM ({_ERRORS_SQL}) e) x""", MV, round_cols=["mean_diff", "sd_diff", "t_statistic", "df", "p_value"])
def paired_ttest(spark, sf):
    """Paired t-test of the same rows' errors (implicit minus explicit)."""
    return ab.paired_ttest(_model_errors(spark, sf), "explicit_error", "implicit_error")


@register("model_winner", f"""
SELECT arg_min(algorithm, test_rmse) AS winner, min(test_rmse) AS winner_test_rmse,
       (max(test_rmse) - min(test_rmse)) / max(test_rmse) * 100 AS improvement_pct, count(*) AS n_models
FROM (SELECT 'SVD' AS algorithm, sqrt(avg(explicit_error * explicit_error)) AS test_rmse FROM ({_ERRORS_SQL}) e
      UNION ALL
      SELECT 'ALS', sqrt(avg(implicit_error * implicit_error)) FROM ({_ERRORS_SQL}) e) c""", MV,
          round_cols=["winner_test_rmse", "improvement_pct"])
def model_winner(spark, sf):
    """B7 (+X6): comparison table of both models on the test split and the winner."""
    e = _model_errors(spark, sf)
    comp = (metrics.accuracy(e.withColumn("predicted_rating", F.col("explicit_pred")))
            .select(F.lit("SVD").alias("algorithm"), F.col("rmse").alias("test_rmse"))
            .unionByName(metrics.accuracy(e.withColumn("predicted_rating", F.col("implicit_pred")))
                         .select(F.lit("ALS").alias("algorithm"), F.col("rmse").alias("test_rmse"))))
    return ab.model_winner(comp, "test_rmse")


@register("ab_readiness", f"""
SELECT sum(CASE WHEN g = 'control' THEN 1 ELSE 0 END)::BIGINT AS n_control,
       sum(CASE WHEN g = 'treatment' THEN 1 ELSE 0 END)::BIGINT AS n_treatment,
       least(sum(CASE WHEN g = 'control' THEN 1 ELSE 0 END), sum(CASE WHEN g = 'treatment' THEN 1 ELSE 0 END)) >= 1000 AS ready
FROM (SELECT DISTINCT user_id, {_grp_sql('user_id', 'default')} AS g FROM events) u""", [])
def ab_readiness(spark, sf):
    """Group sizes of event users and readiness at the minimum sample of 1000."""
    users = load_table(spark, sf, "events").select("user_id").distinct()
    return ab.readiness(ab.assign_groups(users, "default", "user_id"), 1000)


_ENGAGE_SQL = f"""
SELECT p.user_id AS userId, {_grp_sql('p.user_id', 'default')} AS experiment_group, p.n_events, s.n_sessions,
       CASE WHEN p.views > 0 THEN p.clicks / p.views::DOUBLE END AS click_through_rate,
       p.purchases / p.n_events::DOUBLE AS conversion_rate, s.session_length, r.avg_rating
FROM (SELECT user_id, count(*) AS n_events,
             sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks,
             sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views,
             sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases
      FROM events GROUP BY user_id) p
JOIN (SELECT user_id, count(*) AS n_sessions, avg(len_us) / 1e6 AS session_length FROM (
        SELECT user_id, sid, epoch_us(max(ts)) - epoch_us(min(ts)) AS len_us FROM (
          SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid
          FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) e) x
        GROUP BY user_id, sid) y GROUP BY user_id) s ON s.user_id = p.user_id
LEFT JOIN (SELECT userId, avg(rating) AS avg_rating FROM ratings GROUP BY userId) r ON r.userId = p.user_id"""


def _engagement(spark, sf):
    ev = load_table(spark, sf, "events")
    eng = ab.user_engagement(ev, "30 minutes")
    avg_r = ratings_view(spark, sf).groupBy("userId").agg(F.avg("rating").alias("avg_rating"))
    return ab.assign_groups(eng, "default").join(avg_r, "userId", "left")


@register("experiment_metrics", _ENGAGE_SQL, ["ratings"],
          round_cols=["click_through_rate", "conversion_rate", "session_length", "avg_rating"])
def experiment_metrics(spark, sf):
    """Per-user CTR, conversion, session length (30-minute gap) and mean rating."""
    return _engagement(spark, sf).select(
        "userId", "experiment_group", "n_events", "n_sessions", "click_through_rate",
        "conversion_rate", "session_length", "avg_rating")


_METRICS = ["click_through_rate", "conversion_rate", "session_length", "avg_rating"]


@register("experiment_ttest", ttest_sql(" UNION ALL ".join(
    f"SELECT '{m}' AS metric, experiment_group AS g, {m} AS value FROM ({_ENGAGE_SQL}) e" for m in _METRICS)),
    ["ratings"], round_cols=TTEST_ROUND)
def experiment_ttest(spark, sf):
    """B3 over the tracked experiment metrics, one test per metric."""
    eng = _engagement(spark, sf)
    long = eng.select("experiment_group", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in _METRICS
    ])).alias("m")).select("m.metric", "experiment_group", "m.value")
    return ab.ab_ttest(long, by=["metric"])


@register("user_sessions", """
WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
f AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS session_index FROM e)
SELECT user_id, session_index, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS length_seconds
FROM f GROUP BY user_id, session_index""", [], round_cols=["length_seconds"],
          bigint_cols=["session_index", "n_events"])
def user_sessions(spark, sf):
    """Event sessions per user (30-minute inactivity gap), skew-safe."""
    return ab.session_table(load_table(spark, sf, "events"), "30 minutes")
