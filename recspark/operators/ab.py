"""A/B testing operators.

Assignment is an MD5 hash of "{user}_{experiment}", so every engine and every
partitioning agrees.  Tests aggregate their moments in one Spark pass
(conditional aggregates per group, no pivot, no join); only the t-distribution
tail and quantile run in Python, on one row per test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.functions.hashing import ab_group, unit_hash
from recspark.functions.stats import norm_ppf, t_pvalue_udf, t_quantile_udf


def assign_groups(users: DataFrame, salt: str = "default", user_col: str = "userId",
                  name: str = "experiment_group") -> DataFrame:
    """B1/B2: md5("{user}_{salt}") even -> treatment, odd -> control."""
    return users.withColumn(name, ab_group(F.col(user_col), salt))


def weighted_assignment(users: DataFrame, weights: dict[str, float], salt: str = "default",
                        user_col: str = "userId", name: str = "experiment_group") -> DataFrame:
    """Traffic split by weights (e.g. {'control': .5, 'treatment': .5})
    on a stable md5 bucket in [0, 1)."""
    total = float(sum(weights.values()))
    u = unit_hash(F.col(user_col), salt)
    expr, acc = None, 0.0
    for group, w in weights.items():
        acc += w / total
        cond = u < F.lit(acc)
        expr = F.when(cond, F.lit(group)) if expr is None else expr.when(cond, F.lit(group))
    return users.withColumn(name, expr.otherwise(F.lit(list(weights)[-1])))


def ab_moments(values: DataFrame, group_col: str = "experiment_group", value_col: str = "value",
               by=()) -> DataFrame:
    """B3 moments: n, mean, sample and population variance per (by, group)."""
    return values.groupBy(*by, group_col).agg(
        F.count(value_col).alias("n"), F.avg(value_col).alias("mean"),
        F.var_samp(value_col).alias("var_samp"), F.var_pop(value_col).alias("var_pop"))


def _cond(group_col: str, group: str, value_col: str) -> Column:
    return F.when(F.col(group_col) == group, F.col(value_col))


def ab_ttest(values: DataFrame, group_col: str = "experiment_group", value_col: str = "value",
             by=(), control: str = "control", treatment: str = "treatment",
             confidence_level: float = 0.95) -> DataFrame:
    """B3 + B4: two-sample pooled-variance t-test of treatment minus control.

    Columns: control_mean, treatment_mean, absolute_difference,
    relative_lift_pct, t_statistic, df, p_value, is_significant,
    confidence_level, ci_low / ci_high (centred on the treatment mean with
    population variances, as the reference labels its "lift" interval),
    diff_ci_low / diff_ci_high (interval of the difference from the pooled
    standard error), sample_size_control, sample_size_treatment.
    """
    c = lambda: _cond(group_col, control, value_col)
    t = lambda: _cond(group_col, treatment, value_col)
    m = values.groupBy(*by).agg(
        F.count(c()).alias("sample_size_control"), F.count(t()).alias("sample_size_treatment"),
        F.avg(c()).alias("control_mean"), F.avg(t()).alias("treatment_mean"),
        F.var_samp(c()).alias("_vs_c"), F.var_samp(t()).alias("_vs_t"),
        F.var_pop(c()).alias("_vp_c"), F.var_pop(t()).alias("_vp_t"))
    n_c, n_t = F.col("sample_size_control"), F.col("sample_size_treatment")
    df = (n_c + n_t - 2).cast("double")
    # zero divisors (one-row groups, zero variance, zero control mean) give
    # NULL statistics instead of failing the query under ANSI arithmetic
    sp2 = F.try_divide((n_c - 1) * F.col("_vs_c") + (n_t - 1) * F.col("_vs_t"), df)
    se_pooled = F.sqrt(sp2 * (F.try_divide(F.lit(1.0), n_c) + F.try_divide(F.lit(1.0), n_t)))
    diff = F.col("treatment_mean") - F.col("control_mean")
    out = m.select(
        *by, "control_mean", "treatment_mean", diff.alias("absolute_difference"),
        (F.try_divide(diff, F.col("control_mean")) * 100.0).alias("relative_lift_pct"),
        F.try_divide(diff, se_pooled).alias("t_statistic"), df.alias("df"),
        F.sqrt(F.try_divide(F.col("_vp_c"), n_c) + F.try_divide(F.col("_vp_t"), n_t)).alias("_se_ci"),
        se_pooled.alias("_se_diff"), "sample_size_control", "sample_size_treatment")
    out = out.withColumn("p_value", t_pvalue_udf(F.col("t_statistic"), F.col("df")))
    out = out.withColumn("_crit", t_quantile_udf(F.lit((1 + confidence_level) / 2), F.col("df")))
    return out.select(
        *by, "control_mean", "treatment_mean", "absolute_difference", "relative_lift_pct",
        "t_statistic", "df", "p_value",
        (F.col("p_value") < F.lit(1 - confidence_level)).alias("is_significant"),
        F.lit(float(confidence_level)).alias("confidence_level"),
        (F.col("treatment_mean") - F.col("_crit") * F.col("_se_ci")).alias("ci_low"),
        (F.col("treatment_mean") + F.col("_crit") * F.col("_se_ci")).alias("ci_high"),
        (F.col("absolute_difference") - F.col("_crit") * F.col("_se_diff")).alias("diff_ci_low"),
        (F.col("absolute_difference") + F.col("_crit") * F.col("_se_diff")).alias("diff_ci_high"),
        "sample_size_control", "sample_size_treatment")


def paired_ttest(pairs: DataFrame, control_col: str, treatment_col: str, by=()) -> DataFrame:
    """Paired t-test on treatment - control of the same rows."""
    d = F.col(treatment_col) - F.col(control_col)
    m = pairs.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"),
                               F.stddev_samp(d).alias("sd_diff"))
    m = m.withColumn("t_statistic", F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt("n")))
    m = m.withColumn("df", (F.col("n") - 1).cast("double"))
    return m.withColumn("p_value", t_pvalue_udf(F.col("t_statistic"), F.col("df")))


def power_plan(rates: DataFrame, rate_col: str = "baseline_rate", mde_col: str = "mde",
               power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """B5 over a table of baseline rates: required sample size per group,
    ceil((z_{1-α/2}+z_power)² (p1(1-p1)+p2(1-p2)) / (p1-p2)²), p2 = p1(1+mde)."""
    z = norm_ppf(1 - alpha / 2) + norm_ppf(power)
    p1 = F.col(rate_col)
    p2 = p1 * (F.lit(1.0) + F.col(mde_col))
    n = F.try_divide(F.lit(z * z) * (p1 * (1 - p1) + p2 * (1 - p2)), (p1 - p2) * (p1 - p2))
    return rates.withColumn("required_n_per_group", F.ceil(n).cast("bigint"))


def model_winner(comparison: DataFrame, metric: str = "test_rmse") -> DataFrame:
    """Lowest ``metric`` wins; improvement = % of the runner-up's value."""
    ranked = comparison.agg(
        F.min_by("algorithm", F.struct(F.col(metric), F.col("algorithm"))).alias("winner"),
        F.min(metric).alias("best"),
        F.max(metric).alias("worst"),
        F.count(F.lit(1)).alias("n_models"))
    return ranked.select("winner", F.col("best").alias(f"winner_{metric}"),
                         (F.try_divide(F.col("worst") - F.col("best"), F.col("worst")) * 100.0)
                         .alias("improvement_pct"),
                         "n_models")


def session_table(events: DataFrame, session_gap: str = "30 minutes") -> DataFrame:
    """Sessions of an events table (user_id, ts, event_id), split at
    ``session_gap`` of inactivity; skew-safe (see ``operators.sessions``)."""
    from recspark.operators.sessions import sessions

    amount, unit = session_gap.split()
    seconds = float(amount) * {"second": 1, "seconds": 1, "minute": 60, "minutes": 60,
                               "hour": 3600, "hours": 3600}[unit]
    return sessions(events, "user_id", "ts", "event_id", seconds)


def user_engagement(events: DataFrame, session_gap: str = "30 minutes") -> DataFrame:
    """B8 per-user metrics from an events table: click-through rate (clicks /
    views), conversion rate (purchases / events) and mean session length in
    seconds (sessions split at ``session_gap`` of inactivity)."""
    per_user = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("_clicks"),
        F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("_views"),
        F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("_purchases"))
    sess = (session_table(events, session_gap).groupBy("user_id")
            .agg(F.avg("length_seconds").alias("session_length"),
                 F.count(F.lit(1)).alias("n_sessions")))
    return per_user.join(sess, "user_id").select(
        F.col("user_id").alias("userId"), "n_events", "n_sessions",
        F.when(F.col("_views") > 0, F.col("_clicks") / F.col("_views")).alias("click_through_rate"),
        (F.col("_purchases") / F.col("n_events")).alias("conversion_rate"),
        "session_length")


def readiness(assignments: DataFrame, min_sample_size: int = 1000,
              group_col: str = "experiment_group", by=()) -> DataFrame:
    """Group sizes and whether both reach the minimum sample size."""
    m = assignments.groupBy(*by).agg(
        F.sum(F.when(F.col(group_col) == "control", 1).otherwise(0)).cast("bigint").alias("n_control"),
        F.sum(F.when(F.col(group_col) == "treatment", 1).otherwise(0)).cast("bigint").alias("n_treatment"))
    return m.withColumn("ready", F.least("n_control", "n_treatment") >= F.lit(int(min_sample_size)))


def z_constants(power: float = 0.8, alpha: float = 0.05) -> tuple[float, float]:
    return norm_ppf(1 - alpha / 2), norm_ppf(power)


__all__ = ["assign_groups", "weighted_assignment", "ab_moments", "ab_ttest", "paired_ttest",
           "power_plan", "model_winner", "user_engagement", "session_table", "readiness",
           "z_constants"]
