"""Golden values computed from the formulas of the reference's operators."""

import pytest
from pyspark.sql import functions as F

from recspark.functions import stats
from recspark.functions.hashing import ab_group
from recspark.operators import ab, metrics


def test_t_distribution_goldens():
    assert stats.t_two_sided_p(2.0, 10) == pytest.approx(0.073388, abs=1e-6)
    assert stats.t_two_sided_p(1.5, 198) == pytest.approx(0.135207, abs=1e-6)
    assert stats.t_two_sided_p(12, 5) == pytest.approx(7.0895e-5, rel=1e-4)
    assert stats.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert stats.t_ppf(0.975, 198) == pytest.approx(1.972017, abs=1e-6)
    assert stats.t_ppf(0.975, 1998) == pytest.approx(1.961152, abs=1e-6)


def test_power_plan_goldens(spark):
    df = spark.createDataFrame([(0.10, 0.10), (0.15, 0.05)], "baseline_rate double, mde double")
    assert [r.required_n_per_group for r in ab.power_plan(df).collect()] == [14749, 36307]
    row = spark.createDataFrame([(0.20, 0.10)], "baseline_rate double, mde double")
    assert ab.power_plan(row, power=0.9, alpha=0.01).first().required_n_per_group == 12336


def test_md5_groups(spark):
    users = spark.range(1, 11).withColumnRenamed("id", "userId")
    d = [r.g for r in users.select(ab_group(F.col("userId"), "default").alias("g")).orderBy("userId").collect()]
    e = [r.g for r in users.select(ab_group(F.col("userId"), "experiment_001").alias("g"))
         .orderBy("userId").collect()]
    short = lambda xs: [x[0] for x in xs]
    assert short(d) == list("ttttttcctc")
    assert short(e) == list("ctctcctctt")


def test_ab_ttest_golden(spark):
    rows = [("control", float(x)) for x in [1, 2, 3, 4, 5]] + [("treatment", float(x)) for x in [2, 3, 4, 5, 8]]
    r = ab.ab_ttest(spark.createDataFrame(rows, "experiment_group string, value double")).first()
    assert r.control_mean == 3 and r.treatment_mean == pytest.approx(4.4)
    assert r.relative_lift_pct == pytest.approx(46.6667, abs=1e-4)
    assert r.t_statistic == pytest.approx(1.120897, abs=1e-6)
    assert r.p_value == pytest.approx(0.294849, abs=1e-6)
    assert (r.ci_low, r.ci_high) == (pytest.approx(1.823872, abs=1e-6), pytest.approx(6.976128, abs=1e-6))
    assert r.is_significant is False


def test_ranking_golden(spark):
    recs = spark.createDataFrame([(1, m, i + 1) for i, m in enumerate([10, 20, 30, 40, 50])],
                                 "userId long, movieId long, rank long")
    rel = spark.createDataFrame([(1, m) for m in [20, 50, 99]], "userId long, movieId long")
    r = metrics.ranking_metrics(recs, rel, [5]).first()
    assert r.precision == pytest.approx(0.4)
    assert r.recall == pytest.approx(2 / 3)
    assert r.ndcg == pytest.approx(0.477624, abs=1e-6)
    ap = metrics.average_precision(recs, rel).first().average_precision
    assert ap == pytest.approx(0.3)


def test_processing_info_sparsity():
    # recorded run: 44,840 users, 8,617 movies, 3,497,508 ratings
    import math

    n, users, movies = 3497508, 44840, 8617
    assert (1 - n / (users * movies)) * 100 == pytest.approx(99.09481568548448, abs=1e-12)
    n_test = math.ceil(n * 0.2)
    n_val = math.ceil((n - n_test) * (0.1 / 0.8))
    assert (n_test, n_val) == (699502, 349751)
