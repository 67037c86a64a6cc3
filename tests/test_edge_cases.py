"""Edge cases of SURVEY §5.5 on small hand-made frames."""

import pytest
from pyspark.sql import functions as F

from recspark.operators import metrics, monitor, prep, scoring, serving

RATINGS = "userId long, movieId long, rating double, timestamp long"


def test_one_rating_user_std_is_null(spark):
    df = spark.createDataFrame([(1, 10, 4.0, 0), (2, 10, 3.0, 0), (2, 11, 5.0, 0)], RATINGS)
    s = {r.userId: r for r in prep.user_stats(df).collect()}
    assert s[1].user_rating_std is None and s[1].user_rating_count == 1
    assert s[2].user_rating_std == pytest.approx(1.4142135623730951)


def _factors(spark):
    uf = spark.createDataFrame([(1, 0.1, [1.0, 0.0])], "userId long, bias double, features array<float>")
    itf = spark.createDataFrame([(10, 0.2, [0.5, 0.5]), (11, -0.1, [0.0, 1.0])],
                                "movieId long, bias double, features array<float>")
    return uf, itf


def test_unknown_user_and_item_predictions(spark):
    uf, itf = _factors(spark)
    pairs = spark.createDataFrame([(1, 10), (1, 99), (7, 10), (7, 99)], "userId long, movieId long")
    exp = {(r.userId, r.movieId): r for r in scoring.predict_explicit(pairs, uf, itf, 3.0).collect()}
    assert exp[(1, 10)].predicted_rating == pytest.approx(3.0 + 0.1 + 0.2 + 0.5)
    assert exp[(1, 99)].predicted_rating == pytest.approx(3.1) and exp[(1, 99)].was_impossible
    assert exp[(7, 10)].predicted_rating == pytest.approx(3.2) and not exp[(7, 10)].known_user
    assert exp[(7, 99)].predicted_rating == pytest.approx(3.0)
    imp = {(r.userId, r.movieId): r for r in scoring.predict_implicit(pairs, uf, itf).collect()}
    assert imp[(1, 10)].score == pytest.approx(0.5) and not imp[(1, 10)].cold_start
    assert imp[(7, 10)].cold_start_type == "user" and imp[(7, 10)].score == 3.5
    assert imp[(1, 99)].cold_start_type == "movie"


def test_recommend_shorter_than_k_and_seen_excluded(spark):
    uf, itf = _factors(spark)
    users = spark.createDataFrame([(1,), (7,)], "userId long")
    seen = spark.createDataFrame([(1, 10)], "userId long, movieId long")
    recs = scoring.recommend_explicit(users, uf, itf, 3.0, n=5, seen=seen).collect()
    by_user = {}
    for r in recs:
        by_user.setdefault(r.userId, []).append((r.rank, r.movieId))
    assert sorted(by_user[1]) == [(1, 11)]
    assert sorted(by_user[7]) == [(1, 10), (2, 11)]  # unknown user: mu + b_i


def test_empty_relevant_and_k_larger_than_list(spark):
    recs = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "userId long, movieId long, rank long")
    rel = spark.createDataFrame([(1, 6), (2, 7)], "userId long, movieId long")
    got = {(r.userId, r.k): r for r in metrics.ranking_metrics(recs, rel, [10]).collect()}
    assert got[(1, 10)].precision == pytest.approx(0.1)  # divided by k, not by list length
    assert got[(1, 10)].recall == 1.0
    assert got[(2, 10)].precision == 0.0 and got[(2, 10)].ndcg == 0.0  # no recs at all


def test_graded_ndcg(spark):
    recs = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "userId long, movieId long, rank long")
    rel = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0)], "userId long, movieId long, g double")
    r = metrics.ranking_metrics(recs, rel, [2], gain="g").first()
    import math

    dcg = 1.0 + 3.0 / math.log2(3)
    idcg = 3.0 + 1.0 / math.log2(3)
    assert r.ndcg == pytest.approx(dcg / idcg)


def test_diversity_empty_genres_and_single_item(spark):
    recs = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1)], "userId long, movieId long, rank long")
    movies = spark.createDataFrame([(1, "t", ""), (2, "u", "")], "movieId long, title string, genres string")
    got = {r.userId: r.diversity for r in metrics.diversity_features(recs, movies).collect()}
    # ''.split('|') gives [''] in both languages: equal non-empty sets -> distance 0
    assert got[1] == 0.0 and got[2] == 1.0


def test_novelty_unseen_item_counts_zero(spark):
    recs = spark.createDataFrame([(1, 1, 1), (1, 99, 2)], "userId long, movieId long, rank long")
    inter = spark.createDataFrame([(5, 1, 1.0, 0), (6, 2, 1.0, 0)], RATINGS)
    r = metrics.novelty(recs, inter).first()
    assert r.novelty == pytest.approx((1.0 + 0.0) / 2)


def test_duplicate_pairs_merged_by_sum(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 0), (1, 1, 3.0, 1), (1, 2, 1.0, 0)], RATINGS)
    got = {(r.userId, r.movieId): r.rating for r in prep.merge_duplicates(df).collect()}
    assert got == {(1, 1): 5.0, (1, 2): 1.0}


def test_ties_ranked_by_movie_id(spark):
    uf = spark.createDataFrame([(1, 0.0, [1.0])], "userId long, bias double, features array<float>")
    itf = spark.createDataFrame([(m, 0.0, [1.0]) for m in (30, 10, 20)],
                                "movieId long, bias double, features array<float>")
    users = spark.createDataFrame([(1,)], "userId long")
    got = [r.movieId for r in scoring.recommend_explicit(users, uf, itf, 0.0, 2).orderBy("rank").collect()]
    assert got == [10, 20]


@pytest.mark.parametrize("rows,full", [(99, 0), (100, 1), (101, 1), (250, 2)])
def test_degradation_full_batches_only(spark, rows, full):
    import datetime as dt

    data = [(0, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, i, 3.0, 1.0) for i in range(rows)]
    log = spark.createDataFrame(data, "model_id long, ts timestamp_ntz, user_id long, movie_id long, "
                                      "predicted double, actual double")
    b = monitor.degradation_batches(log, monitor.baselines(log, 1.1)).collect()
    assert len(b) == full and all(r.alert for r in b)


def test_baseline_missing_and_zero(spark):
    import datetime as dt

    data = [(m, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, i, 3.0, 1.0)
            for m in (0, 1) for i in range(100)]
    log = spark.createDataFrame(data, "model_id long, ts timestamp_ntz, user_id long, movie_id long, "
                                      "predicted double, actual double")
    base = spark.createDataFrame([(1, 0.0)], "model_id long, baseline_mae double")
    got = {r.model_id: r for r in monitor.degradation_batches(log, base).collect()}
    assert got[0].degradation_pct == 0.0 and not got[0].alert  # missing baseline -> current
    assert got[1].degradation_pct is None and not got[1].alert  # zero baseline -> NULL


def test_zero_requests_health(spark):
    import datetime as dt

    log = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, n long, "
                                    "experiment_group string, is_error boolean, latency_ms double")
    known = spark.createDataFrame([], "userId long")
    c = serving.classify_requests(log, known)
    m = serving.request_metrics(c)
    assert m.count() == 1 and m.first().error_rate == 0.0
    h = serving.health_status(m, serving.latency_ema(c)).first()
    assert h.status == "healthy"
    _ = dt


def test_zero_divisors_give_null_not_errors(spark):
    """ANSI arithmetic is on: constant groups, identical pairs and empty
    tables must yield NULL statistics, not a division error."""
    from recspark.operators import ab

    vals = spark.createDataFrame([("control", 0.0), ("control", 0.0), ("treatment", 0.0), ("treatment", 0.0)],
                                 "experiment_group string, value double")
    r = ab.ab_ttest(vals).first()
    assert r.t_statistic is None and r.relative_lift_pct is None and r.p_value is None
    pairs = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double")
    assert ab.paired_ttest(pairs, "a", "b").first().t_statistic is None
    empty = spark.createDataFrame([], RATINGS)
    s = prep.data_summary(empty).first()
    assert s.n_ratings == 0 and s.sparsity is None
    assert prep.matrix_density(empty).first().density is None
