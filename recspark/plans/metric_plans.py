"""Query plans for accuracy and ranking metrics, evaluated on the temporal
test split with top-20 lists from the fixture factors (nothing excluded, as
the reference's evaluation does)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.operators import metrics, prep, scoring
from recspark.plans.registry import register
from recspark.plans.scoring_plans import _topn_sql
from recspark.sources import (global_mean, item_factors_view, movies_view, ratings_view,
                              user_factors_view)

V = ["ratings", "user_factors", "item_factors", "mu", "temporal_split", "movies"]

_BASE = f"""
WITH recs AS ({_topn_sql("", 20)}),
test AS (SELECT userId, movieId, rating FROM temporal_split WHERE split = 'test'),
nrel AS (SELECT userId, count(*) AS n_relevant FROM test GROUP BY userId),
hits AS (SELECT r.userId, r.movieId, r.rank, t.movieId IS NOT NULL AS hit, t.rating AS gain
         FROM recs r LEFT JOIN test t ON r.userId = t.userId AND r.movieId = t.movieId),
ks AS (SELECT unnest([5, 10, 20]) AS k),
disc AS (SELECT i, sum(1.0 / log2(i + 1)) OVER (ORDER BY i) AS cum FROM range(1, 21) r(i)),
per_user AS (
  SELECT n.userId, ks.k, n.n_relevant,
         coalesce(sum(CASE WHEN h.hit AND h.rank <= ks.k THEN 1 ELSE 0 END), 0) AS h,
         coalesce(sum(CASE WHEN h.hit AND h.rank <= ks.k THEN 1.0 / log2(h.rank + 1) ELSE 0 END), 0) AS dcg,
         coalesce(sum(CASE WHEN h.hit AND h.rank <= ks.k THEN h.gain / log2(h.rank + 1) ELSE 0 END), 0) AS gdcg
  FROM nrel n CROSS JOIN ks LEFT JOIN hits h ON h.userId = n.userId
  GROUP BY n.userId, ks.k, n.n_relevant),
ranked_gain AS (SELECT userId, rating, row_number() OVER (PARTITION BY userId ORDER BY rating DESC, movieId) AS i
                FROM test),
ideal_g AS (SELECT n.userId, ks.k, coalesce(sum(CASE WHEN g.i <= ks.k THEN g.rating / log2(g.i + 1) ELSE 0 END), 0) AS idcg
            FROM nrel n CROSS JOIN ks LEFT JOIN ranked_gain g ON g.userId = n.userId GROUP BY n.userId, ks.k),
metric_rows AS (
  SELECT p.userId, p.k, p.h / p.k::DOUBLE AS precision, p.h / p.n_relevant::DOUBLE AS recall,
         CASE WHEN d.cum IS NULL OR d.cum = 0 THEN 0.0 ELSE p.dcg / d.cum END AS ndcg,
         CASE WHEN ig.idcg = 0 THEN 0.0 ELSE p.gdcg / ig.idcg END AS ndcg_graded
  FROM per_user p LEFT JOIN disc d ON d.i = least(p.k, p.n_relevant)
  JOIN ideal_g ig ON ig.userId = p.userId AND ig.k = p.k)
"""


def _inputs(spark, sf, with_recs: bool = True, with_test: bool = True):
    """Shared inputs; the top-20 lists and the temporal split (each runs
    sizing / checkpoint jobs when built) only for the queries that read them."""
    ratings = ratings_view(spark, sf, write=True)
    uf = user_factors_view(spark, sf, ratings)
    itf = item_factors_view(spark, sf)
    mu = global_mean(ratings)
    recs = scoring.recommend_explicit(ratings, uf, itf, mu, 20) if with_recs else None
    test = (prep.temporal_split(ratings).filter(F.col("split") == "test").drop("split")
            if with_test else None)
    return ratings, uf, itf, mu, recs, test


@register("precision_at_k", _BASE + "SELECT userId, k, precision FROM metric_rows", V,
          round_cols=["precision"], bigint_cols=["k"])
def precision_at_k(spark, sf):
    """precision@5/10/20 per user with test items."""
    *_, recs, test = _inputs(spark, sf)
    return metrics.ranking_metrics(recs, test, (5, 10, 20)).select("userId", "k", "precision")


@register("recall_at_k", _BASE + "SELECT userId, k, recall FROM metric_rows", V,
          round_cols=["recall"], bigint_cols=["k"])
def recall_at_k(spark, sf):
    """recall@5/10/20."""
    *_, recs, test = _inputs(spark, sf)
    return metrics.ranking_metrics(recs, test, (5, 10, 20)).select("userId", "k", "recall")


@register("ndcg_at_k", _BASE + "SELECT userId, k, ndcg FROM metric_rows", V,
          round_cols=["ndcg"], bigint_cols=["k"])
def ndcg_at_k(spark, sf):
    """E4 binary relevance."""
    *_, recs, test = _inputs(spark, sf)
    return metrics.ranking_metrics(recs, test, (5, 10, 20)).select("userId", "k", "ndcg")


@register("ndcg_graded", _BASE + "SELECT userId, k, ndcg_graded AS ndcg FROM metric_rows", V,
          round_cols=["ndcg"], bigint_cols=["k"])
def ndcg_graded(spark, sf):
    """E4 graded: gains are the test ratings."""
    *_, recs, test = _inputs(spark, sf)
    return metrics.ranking_metrics(recs, test, (5, 10, 20), gain="rating").select("userId", "k", "ndcg")


@register("average_precision", _BASE + """
SELECT n.userId, coalesce(a.s, 0) / n.n_relevant AS average_precision
FROM nrel n LEFT JOIN (
  SELECT userId, sum(CASE WHEN hit THEN cum / rank ELSE 0 END) AS s FROM (
    SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY userId ORDER BY rank) AS cum
    FROM hits) x GROUP BY userId) a ON a.userId = n.userId""", V,
          round_cols=["average_precision"])
def average_precision(spark, sf):
    """E3 over the full top-20 list."""
    *_, recs, test = _inputs(spark, sf)
    return metrics.average_precision(recs, test)


@register("mean_ranking_metrics", _BASE + """
SELECT k, avg(precision) AS precision, avg(recall) AS recall, avg(ndcg) AS ndcg, count(*) AS n_users
FROM metric_rows GROUP BY k""", V, round_cols=["precision", "recall", "ndcg"], bigint_cols=["k"])
def mean_ranking_metrics(spark, sf):
    """Mean precision / recall / ndcg per k."""
    *_, recs, test = _inputs(spark, sf)
    return metrics.mean_ranking_metrics(metrics.ranking_metrics(recs, test, (5, 10, 20)))


@register("precision_set_at_k", _BASE + """
SELECT n.userId, coalesce(x.h, 0) / 10.0 AS precision_set FROM nrel n LEFT JOIN (
  SELECT r.userId, count(*) AS h FROM recs r JOIN (SELECT DISTINCT userId, movieId FROM test) t
    ON r.userId = t.userId AND r.movieId = t.movieId WHERE r.rank <= 10 GROUP BY r.userId) x
  ON x.userId = n.userId""", V, round_cols=["precision_set"])
def precision_set_at_k(spark, sf):
    """Set precision@10 for every user with test items."""
    *_, recs, test = _inputs(spark, sf)
    return metrics.precision_set_at_k(recs, test, 10)


@register("catalog_coverage", _BASE + """
SELECT count(DISTINCT movieId) AS n_recommended, (SELECT count(*) FROM movies) AS n_items,
       count(DISTINCT movieId) / (SELECT count(*) FROM movies)::DOUBLE AS coverage
FROM recs WHERE rank <= 10""", V, round_cols=["coverage"])
def catalog_coverage(spark, sf):
    """E5 (U2): distinct items in the top-10 lists over the catalogue size."""
    *_, recs, _ = _inputs(spark, sf, with_test=False)
    movies = movies_view(spark, sf)
    return metrics.catalog_coverage(recs.filter(F.col("rank") <= 10), movies.count())


_PAIRS = """
, cnt AS (SELECT userId, count(*) AS c FROM lists GROUP BY userId),
pairs AS (SELECT a.userId, {dist} AS d FROM lists a JOIN lists b ON a.userId = b.userId AND a.rank < b.rank)
SELECT c.userId, CASE WHEN c.c <= 1 THEN 1.0 ELSE coalesce(sum(p.d), 0) / (c.c * (c.c - 1) / 2.0) END AS diversity
FROM cnt c LEFT JOIN pairs p ON p.userId = c.userId GROUP BY c.userId, c.c"""


_JACCARD = ("CASE WHEN len(list_distinct(list_concat(a.g, b.g))) > 0 THEN 1.0 - len(list_intersect(a.g, b.g)) "
            "/ len(list_distinct(list_concat(a.g, b.g)))::DOUBLE ELSE 0.0 END")


@register("diversity_features", _BASE + """
, lists AS (SELECT r.userId, r.rank, coalesce(string_split(m.genres, '|'), []) AS g
            FROM recs r LEFT JOIN movies m ON r.movieId = m.movieId WHERE r.rank <= 10)""" + _PAIRS.format(dist=_JACCARD), V, round_cols=["diversity"])
def diversity_features(spark, sf):
    """Jaccard diversity of genre sets in each top-10 list."""
    *_, recs, _ = _inputs(spark, sf, with_test=False)
    return metrics.diversity_features(recs, movies_view(spark, sf), 10)


@register("diversity_similarity", _BASE + """
, lists AS (SELECT r.userId, r.rank, i.features FROM recs r JOIN item_factors i ON r.movieId = i.movieId
            WHERE r.rank <= 10)""" + _PAIRS.format(
    dist="1.0 - list_dot_product(a.features, b.features) / (sqrt(list_dot_product(a.features, a.features)) "
         "* sqrt(list_dot_product(b.features, b.features)))"), V, round_cols=["diversity"])
def diversity_similarity(spark, sf):
    """Mean 1 - cosine similarity of item factors in each top-10 list."""
    _, _, itf, _, recs, _ = _inputs(spark, sf, with_test=False)
    return metrics.diversity_similarity(recs, itf, 10)


@register("novelty", _BASE + """
, pop AS (SELECT movieId, count(*) AS c FROM ratings GROUP BY movieId)
SELECT r.userId, avg(CASE WHEN coalesce(p.c, 0) > 0
                          THEN -log2(p.c / (SELECT count(*) FROM ratings)::DOUBLE) ELSE 0.0 END) AS novelty
FROM recs r LEFT JOIN pop p ON r.movieId = p.movieId WHERE r.rank <= 10 GROUP BY r.userId""", V,
          round_cols=["novelty"])
def novelty(spark, sf):
    """Self-information of recommended items by rating counts."""
    ratings, *_, recs, _ = _inputs(spark, sf, with_test=False)
    return metrics.novelty(recs.filter(F.col("rank") <= 10), ratings)


_SCORED_TEST = """
, scored AS (
  SELECT t.rating, greatest(0.5, least(5.0, (SELECT mu FROM mu) + coalesce(uf.bias, 0) + coalesce(i.bias, 0)
         + coalesce(list_dot_product(uf.features, i.features), 0))) AS predicted_rating
  FROM test t LEFT JOIN user_factors uf ON t.userId = uf.userId LEFT JOIN item_factors i ON t.movieId = i.movieId)
"""
_ACC = ("SELECT sqrt(avg((predicted_rating - rating) * (predicted_rating - rating))) AS rmse, "
        "avg(abs(predicted_rating - rating)) AS mae, count(*) AS n_scored, 0::BIGINT AS n_dropped FROM scored")


@register("accuracy", _BASE + _SCORED_TEST + _ACC, V, round_cols=["rmse", "mae"])
def accuracy(spark, sf):
    """Rmse and mae of the explicit model on the temporal test split."""
    ratings, uf, itf, mu, _, test = _inputs(spark, sf, with_recs=False)
    return metrics.accuracy(scoring.predict_explicit(test, uf, itf, mu))


@register("evaluate_model", _BASE + _SCORED_TEST + f"""
, acc AS ({_ACC})
SELECT 'rmse' AS metric, 0::BIGINT AS k, rmse AS value FROM acc
UNION ALL SELECT 'mae', 0, mae FROM acc
UNION ALL SELECT 'precision', k, avg(precision) FROM metric_rows GROUP BY k
UNION ALL SELECT 'recall', k, avg(recall) FROM metric_rows GROUP BY k
UNION ALL SELECT 'ndcg', k, avg(ndcg) FROM metric_rows GROUP BY k""", V, round_cols=["value"],
          bigint_cols=["k"])
def evaluate_model(spark, sf):
    """Accuracy plus ranking metrics at k = 5, 10, 20 from one scoring job."""
    ratings, uf, itf, mu, recs, test = _inputs(spark, sf)
    return metrics.evaluate_model(scoring.predict_explicit(test, uf, itf, mu), recs, test)


@register("metric_panel", _BASE + _SCORED_TEST + f"""
, acc AS ({_ACC}),
lists AS (SELECT r.userId, r.rank, coalesce(string_split(m.genres, '|'), []) AS g
          FROM recs r LEFT JOIN movies m ON r.movieId = m.movieId WHERE r.rank <= 10),
cnt AS (SELECT userId, count(*) AS c FROM lists GROUP BY userId),
pairs AS (SELECT a.userId, {_JACCARD} AS d FROM lists a JOIN lists b ON a.userId = b.userId AND a.rank < b.rank)
SELECT 'rmse' AS metric, rmse AS value FROM acc
UNION ALL SELECT 'mae', mae FROM acc
UNION ALL SELECT 'precision', avg(precision) FROM metric_rows WHERE k = 10
UNION ALL SELECT 'recall', avg(recall) FROM metric_rows WHERE k = 10
UNION ALL SELECT 'ndcg', avg(ndcg) FROM metric_rows WHERE k = 10
UNION ALL SELECT 'coverage', count(DISTINCT movieId) / (SELECT count(*) FROM movies)::DOUBLE FROM recs WHERE rank <= 10
UNION ALL SELECT 'diversity', avg(diversity) FROM (
  SELECT c.userId, CASE WHEN c.c <= 1 THEN 1.0 ELSE coalesce(sum(p.d), 0) / (c.c * (c.c - 1) / 2.0) END AS diversity
  FROM cnt c LEFT JOIN pairs p ON p.userId = c.userId GROUP BY c.userId, c.c) dv""", V, round_cols=["value"])
def metric_panel(spark, sf):
    """Rmse, mae, precision / recall / ndcg @10, coverage, diversity."""
    ratings, uf, itf, mu, recs, test = _inputs(spark, sf)
    movies = movies_view(spark, sf)
    return metrics.metric_panel(scoring.predict_explicit(test, uf, itf, mu), recs, test, movies,
                                movies.count(), 10)


@register("common_users", """
SELECT userId FROM user_factors
INTERSECT SELECT userId FROM temporal_split WHERE split = 'train'""", V)
def common_users(spark, sf):
    """Users known to the factor model and present in the training split."""
    ratings = ratings_view(spark, sf, persist=True)
    uf = user_factors_view(spark, sf, ratings)
    train = prep.temporal_split(ratings).filter(F.col("split") == "train")
    return metrics.common_users(uf, train)
