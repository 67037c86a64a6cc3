"""Query plans for scoring on the fixture factor tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.operators import content, lsh, scoring
from recspark.plans.registry import register
from recspark.sources import (global_mean, item_factors_view, movies_view, ratings_view,
                              user_factors_view)

V = ["ratings", "user_factors", "item_factors", "mu"]
DOT = "list_dot_product({a}, {b})"


def _factors(spark, sf):
    ratings = ratings_view(spark, sf, write=True)
    return ratings, user_factors_view(spark, sf, ratings), item_factors_view(spark, sf)


def _topn_sql(where: str = "", n: int = 10, users: str = "(SELECT DISTINCT userId FROM ratings)") -> str:
    return f"""
SELECT userId, movieId, predicted_rating, rank FROM (
  SELECT userId, movieId, predicted_rating,
         row_number() OVER (PARTITION BY userId ORDER BY round(predicted_rating, 6) DESC, movieId) AS rank
  FROM (
    SELECT u.userId, i.movieId,
           greatest(0.5, least(5.0, (SELECT mu FROM mu) + coalesce(uf.bias, 0) + i.bias
                    + coalesce({DOT.format(a='uf.features', b='i.features')}, 0))) AS predicted_rating
    FROM {users} u
    LEFT JOIN user_factors uf ON uf.userId = u.userId
    CROSS JOIN item_factors i
    WHERE TRUE {where}) s) t
WHERE rank <= {n}"""


_NOT_SEEN = "AND NOT EXISTS (SELECT 1 FROM ratings r WHERE r.userId = u.userId AND r.movieId = i.movieId)"
_CANDIDATES = "AND i.movieId IN (SELECT movieId FROM ratings GROUP BY movieId HAVING count(*) >= 20)"


@register("topn_exclude_seen", _topn_sql(_NOT_SEEN), V, round_cols=["predicted_rating"],
          bigint_cols=["rank"])
def topn_exclude_seen(spark, sf):
    """M10 (+P14, J6, W1): top-10 for every user, rated items excluded."""
    ratings, uf, itf = _factors(spark, sf)
    return scoring.recommend_explicit(ratings, uf, itf, global_mean(ratings), 10,
                                      seen=ratings.select("userId", "movieId"))


@register("topn_all_users", _topn_sql("", 20), V, round_cols=["predicted_rating"],
          bigint_cols=["rank"])
def topn_all_users(spark, sf):
    """J6 + W1: top-20 for every user, nothing excluded (evaluation parity)."""
    ratings, uf, itf = _factors(spark, sf)
    return scoring.recommend_explicit(ratings, uf, itf, global_mean(ratings), 20)


@register("topn_candidates", _topn_sql(_NOT_SEEN + " " + _CANDIDATES), V,
          round_cols=["predicted_rating"], bigint_cols=["rank"])
def topn_candidates(spark, sf):
    """M8 + P13: top-10 among candidate movies (those with >= 20 ratings), seen excluded."""
    ratings, uf, itf = _factors(spark, sf)
    cands = ratings.groupBy("movieId").count().filter(F.col("count") >= 20).select("movieId")
    return scoring.recommend_explicit(ratings, uf, itf, global_mean(ratings), 10,
                                      seen=ratings.select("userId", "movieId"), candidates=cands)


@register("predict_explicit", f"""
SELECT r.userId, r.movieId, r.rating, r."timestamp",
       greatest(0.5, least(5.0, (SELECT mu FROM mu) + coalesce(uf.bias, 0) + coalesce(i.bias, 0)
                + coalesce({DOT.format(a='uf.features', b='i.features')}, 0))) AS predicted_rating,
       uf.features IS NOT NULL AS known_user, i.features IS NOT NULL AS known_item,
       NOT (uf.features IS NOT NULL AND i.features IS NOT NULL) AS was_impossible
FROM ratings r LEFT JOIN user_factors uf ON r.userId = uf.userId
LEFT JOIN item_factors i ON r.movieId = i.movieId""", V, round_cols=["rating", "predicted_rating"])
def predict_explicit(spark, sf):
    """M5 (+P11): explicit-model prediction for every rated pair."""
    ratings, uf, itf = _factors(spark, sf)
    return scoring.predict_explicit(ratings, uf, itf, global_mean(ratings))


@register("predict_implicit", f"""
SELECT r.userId, r.movieId, r.rating, r."timestamp",
       CASE WHEN uf.features IS NULL OR i.features IS NULL THEN 3.5
            ELSE greatest(0.0, least(5.0, {DOT.format(a='uf.features', b='i.features')})) END AS score,
       uf.features IS NULL OR i.features IS NULL AS cold_start,
       CASE WHEN uf.features IS NULL THEN 'user' WHEN i.features IS NULL THEN 'movie' END AS cold_start_type
FROM ratings r LEFT JOIN user_factors uf ON r.userId = uf.userId
LEFT JOIN item_factors i ON r.movieId = i.movieId""", V, round_cols=["rating", "score"])
def predict_implicit(spark, sf):
    """M7 (+P11): implicit-model score with cold-start handling."""
    ratings, uf, itf = _factors(spark, sf)
    return scoring.predict_implicit(ratings, uf, itf)


_POPULAR_SQL = """
SELECT movieId, score, rank FROM (
  SELECT movieId, sum(rating) AS score, row_number() OVER (ORDER BY sum(rating) DESC, movieId) AS rank
  FROM ratings {where} GROUP BY movieId) p
WHERE rank <= {n}"""


@register("popular_items", _POPULAR_SQL.format(where="", n=10), ["ratings"],
          round_cols=["score"], bigint_cols=["rank"])
def popular_items(spark, sf):
    """M13 (A7 + W3): ten most popular movies by summed rating."""
    return scoring.popular_items(ratings_view(spark, sf), 10)


_POP_KNOWN = _POPULAR_SQL.format(where="WHERE movieId IN (SELECT movieId FROM item_factors)", n=10)


@register("topn_with_fallback", f"""
SELECT userId, movieId, score, rank, 'collaborative_filtering' AS strategy FROM (
  SELECT u.userId, i.movieId, {DOT.format(a='uf.features', b='i.features')} AS score,
         row_number() OVER (PARTITION BY u.userId
           ORDER BY round({DOT.format(a='uf.features', b='i.features')}, 6) DESC, i.movieId) AS rank
  FROM (SELECT DISTINCT userId FROM ratings) u
  JOIN user_factors uf ON uf.userId = u.userId
  CROSS JOIN item_factors i
  WHERE TRUE {_NOT_SEEN}) t
WHERE rank <= 10
UNION ALL
SELECT u.userId, p.movieId, p.score, p.rank, 'popular_fallback' AS strategy
FROM (SELECT DISTINCT userId FROM ratings WHERE userId NOT IN (SELECT userId FROM user_factors)) u
CROSS JOIN ({_POP_KNOWN}) p""", V, round_cols=["score"], bigint_cols=["rank"])
def topn_with_fallback(spark, sf):
    """M9 + M14: implicit top-10 for known users, popular items for unknown ones."""
    ratings, uf, itf = _factors(spark, sf)
    popular = scoring.popular_items(ratings, 10, items=itf)
    return scoring.recommend_implicit(ratings, uf, itf, popular, 10,
                                      seen=ratings.select("userId", "movieId"))


_COS = ("list_dot_product(a.features, b.features) / (sqrt(list_dot_product(a.features, a.features))"
        " * sqrt(list_dot_product(b.features, b.features)))")


@register("similar_items", f"""
SELECT movieId, similar_movieId, similarity, rank FROM (
  SELECT a.movieId, b.movieId AS similar_movieId, {_COS} AS similarity,
         row_number() OVER (PARTITION BY a.movieId ORDER BY round({_COS}, 6) DESC, b.movieId) AS rank
  FROM item_factors a CROSS JOIN item_factors b WHERE a.movieId <> b.movieId) t
WHERE rank <= 10""", ["item_factors"], round_cols=["similarity"], bigint_cols=["rank"])
def similar_items(spark, sf):
    """M11/M12 (J7 + W2): ten most similar items by cosine of item factors."""
    return scoring.similar_items(item_factors_view(spark, sf), 10)


@register("recs_with_titles", f"""
SELECT t.userId, t.movieId, t.predicted_rating, t.rank, m.title, m.genres
FROM ({_topn_sql(_NOT_SEEN)}) t LEFT JOIN movies m ON t.movieId = m.movieId""",
          V + ["movies"], round_cols=["predicted_rating"], bigint_cols=["rank"])
def recs_with_titles(spark, sf):
    """Top-10 recommendations with title and genres."""
    ratings, uf, itf = _factors(spark, sf)
    recs = scoring.recommend_explicit(ratings, uf, itf, global_mean(ratings), 10,
                                      seen=ratings.select("userId", "movieId"))
    return scoring.with_titles(recs, movies_view(spark, sf))



@register("blend_scores", f"""
SELECT userId, movieId, blend, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY userId ORDER BY round(blend, 6) DESC, movieId) AS rank
  FROM (SELECT uf.userId, i.movieId,
               0.6e0 * greatest(0.5, least(5.0, (SELECT mu FROM mu) + coalesce(uf.bias, 0) + coalesce(i.bias, 0)
                      + {DOT.format(a='uf.features', b='i.features')}))
               + 0.4e0 * greatest(0.0, least(5.0, {DOT.format(a='uf.features', b='i.features')})) AS blend
        FROM user_factors uf CROSS JOIN item_factors i) s) t
WHERE rank <= 10""", V, round_cols=["blend"], bigint_cols=["rank"])
def blend_scores(spark, sf):
    """0.6 x explicit + 0.4 x implicit over the whole catalogue, top-10."""
    ratings, uf, itf = _factors(spark, sf)
    return scoring.blend_topn(uf.select("userId"), (uf, itf, global_mean(ratings)), (uf, itf), 10)


@register("similar_items_lsh")
def similar_items_lsh(spark, sf):
    """Top-10 similar items found by random projections."""
    return lsh.similar_items_lsh(item_factors_view(spark, sf), 10)


@register("content_similar")
def content_similar(spark, sf):
    """Top-10 similar movies by genres (50 components, cosine)."""
    return content.content_similar(movies_view(spark, sf), 10)
