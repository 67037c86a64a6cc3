"""Scoring with factor tables: predictions, top-N, similar items, popularity.

Factor tables have the shape ``(id, bias double, features array<float>)``
(``userId`` / ``movieId`` as the id column).  Point predictions are joins plus
JVM-side vector expressions; all-pairs work goes through ``block_topk``.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.functions.vectors import clip, dot
from recspark.operators.blocks import _BROADCAST_CONF, _BROADCAST_DEFAULT, block_topk
from recspark.session import drop_path, scratch_path, written


def _uf(user_factors: DataFrame) -> DataFrame:
    return user_factors.select("userId", F.col("bias").alias("_bu"), F.col("features").alias("_pu"))


def _if(item_factors: DataFrame) -> DataFrame:
    return item_factors.select("movieId", F.col("bias").alias("_bi"), F.col("features").alias("_qi"))


#: vectors of up to so many numbers are moved with the pairs, if items can't be broadcast
_NARROW = 16
#: parts of items, of the bytes that top lists broadcast, that are broadcast at a time otherwise: a join's
#: table takes several times its bytes in the driver
_SHARE = 4


def _with_factors(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame, columns) -> DataFrame:
    """``columns`` of ``pairs`` with both factors, where they are known.  Item factors of at most the
    bytes that top lists broadcast (measured) are broadcast, so that pairs are moved
    by user as they are, and not once more with the user's vector.  Larger ones are
    dealt to parts by item: pairs are written by part, and the pairs of a part meet its
    items, which are broadcast alone."""
    items = _if(item_factors)
    size = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_qi")).alias("w")).first()
    limit = int(pairs.sparkSession.conf.get(_BROADCAST_CONF, str(_BROADCAST_DEFAULT)))
    width = max(0, size["w"] or 0)
    total = size["n"] * (8 * width + 24)
    users = _uf(user_factors)
    if total <= limit or width <= _NARROW:
        items = F.broadcast(items) if total <= limit else items
        return pairs.join(users, "userId", "left").join(items, "movieId", "left").select(*columns)
    parts = math.ceil(total / max(1, limit // _SHARE))
    part = F.pmod(F.xxhash64(F.col("movieId").cast("bigint")), F.lit(parts)).cast("int")
    spark = pairs.sparkSession
    paths = {name: scratch_path(spark, name) for name in ("pairs", "users", "items")}
    kept = written(pairs.withColumn("_part", part), "pairs", ("_part",), paths["pairs"])
    users = written(users, "users", (), paths["users"])
    items = written(items.withColumn("_part", part), "items", ("_part",), paths["items"])
    out = []
    for k in range(parts):
        own, near = (df.where(F.col("_part") == k).drop("_part") for df in (kept, items))
        out.append(written(own.join(users, "userId", "left").join(F.broadcast(near), "movieId", "left").select(*columns), "predicted"))
    for path in paths.values():
        drop_path(spark, path)
    return functools.reduce(DataFrame.unionByName, out)


def predict_explicit(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame,
                     mu: float, lo: float = 0.5, hi: float = 5.0) -> DataFrame:
    """M5: r̂ = μ + b_u + b_i + p_u·q_i; unknown user or item contributes 0 to
    its terms; clipped to [lo, hi].  Adds known_user, known_item and
    was_impossible (= not both known)."""
    est = (F.lit(float(mu)) + F.coalesce("_bu", F.lit(0.0)) + F.coalesce("_bi", F.lit(0.0))
           + F.coalesce(dot(F.col("_pu"), F.col("_qi")), F.lit(0.0)))
    known_u, known_i = F.col("_pu").isNotNull(), F.col("_qi").isNotNull()
    return _with_factors(pairs, user_factors, item_factors, [
        *pairs.columns, clip(est, lo, hi).alias("predicted_rating"), known_u.alias("known_user"), known_i.alias("known_item"),
        (~(known_u & known_i)).alias("was_impossible")])


def predict_implicit(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame,
                     cold_score: float = 3.5, lo: float = 0.0, hi: float = 5.0) -> DataFrame:
    """M7: dot product clipped to [lo, hi]; unknown user -> cold_score with type
    'user'; else unknown item -> cold_score with type 'movie'."""
    unknown_u, unknown_i = F.col("_pu").isNull(), F.col("_qi").isNull()
    score = (F.when(unknown_u | unknown_i, F.lit(float(cold_score)))
             .otherwise(clip(dot(F.col("_pu"), F.col("_qi")), lo, hi)))
    ctype = F.when(unknown_u, "user").when(unknown_i, "movie")
    return _with_factors(pairs, user_factors, item_factors, [
        *pairs.columns, score.alias("score"), (unknown_u | unknown_i).alias("cold_start"), ctype.alias("cold_start_type")])


def recommend_explicit(users: DataFrame, user_factors: DataFrame, item_factors: DataFrame,
                       mu: float, n: int = 10, seen: DataFrame | None = None,
                       candidates: DataFrame | None = None, lo: float = 0.5,
                       hi: float = 5.0) -> DataFrame:
    """Top-n items per requested user by the explicit model.

    Unknown users are still scored by μ + b_i.  ``seen`` (userId, movieId)
    pairs are excluded (P14); ``candidates`` (movieId) restricts the items (P13).
    Result: userId, movieId, predicted_rating, rank.
    """
    left = users.select("userId").distinct().join(
        user_factors.select("userId", "bias", "features"), "userId", "left")
    items = item_factors.select("movieId", "bias", "features")
    if candidates is not None:
        items = items.join(candidates.select("movieId"), "movieId", "left_semi")
    return block_topk(left, items, n, left_id="userId", right_id="movieId",
                      left_bias="bias", right_bias="bias", offset=float(mu), lo=lo, hi=hi,
                      exclude=seen, score_name="predicted_rating")


def popular_items(interactions: DataFrame, n: int = 10, items: DataFrame | None = None) -> DataFrame:
    """M13 (A7 + W3): items by summed interaction value, top n, ties by id."""
    src = interactions if items is None else interactions.join(
        items.select("movieId"), "movieId", "left_semi")
    pop = src.groupBy("movieId").agg(F.sum("rating").alias("score"))
    top = pop.orderBy(F.col("score").desc(), F.col("movieId")).limit(int(n))
    # n rows only: the rank window runs on the limited result
    w = Window.orderBy(F.col("score").desc(), F.col("movieId"))
    return top.withColumn("rank", F.row_number().over(w).cast("bigint"))


ATTACH_MAX_ROWS = 10_000


def attach_list(users: DataFrame, small: DataFrame, cols: list[str]) -> DataFrame:
    """Give every user the rows of ``small`` (a top-n list, size bounded by n)
    by explode of a literal array - no cross join, no broadcast of data that
    grows with the tables."""
    # size check, not a cap: a longer list is an error, never truncated
    rows = small.select(*cols).limit(ATTACH_MAX_ROWS + 1).collect()
    if len(rows) > ATTACH_MAX_ROWS:
        raise ValueError(f"attach_list expects a top-n list of at most {ATTACH_MAX_ROWS} rows")
    if not rows:
        schema = T.StructType([users.schema["userId"]] + [small.schema[c] for c in cols])
        return users.sparkSession.createDataFrame([], schema)
    lit = F.array(*[F.struct(*[F.lit(r[c]).cast(small.schema[c].dataType).alias(c) for c in cols])
                    for r in rows])
    return users.select("userId", F.explode(lit).alias("_r")).select("userId", *[f"_r.{c}" for c in cols])


def recommend_implicit(users: DataFrame, user_factors: DataFrame, item_factors: DataFrame,
                       popular: DataFrame, n: int = 10, seen: DataFrame | None = None,
                       candidates: DataFrame | None = None) -> DataFrame:
    """M9 + M14: known users get top-n by p_u·q_i (seen excluded, only
    ``candidates`` when given); unknown users get the popular list.  Result: userId, movieId, score, rank, strategy."""
    req = users.select("userId").distinct()
    if candidates is not None:
        item_factors = item_factors.join(candidates.select("movieId"), "movieId", "left_semi")
    known = req.join(user_factors.select("userId", "features"), "userId")
    cf = block_topk(known, item_factors.select("movieId", "features"), n, left_id="userId",
                    right_id="movieId", exclude=seen, score_name="score")
    cf = cf.withColumn("strategy", F.lit("collaborative_filtering"))
    unknown = req.join(user_factors.select("userId"), "userId", "left_anti")
    fb = attach_list(unknown, popular.filter(F.col("rank") <= n), ["movieId", "score", "rank"])
    fb = fb.withColumn("strategy", F.lit("popular_fallback"))
    return cf.unionByName(fb.select("userId", "movieId", F.col("score").cast("double"),
                                    F.col("rank").cast("bigint"), "strategy"))


def similar_items(item_factors: DataFrame, n: int = 10, items: DataFrame | None = None) -> DataFrame:
    """Top-n other items by cosine of the factor vectors.
    Result: movieId, similar_movieId, similarity, rank."""
    left = item_factors.select("movieId", "features")
    if items is not None:
        left = left.join(items.select("movieId"), "movieId", "left_semi")
    right = item_factors.select(F.col("movieId").alias("similar_movieId"), "features")
    return block_topk(left, right, n, left_id="movieId", right_id="similar_movieId",
                      cosine=True, exclude_self=True, score_name="similarity")


def with_titles(recs: DataFrame, movies: DataFrame) -> DataFrame:
    """Recommendations with title and genres (left join)."""
    return recs.join(movies.select("movieId", "title", "genres"), "movieId", "left")


def blend_topn(users: DataFrame, explicit: tuple[DataFrame, DataFrame, float], implicit: tuple[DataFrame, DataFrame],
               n: int = 10, w_explicit: float = 0.6, w_implicit: float = 0.4, seen: DataFrame | None = None) -> DataFrame:
    """Top n per user by the weighted blend of the explicit prediction
    (clipped to 0.5 .. 5) and the implicit score (clipped to 0 .. 5).

    Both models are scored inside the blocked kernel over every item that both
    know, so no item is lost to a cut of either list.  ``explicit`` is (user
    factors, item factors, mean), ``implicit`` (user factors, item factors);
    users without factors of both models have no blend.
    Result: userId, movieId, blend, rank."""
    (ue, ie, mu), (ui, ii) = explicit, implicit
    width = ie.select(F.size("features").alias("w")).first()
    both = lambda a, b, key: a.select(key, "bias", F.col("features").alias("_f")).join(
        b.select(key, F.col("features").alias("_g")), key).select(key, "bias", F.concat("_f", "_g").alias("features"))
    left = both(ue, ui, "userId").join(users.select("userId").distinct(), "userId", "left_semi")
    return block_topk(left, both(ie, ii, "movieId"), n, left_id="userId", right_id="movieId", left_bias="bias",
                      right_bias="bias", offset=float(mu), lo=0.5, hi=5.0, exclude=seen, score_name="blend",
                      blend={"width": int(width["w"]) if width else 0, "first": w_explicit, "second": w_implicit,
                             "lo": 0.0, "hi": 5.0})

