"""Matrix-factorisation models (M4, M6) and model persistence.

* ``fit_biases``   μ plus K damped alternating sweeps of item and user biases,
                   each a join + aggregate; bias tables are written to the
                   shared folder as they are made, which cuts the lineage and
                   drops the shuffle files of a sweep.
* ``fit_explicit`` biased MF: biases, then MLlib ALS (explicit) on the
                   residual r - μ - b_u - b_i.  r̂ = μ + b_u + b_i + p_u·q_i.
* ``fit_implicit`` MLlib ALS with implicit preferences on merged interactions.

All models are ``FactorModel``s: factor tables ``(id, bias, features)`` and μ,
scored by the operators in ``recspark.operators.scoring``.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.operators import prep, scoring
from recspark.session import checkpoint_dir, drop_path, garbage_collected, written

INT32_MAX = 2 ** 31 - 1


@dataclass
class FactorModel:
    """A fitted model: global mean, user and item factor tables, kind."""

    mu: float
    user_factors: DataFrame  # userId, bias, features
    item_factors: DataFrame  # movieId, bias, features
    kind: str = "explicit"  # or "implicit"
    params: dict = field(default_factory=dict)
    train_stats: dict = field(default_factory=dict)
    tables: list[str] = field(default_factory=list)  # in the shared folder, read by this model alone

    def drop(self) -> None:
        """Delete the model's own tables; it is of no use afterwards."""
        for path in self.tables:
            drop_path(self.user_factors.sparkSession, path)

    def predict(self, pairs: DataFrame) -> DataFrame:
        if self.kind == "implicit":
            return scoring.predict_implicit(pairs, self.user_factors, self.item_factors)
        return scoring.predict_explicit(pairs, self.user_factors, self.item_factors, self.mu)

    def recommend(self, users: DataFrame, n: int = 10, seen: DataFrame | None = None,
                  candidates: DataFrame | None = None, popular: DataFrame | None = None) -> DataFrame:
        if self.kind == "implicit":
            if popular is None:
                raise ValueError("implicit recommend needs a popular-items table for unknown users")
            return scoring.recommend_implicit(users, self.user_factors, self.item_factors, popular, n, seen,
                                              candidates=candidates)
        return scoring.recommend_explicit(users, self.user_factors, self.item_factors, self.mu, n,
                                          seen=seen, candidates=candidates)

    def similar(self, n: int = 10, items: DataFrame | None = None) -> DataFrame:
        return scoring.similar_items(self.item_factors, n, items)


# ---------------------------------------------------------------- biases


def fit_biases(train: DataFrame, reg_user: float = 15.0, reg_item: float = 10.0,
               sweeps: int = 3, mu: float | None = None, checkpoint_every: int = 1):
    """μ and damped biases: b_i = Σ(r-μ-b_u)/(λ_i+n_i), b_u = Σ(r-μ-b_i)/(λ_u+n_u),
    starting from b_u = 0.  Returns (mu, user_bias(userId, bias), item_bias(movieId, bias)).

    The bias tables are written to the shared folder every
    ``checkpoint_every`` sweeps and after the last one, each as soon as it is
    built: the returned tables are materialised once, so a model's factor
    tables never re-run the sweeps over the training data."""
    r = train.select("userId", "movieId", F.col("rating").cast("double").alias("rating"))
    if mu is None:
        mu = float(r.agg(F.avg("rating")).first()[0] or 0.0)  # no ratings: no offset
    m = F.lit(float(mu))
    n_sweeps = max(1, int(sweeps))
    if checkpoint_every:
        checkpoint_dir(train.sparkSession)
    bu = None
    bi = None
    for s in range(n_sweeps):
        cut = bool(checkpoint_every) and ((s + 1) % checkpoint_every == 0 or s + 1 == n_sweeps)
        base = r if bu is None else r.join(bu.withColumnRenamed("bias", "_bu"), "userId", "left")
        res = F.col("rating") - m - (F.coalesce(F.col("_bu"), F.lit(0.0)) if bu is not None else F.lit(0.0))
        bi = base.groupBy("movieId").agg(
            (F.sum(res) / (F.lit(float(reg_item)) + F.count(F.lit(1)))).alias("bias"))
        bi = written(bi, "bias") if cut else bi
        res_u = F.col("rating") - m - F.coalesce(F.col("_bi"), F.lit(0.0))
        bu = (r.join(bi.withColumnRenamed("bias", "_bi"), "movieId", "left")
              .groupBy("userId").agg((F.sum(res_u) / (F.lit(float(reg_user)) + F.count(F.lit(1))))
                                     .alias("bias")))
        bu = written(bu, "bias") if cut else bu
    return mu, bu, bi


def bias_predict(pairs: DataFrame, mu: float, user_bias: DataFrame, item_bias: DataFrame,
                 lo: float = 0.5, hi: float = 5.0) -> DataFrame:
    """Prediction of the bias-only model, clipped."""
    j = (pairs.join(user_bias.withColumnRenamed("bias", "_bu"), "userId", "left")
         .join(item_bias.withColumnRenamed("bias", "_bi"), "movieId", "left"))
    est = F.lit(float(mu)) + F.coalesce("_bu", F.lit(0.0)) + F.coalesce("_bi", F.lit(0.0))
    return j.select(*pairs.columns, F.greatest(F.lit(lo), F.least(F.lit(hi), est)).alias("predicted_rating"))


# ---------------------------------------------------------------- ALS helpers


#: ratings of an ALS block at most: a task holds several copies of its block's ratings
ALS_BLOCK = 8_000_000


def _default_blocks(spark: SparkSession, ratings: int) -> int:
    """One ALS block per core of the cluster (at least 2), more for many ratings."""
    return max(2, spark.sparkContext.defaultParallelism, math.ceil(ratings / ALS_BLOCK))


def _fit_als(als: ALS, data: DataFrame, ratings: int, blocks: int | None):
    """The fitted model.  With many ratings the factors are checkpointed in each
    iteration and the driver's garbage is collected, so that the shuffles of an
    iteration are deleted after it."""
    spark = data.sparkSession
    blocks = blocks or _default_blocks(spark, ratings)
    als = als.setNumUserBlocks(blocks).setNumItemBlocks(blocks)
    if ratings <= ALS_BLOCK:
        return als.fit(data)
    with garbage_collected(spark):
        return als.setCheckpointInterval(1).fit(data)


def _int_id_maps(df: DataFrame):
    """ALS takes int32 ids.  Returns (None, None, rows) when the ids fit; otherwise
    dense 0-based maps (exact distributed positions, M1) for users and items, and the rows."""
    mx = df.agg(F.max("userId"), F.max("movieId"), F.min("userId"), F.min("movieId"), F.count(F.lit(1))).first()
    if max(mx[0] or 0, mx[1] or 0) <= INT32_MAX and min(mx[2] or 0, mx[3] or 0) >= 0:
        return None, None, mx[4]
    return (prep.dense_index(df, "userId", "_uidx"), prep.dense_index(df, "movieId", "_iidx"), mx[4])


def _to_als_ids(df: DataFrame, umap, imap) -> DataFrame:
    if umap is None:
        return (df.withColumn("userId", F.col("userId").cast("int"))
                .withColumn("movieId", F.col("movieId").cast("int")))
    return (df.join(umap, "userId").join(imap, "movieId")
            .drop("userId", "movieId")
            .withColumnRenamed("_uidx", "userId").withColumnRenamed("_iidx", "movieId")
            .withColumn("userId", F.col("userId").cast("int"))
            .withColumn("movieId", F.col("movieId").cast("int")))


def _original_ids(factors: DataFrame, id_map, id_col: str, idx_col: str) -> DataFrame:
    if id_map is None:
        return factors
    return (factors.withColumnRenamed(id_col, idx_col).join(id_map, idx_col).drop(idx_col)
            .select(id_col, *[c for c in factors.columns if c != id_col]))


def _factors(model, umap, imap, bias_users: DataFrame | None, bias_items: DataFrame | None):
    uf = model.userFactors.select(F.col("id").cast("bigint").alias("userId"), "features")
    itf = model.itemFactors.select(F.col("id").cast("bigint").alias("movieId"), "features")
    uf = _original_ids(uf, umap, "userId", "_uidx")
    itf = _original_ids(itf, imap, "movieId", "_iidx")
    if bias_users is not None:
        uf = bias_users.join(uf, "userId", "full").select(
            "userId", F.coalesce("bias", F.lit(0.0)).alias("bias"), "features")
        itf = bias_items.join(itf, "movieId", "full").select(
            "movieId", F.coalesce("bias", F.lit(0.0)).alias("bias"), "features")
    else:
        uf = uf.select("userId", F.lit(0.0).alias("bias"), "features")
        itf = itf.select("movieId", F.lit(0.0).alias("bias"), "features")
    return uf, itf


def fit_explicit(train: DataFrame, rank: int = 50, max_iter: int = 10, reg: float = 0.1,
                 reg_user: float = 15.0, reg_item: float = 10.0, sweeps: int = 3,
                 seed: int = 42, blocks: int | None = None, biases: tuple | None = None) -> FactorModel:
    """M4: biased matrix factorisation (biases by sweeps, then ALS on residuals).
    ``biases`` is what ``fit_biases`` gave for the same settings, if it ran."""
    spark = train.sparkSession
    checkpoint_dir(spark)  # ALS checkpoints its factor RDDs there
    umap, imap, n = _int_id_maps(train)
    t0 = time.time()
    mu, bu, bi = biases or fit_biases(train, reg_user, reg_item, sweeps)
    resid = (train.join(bu.withColumnRenamed("bias", "_bu"), "userId", "left")
             .join(bi.withColumnRenamed("bias", "_bi"), "movieId", "left")
             .select("userId", "movieId",
                     (F.col("rating") - F.lit(mu) - F.coalesce("_bu", F.lit(0.0))
                      - F.coalesce("_bi", F.lit(0.0))).alias("resid")))
    resid = _to_als_ids(resid, umap, imap)
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, userCol="userId", itemCol="movieId",
              ratingCol="resid", implicitPrefs=False, seed=seed, coldStartStrategy="nan",
              nonnegative=False)
    # ALS reads its input once and persists its own blocked copy; but the shuffles of
    # the joins would stay as long as it, several times the residual
    model = _fit_als(als, written(resid, "resid") if n > ALS_BLOCK else resid, n, blocks)
    uf, itf = _factors(model, umap, imap, bu, bi)
    params = dict(rank=rank, max_iter=max_iter, reg=reg, reg_user=reg_user, reg_item=reg_item,
                  sweeps=sweeps, seed=seed)
    return FactorModel(mu, uf, itf, "explicit", params, {"training_time": time.time() - t0})


def fit_implicit(interactions: DataFrame, rank: int = 64, max_iter: int = 15, reg: float = 0.01,
                 alpha: float = 1.0, seed: int = 42, blocks: int | None = None) -> FactorModel:
    """M6: implicit-feedback ALS on duplicate-merged interactions."""
    spark = interactions.sparkSession
    checkpoint_dir(spark)
    # the merge is read by the id check and by ALS: written once, its shuffle is gone
    merged = written(prep.merge_duplicates(interactions.select("userId", "movieId", "rating")), "merged")
    umap, imap, n = _int_id_maps(merged)
    t0 = time.time()
    data = _to_als_ids(merged, umap, imap)
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha, userCol="userId",
              itemCol="movieId", ratingCol="rating", implicitPrefs=True, seed=seed,
              coldStartStrategy="nan")
    model = _fit_als(als, data, n, blocks)
    uf, itf = _factors(model, umap, imap, None, None)
    params = dict(rank=rank, max_iter=max_iter, reg=reg, alpha=alpha, seed=seed)
    return FactorModel(0.0, uf, itf, "implicit", params, {"training_time": time.time() - t0})


# ---------------------------------------------------------------- persistence


def save_model(model: FactorModel, path: str, mode: str = "overwrite") -> None:
    """Factor tables as parquet plus a one-row meta table."""
    spark = model.user_factors.sparkSession
    model.user_factors.write.mode(mode).parquet(f"{path}/user_factors")
    model.item_factors.write.mode(mode).parquet(f"{path}/item_factors")
    meta = json.dumps({"mu": model.mu, "kind": model.kind, "params": model.params,
                       "train_stats": model.train_stats})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode(mode).json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> FactorModel:
    """Read a model written by ``save_model``."""
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
    uf = spark.read.parquet(f"{path}/user_factors")
    itf = spark.read.parquet(f"{path}/item_factors")
    return FactorModel(meta["mu"], uf, itf, meta["kind"], meta.get("params", {}), meta.get("train_stats", {}))
