"""Query plans for model training on the temporal split."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.operators import metrics, models, prep, scoring, sgd
from recspark.plans.registry import register
from recspark.session import scratch_path
from recspark.sources import global_mean, item_factors_view, ratings_view, user_factors_view

_TRAIN = "tr AS (SELECT userId, movieId, rating FROM temporal_split WHERE split = 'train')"


def bias_sweeps_sql(reg_user: float, reg_item: float, sweeps: int, train_cte: str = _TRAIN,
                    prefix: str = "") -> tuple[str, str, str]:
    """CTE text for the damped bias sweeps; returns (ctes, user_table, item_table)."""
    p = prefix
    ctes = [train_cte.replace("tr AS", f"{p}tr AS"),
            f"{p}m AS (SELECT avg(rating) AS mu FROM {p}tr)"]
    prev_u = None
    for s in range(1, sweeps + 1):
        if prev_u is None:
            ctes.append(f"{p}bi{s} AS (SELECT movieId, sum(rating - (SELECT mu FROM {p}m)) / "
                        f"({reg_item!r} + count(*)) AS bias FROM {p}tr GROUP BY movieId)")
        else:
            ctes.append(f"{p}bi{s} AS (SELECT t.movieId, sum(t.rating - (SELECT mu FROM {p}m) - coalesce(u.bias, 0)) / "
                        f"({reg_item!r} + count(*)) AS bias FROM {p}tr t LEFT JOIN {prev_u} u ON t.userId = u.userId "
                        f"GROUP BY t.movieId)")
        ctes.append(f"{p}bu{s} AS (SELECT t.userId, sum(t.rating - (SELECT mu FROM {p}m) - coalesce(b.bias, 0)) / "
                    f"({reg_user!r} + count(*)) AS bias FROM {p}tr t LEFT JOIN {p}bi{s} b ON t.movieId = b.movieId "
                    f"GROUP BY t.userId)")
        prev_u = f"{p}bu{s}"
    return ",\n".join(ctes), f"{p}bu{sweeps}", f"{p}bi{sweeps}"


_C, _U, _I = bias_sweeps_sql(15.0, 10.0, 3)


def _split(spark, sf, write=False):
    return prep.temporal_split(ratings_view(spark, sf, write=write))


@register("bias_model", f"WITH {_C}\nSELECT 'user' AS kind, userId AS id, bias FROM {_U} "
          f"UNION ALL SELECT 'item', movieId, bias FROM {_I}", ["temporal_split"], round_cols=["bias"])
def bias_model(spark, sf):
    """M4 part 1 (A17): global mean and three damped bias sweeps on the train split."""
    split = _split(spark, sf)
    _, bu, bi = models.fit_biases(split.filter(F.col("split") == "train"), 15.0, 10.0, 3)
    return bu.select(F.lit("user").alias("kind"), F.col("userId").alias("id"), "bias").unionByName(
        bi.select(F.lit("item").alias("kind"), F.col("movieId").alias("id"), "bias"))


@register("bias_accuracy", f"""WITH {_C},
sc AS (SELECT v.rating, greatest(0.5, least(5.0, (SELECT mu FROM m) + coalesce(u.bias, 0) + coalesce(i.bias, 0))) AS p
       FROM temporal_split v LEFT JOIN {_U} u ON v.userId = u.userId LEFT JOIN {_I} i ON v.movieId = i.movieId
       WHERE v.split = 'val')
SELECT sqrt(avg((p - rating) * (p - rating))) AS rmse, avg(abs(p - rating)) AS mae, count(*) AS n_scored,
       0::BIGINT AS n_dropped FROM sc""", ["temporal_split"], round_cols=["rmse", "mae"])
def bias_accuracy(spark, sf):
    """A8/A9 of the bias model on the validation split."""
    split = _split(spark, sf)
    mu, bu, bi = models.fit_biases(split.filter(F.col("split") == "train"), 15.0, 10.0, 3)
    val = split.filter(F.col("split") == "val").select("userId", "movieId", "rating")
    return metrics.accuracy(models.bias_predict(val, mu, bu, bi))


@register("mf_train")
def mf_train(spark, sf):
    """M4: biased MF (rank 8, 5 ALS iterations) on train; accuracy per split."""
    split = _split(spark, sf).cache()
    model = models.fit_explicit(split.filter(F.col("split") == "train"), rank=8, max_iter=5, reg=0.1)
    scored = model.predict(split.select("userId", "movieId", "rating", "split"))
    return scored.groupBy("split").agg(
        F.sqrt(F.avg((F.col("predicted_rating") - F.col("rating")) ** 2)).alias("rmse"),
        F.avg(F.abs(F.col("predicted_rating") - F.col("rating"))).alias("mae"),
        F.count(F.lit(1)).alias("n"))


@register("mf_sgd_train")
def mf_sgd_train(spark, sf):
    """M4: biased MF by gradient descent (50 factors, 10 epochs, learning rate
    0.005, regularisation 0.02) on train; accuracy per split."""
    split = _split(spark, sf, write=True)
    model = sgd.fit_sgd(split.filter(F.col("split") == "train"))
    scored = model.predict(split.select("userId", "movieId", "rating", "split"))
    return scored.groupBy("split").agg(
        F.sqrt(F.avg((F.col("predicted_rating") - F.col("rating")) ** 2)).alias("rmse"),
        F.avg(F.abs(F.col("predicted_rating") - F.col("rating"))).alias("mae"),
        F.count(F.lit(1)).alias("n"))


@register("als_train")
def als_train(spark, sf):
    """M6 + M9: implicit ALS (rank 8, 5 iterations) on train confidences; top-10
    for every user, popular fallback for users unseen in training."""
    ratings = ratings_view(spark, sf, write=True)
    split = prep.temporal_split(ratings)
    train = prep.implicit_confidence(split.filter(F.col("split") == "train"))
    model = models.fit_implicit(train, rank=8, max_iter=5, reg=0.01, alpha=1.0)
    popular = scoring.popular_items(prep.merge_duplicates(train.select("userId", "movieId", "rating")), 10)
    users = ratings.select("userId").distinct()
    return model.recommend(users, 10, seen=train.select("userId", "movieId"), popular=popular)


@register("model_roundtrip", """
SELECT r.userId, r.movieId, r.rating,
       greatest(0.5, least(5.0, (SELECT mu FROM mu) + coalesce(uf.bias, 0) + coalesce(i.bias, 0)
                + coalesce(list_dot_product(uf.features, i.features), 0))) AS predicted_rating,
       uf.features IS NOT NULL AS known_user, i.features IS NOT NULL AS known_item,
       NOT (uf.features IS NOT NULL AND i.features IS NOT NULL) AS was_impossible
FROM temporal_split r LEFT JOIN user_factors uf ON r.userId = uf.userId
LEFT JOIN item_factors i ON r.movieId = i.movieId WHERE r.split = 'test'""",
          ["temporal_split", "user_factors", "item_factors", "mu"], round_cols=["rating", "predicted_rating"])
def model_roundtrip(spark, sf):
    """Save the fixture's factor model to the shared folder, load it, and
    predict the test split with what was loaded."""
    ratings = ratings_view(spark, sf, persist=True)
    model = models.FactorModel(global_mean(ratings), user_factors_view(spark, sf, ratings), item_factors_view(spark, sf))
    path = scratch_path(spark, "model")
    models.save_model(model, path)
    test = prep.temporal_split(ratings).filter(F.col("split") == "test")
    return models.load_model(spark, path).predict(test.select("userId", "movieId", "rating"))


@register("als_similar_items")
def als_similar_items(spark, sf):
    """Similar items by cosine of trained implicit-ALS item factors."""
    split = _split(spark, sf, write=True)
    train = prep.implicit_confidence(split.filter(F.col("split") == "train"))
    model = models.fit_implicit(train, rank=8, max_iter=5, reg=0.01)
    return model.similar(10)
