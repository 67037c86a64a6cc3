"""Accuracy and recommendation-quality metrics.

Inputs are long tables: ``recs(userId, movieId, rank)`` and
``relevant(userId, movieId[, gain])``.  Every metric is a join plus
aggregates; per-list metrics that need all pairs of a list (diversity) fold
over the list with JVM higher-order functions on the user's top-k array, whose
length is bounded by k, so no pair rows are produced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recspark.functions.vectors import cosine, dot, norm


# ---------------------------------------------------------------- accuracy


def accuracy(scored: DataFrame, actual: str = "rating", predicted: str = "predicted_rating") -> DataFrame:
    """A8/A9 (+P15): rmse and mae over rows with a prediction; rows without one
    are counted in ``n_dropped``."""
    ok = F.col(predicted).isNotNull() & F.col(actual).isNotNull()
    err = F.when(ok, F.col(predicted) - F.col(actual))
    return scored.agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.count(err).alias("n_scored"),
        F.sum(F.when(ok, 0).otherwise(1)).cast("bigint").alias("n_dropped"))


# ---------------------------------------------------------------- ranking


def _hits(recs: DataFrame, relevant: DataFrame, gain: str | None) -> DataFrame:
    # one row per pair: a relevant item that is listed twice is one hit
    rel = relevant.groupBy("userId", "movieId").agg(
        (F.max(F.col(gain).cast("double")) if gain else F.lit(1.0)).alias("_gain"))
    return recs.select("userId", "movieId", "rank").join(rel, ["userId", "movieId"], "left")


def _n_relevant(relevant: DataFrame) -> DataFrame:
    return relevant.groupBy("userId").agg(F.count(F.lit(1)).alias("n_relevant"))


def _binary_idcg(k: Column, n_rel: Column) -> Column:
    idx = F.sequence(F.lit(1), F.least(k, n_rel).cast("int"))
    return F.when(F.least(k, n_rel) < 1, F.lit(0.0)).otherwise(
        F.aggregate(idx, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1)))


def ranking_metrics(recs: DataFrame, relevant: DataFrame, ks=(5, 10, 20),
                    gain: str | None = None) -> DataFrame:
    """E1, E2, E4 per user and k: precision@k (hits / k), recall@k
    (hits / |relevant|), ndcg@k (binary, or graded by ``gain``).

    Only users with at least one relevant item are scored (as the reference
    does); users without recommendations score 0.
    Result: userId, k, precision, recall, ndcg.
    """
    ks = sorted({int(k) for k in ks})
    hits = _hits(recs, relevant, gain)
    is_hit = F.col("_gain").isNotNull()
    aggs = []
    for k in ks:
        in_k = is_hit & (F.col("rank") <= k)
        aggs.append(F.sum(F.when(in_k, 1).otherwise(0)).alias(f"_h{k}"))
        aggs.append(F.sum(F.when(in_k, F.col("_gain") / F.log2(F.col("rank") + 1)).otherwise(0.0))
                    .alias(f"_d{k}"))
    per_user = hits.groupBy("userId").agg(*aggs)
    users = _n_relevant(relevant)
    if gain:
        # ideal order: gains sorted desc, first max(k) (WindowGroupLimit keeps it partial)
        w = Window.partitionBy("userId").orderBy(F.col(gain).desc(), F.col("movieId"))
        top = (relevant.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= max(ks)))
        ideal = top.groupBy("userId").agg(*[
            F.sum(F.when(F.col("_i") <= k, F.col(gain) / F.log2(F.col("_i") + 1)).otherwise(0.0))
            .alias(f"_id{k}") for k in ks])
        users = users.join(ideal, "userId", "left")
    base = users.join(per_user, "userId", "left")
    rows = []
    for k in ks:
        h = F.coalesce(F.col(f"_h{k}"), F.lit(0))
        d = F.coalesce(F.col(f"_d{k}"), F.lit(0.0))
        idcg = F.col(f"_id{k}") if gain else _binary_idcg(F.lit(k), F.col("n_relevant"))
        rows.append(F.struct(
            F.lit(k).cast("bigint").alias("k"),
            (h / F.lit(float(k)) if k > 0 else F.lit(0.0)).alias("precision"),
            (h / F.col("n_relevant")).alias("recall"),
            F.when(F.coalesce(idcg, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(d / idcg).alias("ndcg")))
    # one row per (user, k) from a single pass over the per-user table
    return base.select("userId", F.explode(F.array(*rows)).alias("_m")).select("userId", "_m.*")


def mean_ranking_metrics(per_user: DataFrame) -> DataFrame:
    """Mean over users per k."""
    return per_user.groupBy("k").agg(F.avg("precision").alias("precision"),
                                     F.avg("recall").alias("recall"),
                                     F.avg("ndcg").alias("ndcg"),
                                     F.count(F.lit(1)).alias("n_users"))


def average_precision(recs: DataFrame, relevant: DataFrame) -> DataFrame:
    """Σ precision at each hit / |relevant| over the whole list; MAP = mean.
    Result per user: userId, average_precision."""
    hits = _hits(recs, relevant, None).withColumn("_hit", F.col("_gain").isNotNull().cast("int"))
    # a user's list has at most n rows, so this window partition is bounded
    w = Window.partitionBy("userId").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    prec = hits.withColumn("_cum", F.sum("_hit").over(w))
    per_user = prec.groupBy("userId").agg(
        F.sum(F.when(F.col("_hit") == 1, F.col("_cum") / F.col("rank")).otherwise(0.0)).alias("_s"))
    return _n_relevant(relevant).join(per_user, "userId", "left").select(
        "userId", (F.coalesce("_s", F.lit(0.0)) / F.col("n_relevant")).alias("average_precision"))


def precision_set_at_k(recs: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """|set(top-k) ∩ set(relevant)| / k per user with relevant items."""
    hits = (recs.filter(F.col("rank") <= k).select("userId", "movieId")
            .join(relevant.select("userId", "movieId").distinct(), ["userId", "movieId"])
            .groupBy("userId").agg(F.count(F.lit(1)).alias("_h")))
    users = relevant.select("userId").distinct()
    return users.join(hits, "userId", "left").select(
        "userId", (F.coalesce("_h", F.lit(0)) / F.lit(float(k))).alias("precision_set"))


# ---------------------------------------------------------------- catalogue-level


def catalog_coverage(recs: DataFrame, total_items: int | DataFrame) -> DataFrame:
    """E5 (U2): distinct recommended items / catalogue size."""
    if isinstance(total_items, DataFrame):
        total_items = total_items.select("movieId").distinct().count()
    return recs.agg(F.countDistinct("movieId").alias("n_recommended")).select(
        "n_recommended", F.lit(int(total_items)).cast("bigint").alias("n_items"),
        (F.col("n_recommended") / F.lit(float(total_items))).alias("coverage"))


def _pairwise_mean(arr: Column, dist) -> Column:
    """Mean of dist(a_i, a_j) over i < j of an array; 1.0 for lists of <= 1."""
    size = F.size(arr)
    inner = lambda i: F.aggregate(
        F.sequence(i + 1, size - 1), F.lit(0.0), lambda acc, j: acc + dist(arr[i], arr[j]))
    total = F.aggregate(F.sequence(F.lit(0), size - 2), F.lit(0.0), lambda acc, i: acc + inner(i))
    return F.when(size <= 1, F.lit(1.0)).otherwise(total / (size * (size - 1) / 2.0))


def diversity_similarity(recs: DataFrame, item_factors: DataFrame, k: int | None = None) -> DataFrame:
    """Mean over pairs of 1 - cosine(item factors).  Items without factors
    are dropped from the list; a zero vector is similar to none.  Result: userId,
    diversity, for every user with recommendations.

    With unit vectors u_i the pair sum is closed-form,
    Σ_{i<j} u_i·u_j = (|Σ u_i|² - Σ |u_i|²) / 2, so a list costs O(k·d)
    instead of a loop over its k(k-1)/2 pairs."""
    r = recs if k is None else recs.filter(F.col("rank") <= k)
    # the norm is an argument of array_repeat (evaluated once per item), not
    # a reference inside the lambda, which the optimizer would inline per element
    f = F.col("features")
    unit = item_factors.select("movieId", F.zip_with(f, F.array_repeat(norm(f), F.size(f)),
                                                     lambda x, nv: F.coalesce(F.try_divide(x.cast("double"), nv), F.lit(0.0)))
                       .alias("_u"))
    lists = r.join(unit, "movieId").groupBy("userId").agg(
        F.collect_list("_u").alias("_l"), F.count(F.lit(1)).alias("_k"))
    width = F.size(F.col("_l")[0])
    total = F.aggregate("_l", F.array_repeat(F.lit(0.0), width),
                        lambda acc, u: F.zip_with(acc, u, lambda a, b: a + b))
    sq = F.aggregate(total, F.lit(0.0), lambda acc, x: acc + x * x)
    self_sq = F.aggregate("_l", F.lit(0.0), lambda acc, u: acc + dot(u, u))
    n = F.col("_k")
    mean_cos = (sq - self_sq) / (n * (n - 1))
    lists = lists.select("userId", F.when(n <= 1, F.lit(1.0)).otherwise(1.0 - mean_cos).alias("diversity"))
    # a user none of whose items has factors keeps a list of no items
    return r.select("userId").distinct().join(lists, "userId", "left").select(
        "userId", F.coalesce("diversity", F.lit(1.0)).alias("diversity"))


def diversity_features(recs: DataFrame, movies: DataFrame, k: int | None = None) -> DataFrame:
    """Mean Jaccard distance of genre sets over pairs; a pair of two empty
    sets counts but adds 0; lists of <= 1 item score 1.0.  Items missing from
    ``movies`` have the empty set."""
    r = recs if k is None else recs.filter(F.col("rank") <= k)
    feats = movies.select("movieId", F.split(F.col("genres"), r"\|").alias("_g"))
    j = r.join(feats, "movieId", "left").withColumn(
        "_g", F.coalesce("_g", F.array().cast("array<string>")))
    lists = j.groupBy("userId").agg(F.collect_list(F.struct("rank", "_g")).alias("_l"))
    lists = lists.select("userId", F.transform(F.array_sort("_l"), lambda s: s["_g"]).alias("_a"))

    def jdist(a, b):
        union = F.size(F.array_union(a, b))
        return F.when(union > 0, 1.0 - F.size(F.array_intersect(a, b)) / union).otherwise(0.0)

    return lists.select("userId", _pairwise_mean(F.col("_a"), jdist).alias("diversity"))


def novelty(recs: DataFrame, interactions: DataFrame) -> DataFrame:
    """Per list, mean of -log2(count(item) / total interactions); an item
    never interacted with contributes 0."""
    total = interactions.count()
    pop = interactions.groupBy("movieId").agg(F.count(F.lit(1)).alias("_pop"))
    j = recs.join(pop, "movieId", "left")
    p = F.coalesce(F.col("_pop"), F.lit(0)) / F.lit(float(total) if total else 1.0)
    info = F.when(p > 0, -F.log2(p)).otherwise(F.lit(0.0))
    return j.groupBy("userId").agg(F.avg(info).alias("novelty"))


def common_users(a: DataFrame, b: DataFrame) -> DataFrame:
    """Users known to both models."""
    return a.select("userId").intersect(b.select("userId"))


# ---------------------------------------------------------------- model evaluation


def evaluate_model(scored_test: DataFrame, recs: DataFrame, test: DataFrame,
                   ks=(5, 10, 20)) -> DataFrame:
    """Rmse / mae over every scored test row, precision / recall / ndcg
    for each k over every user with test items, from one scoring at max k.
    Result (metric, k, value); k is 0 for accuracy metrics."""
    acc = accuracy(scored_test)
    rows = acc.select(F.explode(F.array(
        F.struct(F.lit("rmse").alias("metric"), F.col("rmse").alias("value")),
        F.struct(F.lit("mae").alias("metric"), F.col("mae").alias("value")))).alias("m"))
    rows = rows.select("m.metric", F.lit(0).cast("bigint").alias("k"), "m.value")
    means = mean_ranking_metrics(ranking_metrics(recs, test, ks))
    rank_rows = means.select("k", F.explode(F.array(
        F.struct(F.lit("precision").alias("metric"), F.col("precision").alias("value")),
        F.struct(F.lit("recall").alias("metric"), F.col("recall").alias("value")),
        F.struct(F.lit("ndcg").alias("metric"), F.col("ndcg").alias("value")))).alias("m"))
    return rows.unionByName(rank_rows.select("m.metric", "k", "m.value"))


def metric_panel(scored_test: DataFrame, recs: DataFrame, test: DataFrame, movies: DataFrame,
                 n_items: int, k: int = 10,
                 metrics=("rmse", "mae", "precision", "recall", "ndcg", "coverage", "diversity")) -> DataFrame:
    """The configured metric panel in one (metric, value) table."""
    acc = accuracy(scored_test).select("rmse", "mae")
    rank = mean_ranking_metrics(ranking_metrics(recs, test, [k])).select("precision", "recall", "ndcg")
    cov = catalog_coverage(recs.filter(F.col("rank") <= k), n_items).select("coverage")
    div = diversity_features(recs, movies, k).agg(F.avg("diversity").alias("diversity"))
    # each one-row part is computed once; its requested metrics become rows
    parts = [(acc, ("rmse", "mae")), (rank, ("precision", "recall", "ndcg")),
             (cov, ("coverage",)), (div, ("diversity",))]
    unknown = set(metrics) - {m for _, names in parts for m in names}
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    out = None
    for df, names in parts:
        want = [m for m in names if m in metrics]
        if not want:
            continue
        piece = df.select(F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in want]))
            .alias("_m")).select("_m.metric", "_m.value")
        out = piece if out is None else out.unionByName(piece)
    return out
