"""Serving tables: materialised top-N with strategy (V1), request-log metrics
(V2), latency EMA (V3/W6) and health status (V4).

The reference serves one request at a time with an in-process cache; here the
same decisions are made for a whole request log at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.functions.hashing import ab_group
from recspark.operators import ema, scoring
from recspark.session import scratch_path

EMA_ALPHA = 0.1


def serve_batch(requests: DataFrame, user_factors: DataFrame, item_factors: DataFrame,
                mu: float, popular: DataFrame, n: int = 10, seen: DataFrame | None = None,
                salt: str = "default") -> DataFrame:
    """V1: top-n for every requesting user.  Known users get the explicit
    model's list (strategy collaborative_filtering); unknown users get the
    popular list (popular_fallback).  Carries experiment group and n."""
    users = requests.select(F.col("user_id").alias("userId")).distinct()
    known = users.join(user_factors.select("userId"), "userId", "left_semi")
    cf = scoring.recommend_explicit(known, user_factors, item_factors, mu, n, seen=seen)
    cf = cf.select("userId", "movieId", F.col("predicted_rating").alias("score"), "rank",
                   F.lit("collaborative_filtering").alias("strategy"))
    unknown = users.join(user_factors.select("userId"), "userId", "left_anti")
    fb = scoring.attach_list(unknown, popular.filter(F.col("rank") <= n), ["movieId", "score", "rank"])
    fb = fb.select("userId", "movieId", F.col("score").cast("double"), F.col("rank").cast("bigint"),
                   F.lit("popular_fallback").alias("strategy"))
    out = cf.unionByName(fb)
    return out.select(F.col("userId").alias("user_id"), "movieId", "score", "rank", "strategy",
                      F.lit(int(n)).cast("bigint").alias("n"),
                      ab_group(F.col("userId"), salt).alias("experiment_group"))


#: partitions of a served table; a refresh reads and overwrites only those of changed users
SERVED_PARTS = 64
_PART = "part"


def _served_users(users: DataFrame, user_factors: DataFrame, item_factors: DataFrame, mu: float, n: int,
                  seen: DataFrame | None, salt: str, parts: int) -> DataFrame:
    """One row per user: the scored list, or a null list for users who get the
    popular one.  A known user with nothing left to recommend has an empty list."""
    users = users.select("userId").distinct()
    known = user_factors.select("userId", F.lit(True).alias("_known"))
    recs = scoring.recommend_explicit(users.join(known, "userId", "left_semi"), user_factors, item_factors, mu, n, seen=seen)
    items = recs.groupBy("userId").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank").cast("bigint").alias("rank"), "movieId", F.col("predicted_rating").alias("score")))).alias("items"))
    none = F.array().cast(items.schema["items"].dataType)
    return (users.join(known, "userId", "left").join(items, "userId", "left")
            .select(F.col("userId").alias("user_id"), ab_group(F.col("userId"), salt).alias("experiment_group"),
                    F.lit(int(n)).cast("bigint").alias("n"),
                    F.when(F.col("_known"), F.coalesce("items", none)).alias("items"),
                    _part(F.col("userId"), parts)))


def _part(user, parts: int):
    return F.pmod(F.xxhash64(user.cast("bigint")), F.lit(parts)).cast("int").alias(_PART)


def _write_served(users: DataFrame, popular: DataFrame, path: str, n: int) -> None:
    """Overwrites the partitions that ``users`` has rows in, and the popular list."""
    (users.repartition(_PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(_PART).parquet(f"{path}/users"))
    (popular.filter(F.col("rank") <= n).select("movieId", F.col("score").cast("double"), F.col("rank").cast("bigint"))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/popular"))


def write_served(path: str, users: DataFrame, user_factors: DataFrame, item_factors: DataFrame, mu: float,
                 popular: DataFrame, n: int = 10, seen: DataFrame | None = None, salt: str = "default",
                 parts: int = SERVED_PARTS) -> None:
    """V1 as a table under ``path``: the list of each of ``users`` (userId),
    partitioned by a hash of the user, and the popular list once.  Users without
    factors hold no list of their own, so a new popular list reaches them all."""
    _write_served(_served_users(users, user_factors, item_factors, mu, n, seen, salt, parts), popular, path, n)


def refresh_served(path: str, changed: DataFrame, user_factors: DataFrame, item_factors: DataFrame, mu: float,
                   popular: DataFrame, n: int = 10, seen: DataFrame | None = None, salt: str = "default",
                   parts: int = SERVED_PARTS) -> None:
    """V1 refresh: scores only the ``changed`` users (userId: new interactions, or
    not served before) and overwrites only their partitions; the other users of
    those partitions are copied.  The model, ``n``, ``salt`` and ``parts`` are
    those of ``write_served``; with them the table equals one built anew.

    New rows are written to the shared folder first, so the partitions are
    replaced by a plain copy, and a refresh that was cut short can be run again.
    Partitions and popular list are not replaced at one moment: readers wait for
    the refresh to end.
    No changed user leaves all partitions as they are.  Users repeat or not in
    ``changed`` alike."""
    spark = changed.sparkSession
    staged = scratch_path(spark, "served-new")
    _served_users(changed, user_factors, item_factors, mu, n, seen, salt, parts).write.parquet(staged)
    fresh = spark.read.parquet(staged)
    touched = [r[_PART] for r in fresh.select(_PART).distinct().collect()]  # at most `parts`
    old = spark.read.parquet(f"{path}/users").where(F.col(_PART).isin(touched))
    kept = old.join(fresh.select("user_id"), "user_id", "left_anti")
    merged = scratch_path(spark, "served-merged")
    kept.select(*fresh.columns).unionByName(fresh).write.parquet(merged)
    _write_served(spark.read.schema(fresh.schema).parquet(merged), popular, path, n)


def read_served(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``serve_batch`` from a served table, in one scan without a join."""
    users = spark.read.parquet(f"{path}/users")
    kind = users.schema["items"].dataType
    # the popular list has at most n rows
    popular = spark.read.parquet(f"{path}/popular").orderBy("rank").collect()
    listed = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("rank", "movieId", "score")]) for r in popular]).cast(kind)
    out = users.select(
        "user_id", "experiment_group", "n",
        F.when(F.col("items").isNull(), "popular_fallback").otherwise("collaborative_filtering").alias("strategy"),
        F.inline(F.coalesce("items", listed)))
    return out.select("user_id", "movieId", "score", "rank", "strategy", "n", "experiment_group")


def classify_requests(log: DataFrame, known_users: DataFrame) -> DataFrame:
    """V2 per request: cache_hit, cache_miss, error, fallback, latency_update.

    The reference checks the cache first, so a request is a hit exactly when
    an earlier request with the same (user, n, group) key succeeded.  The first
    success per key is a partial aggregate (hot keys are combined map-side) and
    is joined back; no per-key window sorts a hot key in one task.
    """
    key = ["user_id", "n", "experiment_group"]
    order = F.struct("ts", "event_id")
    first_ok = (log.filter(~F.col("is_error")).groupBy(*key)
                .agg(F.min(order).alias("_first_ok")))
    j = log.join(first_ok, key, "left")
    hit = F.col("_first_ok").isNotNull() & (order > F.col("_first_ok"))
    known = known_users.select(F.col("userId").alias("user_id"), F.lit(True).alias("_known"))
    j = j.join(known, "user_id", "left")
    miss = ~hit
    err = miss & F.col("is_error")
    ok_miss = miss & ~F.col("is_error")
    return j.select(
        *log.columns, hit.alias("cache_hit"), miss.alias("cache_miss"), err.alias("error"),
        (ok_miss & F.col("_known").isNull()).alias("cold_start_fallback"),
        ok_miss.alias("latency_update"))


def request_metrics(classified: DataFrame, by=()) -> DataFrame:
    """V2: requests, hits, misses, errors, fallbacks and rates (0 when there
    are no requests)."""
    def cnt(c):
        return F.sum(F.col(c).cast("int")).cast("bigint")

    m = classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), cnt("cache_hit").alias("cache_hits"),
        cnt("cache_miss").alias("cache_misses"), cnt("error").alias("errors"),
        cnt("cold_start_fallback").alias("cold_start_fallbacks"))
    return m.select(
        *by, "requests", "cache_hits", "cache_misses", "errors", "cold_start_fallbacks",
        F.when(F.col("requests") > 0, F.col("cache_hits") / F.col("requests")).otherwise(0.0)
        .alias("cache_hit_rate"),
        F.when(F.col("requests") > 0, F.col("errors") / F.col("requests")).otherwise(0.0)
        .alias("error_rate"))


def latency_ema(classified: DataFrame, alpha: float = EMA_ALPHA) -> DataFrame:
    """Exponential moving average of latency over successful misses in
    (ts, event_id) order, seeded by the first update while the average is 0.
    Every update counts: range partitions are folded to affine maps which are
    composed in order (``operators.ema``)."""
    n, value = ema.compose(ema.fold_parts(classified.filter(F.col("latency_update")), alpha))
    return classified.sparkSession.range(1).select(
        F.lit(float(value)).alias("avg_latency_ms"), F.lit(int(n)).cast("bigint").alias("n_updates"))


def health_status(metrics: DataFrame, latency: DataFrame, model_loaded: bool = True,
                  max_error_rate: float = 0.05, max_latency_ms: float = 100.0) -> DataFrame:
    """V4: healthy iff a model is loaded, error rate < 5 % and the latency
    average < 100 ms (zero requests: rates are 0)."""
    lat = latency.first()["avg_latency_ms"]
    healthy = (F.lit(bool(model_loaded)) & (F.col("error_rate") < max_error_rate)
               & (F.lit(float(lat)) < max_latency_ms))
    return metrics.select(
        F.when(healthy, "healthy").otherwise("unhealthy").alias("status"),
        F.lit(bool(model_loaded)).alias("model_loaded"), "requests", "error_rate",
        F.lit(float(lat)).alias("avg_latency_ms"))
