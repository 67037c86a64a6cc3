"""Rating-table preparation: profile, clean, features, samples, splits.

Covers summary / sparsity (A1, A2), activity filter (P4-P6), temporal and
genre features (P1-P3), user / movie statistics and enrichment (A3, A4, J1),
implicit conversions (P7), samples (P8, P9), id maps and splits (M1-M3) and
the descriptive aggregates A5-A7, A10-A15, A18, P12/J3.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recspark.functions.hashing import unit_hash
from recspark.operators.ordering import before, global_positions, keys_at

# ---------------------------------------------------------------- profile


def data_summary(ratings: DataFrame) -> DataFrame:
    """A1 + A2: one row with users, movies, ratings, rating and date range, sparsity."""
    agg = ratings.agg(
        F.countDistinct("userId").alias("n_users"),
        F.countDistinct("movieId").alias("n_movies"),
        F.count(F.lit(1)).alias("n_ratings"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.min("timestamp").alias("_min_ts"),
        F.max("timestamp").alias("_max_ts"),
    )
    return agg.select(
        "n_users", "n_movies", "n_ratings", "min_rating", "max_rating",
        _ts_ntz(F.col("_min_ts")).alias("min_datetime"),
        _ts_ntz(F.col("_max_ts")).alias("max_datetime"),
        _sparsity(F.col("n_ratings"), F.col("n_users"), F.col("n_movies")).alias("sparsity"),
    )


def _sparsity(n: Column, users: Column, movies: Column) -> Column:
    # empty input: NULL instead of an ANSI division error
    return (F.lit(1.0) - F.try_divide(n.cast("double"), users.cast("double") * movies.cast("double"))) * 100.0


def _ts_ntz(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch).cast("timestamp_ntz")


def sparsity(ratings: DataFrame) -> DataFrame:
    """A2: (1 - n / (users * movies)) * 100."""
    return data_summary(ratings).select("n_users", "n_movies", "n_ratings", "sparsity")


# ---------------------------------------------------------------- cleaning


def activity_filter(ratings: DataFrame, min_ratings_per_user: int = 20,
                    min_ratings_per_movie: int = 20, iterations: int = 1) -> DataFrame:
    """Keep users with >= min ratings, then movies with >= min on the rest.

    One pass each (the reference's behaviour); ``iterations`` > 1 repeats the
    pair of passes towards a k-core.  Counts are partial aggregates; the
    filters are semi-joins, which AQE broadcasts when the id list is small and
    splits by skew otherwise.
    """
    out = ratings
    for _ in range(max(1, iterations)):
        users = (out.groupBy("userId").agg(F.count(F.lit(1)).alias("_n"))
                 .filter(F.col("_n") >= min_ratings_per_user).select("userId"))
        out = out.join(users, "userId", "left_semi")
        movies = (out.groupBy("movieId").agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") >= min_ratings_per_movie).select("movieId"))
        out = out.join(movies, "movieId", "left_semi")
    return out


def restrict_movies(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """P5: catalogue rows whose movie still has a rating."""
    return movies.join(ratings.select("movieId"), "movieId", "left_semi")


def clean_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Removed, removed_pct, remaining, users, movies."""
    b = before.agg(F.count(F.lit(1)).alias("initial")).first()[0]
    a = after.agg(F.count(F.lit(1)).alias("remaining"),
                  F.countDistinct("userId").alias("n_users"),
                  F.countDistinct("movieId").alias("n_movies"))
    return a.select(
        (F.lit(b) - F.col("remaining")).cast("bigint").alias("removed"),
        (F.try_divide(F.lit(b) - F.col("remaining"), F.lit(float(b))) * 100.0).alias("removed_pct"),
        "remaining", "n_users", "n_movies")


# ---------------------------------------------------------------- features


def temporal_features(ratings: DataFrame) -> DataFrame:
    """Datetime (UTC), year, month, day_of_week with Monday = 0."""
    dt = _ts_ntz(F.col("timestamp"))
    return ratings.withColumn("datetime", dt).select(
        "*", F.year("datetime").alias("year"), F.month("datetime").alias("month"),
        F.weekday("datetime").alias("day_of_week"))


def parse_genres(movies: DataFrame) -> DataFrame:
    """genres_list = genres split on '|'."""
    return movies.withColumn("genres_list", F.split(F.col("genres"), r"\|"))


def user_stats(ratings: DataFrame) -> DataFrame:
    """A3: mean, sample std (NULL for one rating), count, distinct movies."""
    return ratings.groupBy("userId").agg(
        F.avg("rating").alias("user_avg_rating"),
        F.stddev_samp("rating").alias("user_rating_std"),
        F.count("rating").alias("user_rating_count"),
        F.countDistinct("movieId").alias("user_unique_movies"))


def movie_stats(ratings: DataFrame) -> DataFrame:
    """A4: the same per movie."""
    return ratings.groupBy("movieId").agg(
        F.avg("rating").alias("movie_avg_rating"),
        F.stddev_samp("rating").alias("movie_rating_std"),
        F.count("rating").alias("movie_rating_count"),
        F.countDistinct("userId").alias("movie_unique_users"))


def enrich_ratings(ratings: DataFrame, users: DataFrame | None = None,
                   movies: DataFrame | None = None, with_time: bool = True) -> DataFrame:
    """Ratings + temporal features + user stats + movie stats (left joins).

    Pass stats computed on the training split to avoid leaking test ratings
    into features (the reference computes them before splitting).
    """
    users = users if users is not None else user_stats(ratings)
    movies = movies if movies is not None else movie_stats(ratings)
    base = temporal_features(ratings) if with_time else ratings
    return base.join(users, "userId", "left").join(movies, "movieId", "left")


# ---------------------------------------------------------------- implicit


def implicit_confidence(ratings: DataFrame) -> DataFrame:
    """Star rating -> confidence 5/4/3/2/1 (>=4.5, >=4, >=3.5, >=3, else)."""
    r = F.col("rating")
    conf = (F.when(r >= 4.5, 5.0).when(r >= 4.0, 4.0).when(r >= 3.5, 3.0)
            .when(r >= 3.0, 2.0).otherwise(1.0))
    return ratings.withColumn("rating", conf)


def implicit_binary(ratings: DataFrame, threshold: float = 3.5) -> DataFrame:
    """like = 1 if rating >= threshold else 0."""
    return ratings.withColumn("rating", F.when(F.col("rating") >= threshold, 1.0).otherwise(0.0))


# ---------------------------------------------------------------- samples


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42,
                    key_cols=("userId", "movieId")) -> DataFrame:
    """Stable Bernoulli sample - keep rows whose md5(key, seed) falls below
    ``fraction``; independent of partitioning and engine."""
    return df.filter(unit_hash(*[F.col(c) for c in key_cols], seed) < F.lit(float(fraction)))


def sample_rows(df: DataFrame, n: int, seed: int = 42,
                key_cols=("userId", "movieId")) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by md5 order (TakeOrdered, no shuffle
    of the table).  The row cap is the operator itself."""
    key = F.md5(F.concat_ws("_", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))
    return df.withColumn("_h", key).orderBy("_h", *key_cols).limit(int(n)).drop("_h")


# ---------------------------------------------------------------- id maps / splits


def dense_index(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """M1: id -> dense 0-based index in id order (distinct ids, exact positions)."""
    name = name or f"{col}_idx"
    return global_positions(df.select(col).distinct(), [col], name=name)


def random_split(ratings: DataFrame, test_size: float = 0.2, val_size: float = 0.1,
                 seed: int = 42, exact_counts: bool = True) -> DataFrame:
    """M2: stable random split, column ``split`` in train / val / test.

    With ``exact_counts`` the sizes follow the reference: test = ceil(n*test),
    val = ceil((n-test) * val/(1-test)), train = rest, cut on md5 order.
    Otherwise each row is placed by its own hash value (no sort at all).
    """
    h = F.md5(F.concat_ws("_", F.col("userId").cast("string"),
                          F.col("movieId").cast("string"), F.lit(str(seed))))
    if not exact_counts:
        u = unit_hash(F.col("userId"), F.col("movieId"), seed)
        return ratings.withColumn(
            "split", F.when(u < test_size, "test").when(u < test_size + val_size, "val")
            .otherwise("train"))
    import math

    # the hash as three numbers, in the order of its hexadecimal digits
    order = ["_h1", "_h2", "_h3", "userId", "movieId"]
    digits = [F.conv(F.substring(h, i, w), 16, 10).cast("bigint") for i, w in ((1, 12), (13, 12), (25, 8))]
    keyed = ratings.withColumns(dict(zip(order, digits)))

    def sizes(n):
        n_test = int(math.ceil(n * test_size))
        return n_test, n_test + int(math.ceil((n - n_test) * (val_size / (1.0 - test_size))))

    test_end, val_end = _cuts(keyed, order, sizes)
    return keyed.withColumn("split", F.when(test_end, "test").when(val_end, "val").otherwise("train")).drop(*order[:3])


def _cuts(keyed: DataFrame, order: list[str], sizes) -> list:
    """For each size of ``sizes(number of rows)`` whether a row is among the
    first so many in ``order``: two keys are looked up, no row is moved."""
    keys = keyed.select(*order).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = keys.count()
        ends = sizes(n)
        found = keys_at(keys, order, [k for k in ends if k < n])
    finally:
        keys.unpersist()
    return [before(order, found[i]) if k < n else F.lit(True) for i, k in enumerate(ends)]


def temporal_split(ratings: DataFrame, test_size: float = 0.2, val_size: float = 0.1,
                   exact: bool = False) -> DataFrame:
    """M3: chronological split on (timestamp, userId, movieId).

    Reference cut (default): test_idx = int(n*(1-test)), val_idx =
    int(test_idx*(1-val)), i.e. 72/8/20.  ``exact`` gives 70/10/20.
    """
    def sizes(n):
        test_idx = int(n * (1 - test_size))
        return (int(n * (1 - test_size - val_size)) if exact else int(test_idx * (1 - val_size))), test_idx

    train_end, val_end = _cuts(ratings, ["timestamp", "userId", "movieId"], sizes)
    return ratings.withColumn("split", F.when(train_end, "train").when(val_end, "val").otherwise("test"))


def split_sizes(split_df: DataFrame) -> DataFrame:
    """Rows and share (%) per split."""
    counts = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    # the total comes from the (at most one row per split label) count table,
    # not from another pass over the rows
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.col("n") / total * 100.0)


# ---------------------------------------------------------------- matrix-level aggregates


def merge_duplicates(interactions: DataFrame) -> DataFrame:
    """(user, item) duplicates summed, like a COO -> CSR build."""
    return interactions.groupBy("userId", "movieId").agg(F.sum("rating").alias("rating"))


def matrix_density(interactions: DataFrame) -> DataFrame:
    """A5: shape and density after duplicate pairs are merged."""
    merged = merge_duplicates(interactions)
    agg = merged.agg(F.countDistinct("userId").alias("n_users"),
                     F.countDistinct("movieId").alias("n_items"),
                     F.count(F.lit(1)).alias("nnz"))
    return agg.withColumn(
        "density", F.try_divide(F.col("nnz").cast("double"), F.col("n_users").cast("double") * F.col("n_items")))


def item_popularity(interactions: DataFrame) -> DataFrame:
    """Per item, sum of ratings (column sums of the matrix) and count."""
    return interactions.groupBy("movieId").agg(F.sum("rating").alias("popularity"),
                                               F.count(F.lit(1)).alias("n_ratings"))


def relevant_items(test: DataFrame) -> DataFrame:
    """A10 in long form: (userId, movieId, n_relevant)."""
    per_user = test.groupBy("userId").agg(F.count(F.lit(1)).alias("n_relevant"))
    return test.select("userId", "movieId").join(per_user, "userId")


def quick_stats(ratings: DataFrame) -> DataFrame:
    """Distinct users / movies, mean and sample std of the rating."""
    return ratings.agg(F.countDistinct("userId").alias("n_users"),
                       F.countDistinct("movieId").alias("n_movies"),
                       F.avg("rating").alias("mean_rating"),
                       F.stddev_samp("rating").alias("std_rating"))


def cold_start(ratings: DataFrame, key: str = "userId", min_ratings: int = 5) -> DataFrame:
    """Ids with fewer than ``min_ratings`` ratings and their share."""
    counts = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.sum(F.when(F.col("_n") < min_ratings, 1).otherwise(0)).cast("bigint").alias("n_cold"),
        F.count(F.lit(1)).alias("n_total")).withColumn(
        "cold_pct", F.try_divide(F.col("n_cold"), F.col("n_total")) * 100.0)


def histogram(values: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), one row per
    bin, also for empty ones; no rows for no values."""
    lo, hi = values.agg(F.min(col), F.max(col)).first()
    n_bins = 0 if lo is None else bins
    lo, hi = (0.0, 0.0) if lo is None else (float(lo), float(hi))
    width = (hi - lo) if hi > lo else 1.0
    v = F.col(col).cast("double")
    b = F.least(F.lit(bins), F.floor((v - F.lit(lo)) / F.lit(width) * F.lit(float(bins))) + 1)
    counts = values.where(v.isNotNull()).groupBy(b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = values.sparkSession.range(1, n_bins + 1).toDF("bin").join(counts, "bin", "left").fillna(0, ["n"])
    return counts.select(
        "bin",
        (F.lit(lo) + (F.col("bin") - 1) * F.lit(width / bins)).alias("bin_lo"),
        (F.lit(lo) + F.col("bin") * F.lit(width / bins)).alias("bin_hi"),
        "n")


def rating_histogram(ratings: DataFrame, bins: int = 10) -> DataFrame:
    return histogram(ratings, "rating", bins)


def user_activity_histogram(ratings: DataFrame, bins: int = 50) -> DataFrame:
    per_user = ratings.groupBy("userId").agg(F.count(F.lit(1)).alias("ratings_per_user"))
    return histogram(per_user, "ratings_per_user", bins)


def train_stats(train: DataFrame) -> DataFrame:
    """Users, items, ratings, global mean, density."""
    agg = train.agg(F.countDistinct("userId").alias("n_users"),
                    F.countDistinct("movieId").alias("n_items"),
                    F.count(F.lit(1)).alias("n_ratings"),
                    F.avg("rating").alias("global_mean"))
    return agg.withColumn(
        "density", F.try_divide(F.col("n_ratings").cast("double"),
                                F.col("n_users").cast("double") * F.col("n_items")))


def user_history(ratings: DataFrame, movies: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Ratings of the given users (all when None) with title and genres,
    ordered per user by rating desc."""
    rated = ratings if users is None else ratings.join(users.select("userId"), "userId", "left_semi")
    out = rated.join(movies, "movieId").select("userId", "movieId", "title", "genres", "rating")
    return out.orderBy("userId", F.desc("rating"), "movieId")


def processing_info(ratings: DataFrame, split_df: DataFrame) -> DataFrame:
    """One row with total ratings, split sizes, users, movies, sparsity."""
    sizes = split_df.agg(*[F.sum(F.when(F.col("split") == k, 1).otherwise(0)).cast("bigint").alias(f"{k}_size")
                           for k in ("train", "val", "test")])
    summary = ratings.agg(F.count(F.lit(1)).alias("total_ratings"),
                          F.countDistinct("userId").alias("n_users"),
                          F.countDistinct("movieId").alias("n_movies"))
    row = sizes.first()
    return summary.select("total_ratings", *[F.lit(row[f"{k}_size"]).cast("bigint").alias(f"{k}_size")
                                             for k in ("train", "val", "test")],
                          "n_users", "n_movies",
                          _sparsity(F.col("total_ratings"), F.col("n_users"), F.col("n_movies")).alias("sparsity"))


def write_processing_info(info: DataFrame, path: str) -> None:
    """S7 writer: adds processed_date and writes one JSON record."""
    info.withColumn("processed_date", F.current_timestamp().cast("timestamp_ntz")) \
        .coalesce(1).write.mode("overwrite").json(path)


def eval_users(test: DataFrame, n: int = 1000, by: str = "id") -> DataFrame:
    """The users an evaluation samples - the first ``n`` by id, or the
    first ``n`` by first appearance (min timestamp, then id).  The cut is the
    operator itself (a TakeOrdered of n rows)."""
    if by == "id":
        return test.select("userId").distinct().orderBy("userId").limit(int(n))
    first = test.groupBy("userId").agg(F.min("timestamp").alias("first_seen"))
    return first.orderBy("first_seen", "userId").limit(int(n))
