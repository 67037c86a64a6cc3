"""Query plans for scans, profiling, cleaning, features, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.operators import prep
from recspark.plans.registry import register
from recspark.sources import movies_view, ratings_view, raw_interactions_view

R = ["ratings"]


@register("ratings_scan", "SELECT userId, movieId, rating, \"timestamp\" FROM ratings", R,
          round_cols=["rating"])
def ratings_scan(spark, sf):
    """S1 over the benchmark tables: one rating per (user, movie)."""
    return ratings_view(spark, sf)


@register("movies_scan", "SELECT movieId, title, genres FROM movies", ["movies"])
def movies_scan(spark, sf):
    """Movie catalogue."""
    return movies_view(spark, sf)


_SUMMARY_SQL = """
SELECT count(DISTINCT userId) AS n_users, count(DISTINCT movieId) AS n_movies,
       count(*) AS n_ratings, min(rating) AS min_rating, max(rating) AS max_rating,
       make_timestamp(min("timestamp") * 1000000) AS min_datetime,
       make_timestamp(max("timestamp") * 1000000) AS max_datetime,
       (1 - count(*)::DOUBLE / (count(DISTINCT userId)::DOUBLE * count(DISTINCT movieId)::DOUBLE)) * 100 AS sparsity
FROM ratings"""


@register("data_summary", _SUMMARY_SQL, R, round_cols=["min_rating", "max_rating", "sparsity"])
def data_summary(spark, sf):
    """A1 + A2."""
    return prep.data_summary(ratings_view(spark, sf))


@register("sparsity", "SELECT n_users, n_movies, n_ratings, sparsity FROM (" + _SUMMARY_SQL + ") s",
          R, round_cols=["sparsity"])
def sparsity(spark, sf):
    """A2."""
    return prep.sparsity(ratings_view(spark, sf))


_CLEAN_SQL = """
WITH r1 AS (SELECT * FROM ratings WHERE userId IN
              (SELECT userId FROM ratings GROUP BY userId HAVING count(*) >= 20))
SELECT * FROM r1 WHERE movieId IN (SELECT movieId FROM r1 GROUP BY movieId HAVING count(*) >= 20)"""


@register("clean_ratings", _CLEAN_SQL, R, round_cols=["rating"])
def clean_ratings(spark, sf):
    """User pass then movie pass, min 20 each."""
    return prep.activity_filter(ratings_view(spark, sf, persist=True), 20, 20)


@register("clean_movies",
          "SELECT * FROM movies WHERE movieId IN (SELECT movieId FROM (" + _CLEAN_SQL + ") c)",
          ["ratings", "movies"])
def clean_movies(spark, sf):
    """P5: catalogue restricted to movies left after cleaning."""
    clean = prep.activity_filter(ratings_view(spark, sf, persist=True), 20, 20)
    return prep.restrict_movies(movies_view(spark, sf), clean)


@register("clean_report", """
SELECT (SELECT count(*) FROM ratings) - count(*) AS removed,
       ((SELECT count(*) FROM ratings) - count(*)) / (SELECT count(*) FROM ratings)::DOUBLE * 100 AS removed_pct,
       count(*) AS remaining, count(DISTINCT userId) AS n_users, count(DISTINCT movieId) AS n_movies
FROM (""" + _CLEAN_SQL + ") c", R, round_cols=["removed_pct"])
def clean_report(spark, sf):
    """P6."""
    ratings = ratings_view(spark, sf, persist=True)
    return prep.clean_report(ratings, prep.activity_filter(ratings, 20, 20))


_USER_STATS_SQL = """
SELECT userId, avg(rating) AS user_avg_rating, stddev_samp(rating) AS user_rating_std,
       count(rating) AS user_rating_count, count(DISTINCT movieId) AS user_unique_movies
FROM ratings GROUP BY userId"""
_MOVIE_STATS_SQL = """
SELECT movieId, avg(rating) AS movie_avg_rating, stddev_samp(rating) AS movie_rating_std,
       count(rating) AS movie_rating_count, count(DISTINCT userId) AS movie_unique_users
FROM ratings GROUP BY movieId"""


@register("user_stats", _USER_STATS_SQL, R, round_cols=["user_avg_rating", "user_rating_std"])
def user_stats(spark, sf):
    """A3."""
    return prep.user_stats(ratings_view(spark, sf))


@register("movie_stats", _MOVIE_STATS_SQL, R, round_cols=["movie_avg_rating", "movie_rating_std"])
def movie_stats(spark, sf):
    """A4."""
    return prep.movie_stats(ratings_view(spark, sf))


_TEMPORAL_SQL = """
SELECT userId, movieId, rating, "timestamp", make_timestamp("timestamp" * 1000000) AS datetime,
       year(make_timestamp("timestamp" * 1000000)) AS "year",
       month(make_timestamp("timestamp" * 1000000)) AS "month",
       isodow(make_timestamp("timestamp" * 1000000)) - 1 AS day_of_week
FROM ratings"""


@register("temporal_features", _TEMPORAL_SQL, R, round_cols=["rating"],
          bigint_cols=["year", "month", "day_of_week"])
def temporal_features(spark, sf):
    """Datetime, year, month, day_of_week (Monday = 0)."""
    return prep.temporal_features(ratings_view(spark, sf))


@register("ratings_enriched", """
SELECT t.*, u.user_avg_rating, u.user_rating_std, u.user_rating_count, u.user_unique_movies,
       m.movie_avg_rating, m.movie_rating_std, m.movie_rating_count, m.movie_unique_users
FROM (""" + _TEMPORAL_SQL + """) t
LEFT JOIN (""" + _USER_STATS_SQL + """) u ON t.userId = u.userId
LEFT JOIN (""" + _MOVIE_STATS_SQL + """) m ON t.movieId = m.movieId""", R,
          round_cols=["rating", "user_avg_rating", "user_rating_std", "movie_avg_rating",
                      "movie_rating_std"],
          bigint_cols=["year", "month", "day_of_week"])
def ratings_enriched(spark, sf):
    """Ratings with temporal features and both stat tables."""
    return prep.enrich_ratings(ratings_view(spark, sf, persist=True))


@register("genres_parse", """
SELECT movieId, genre_pos, genre FROM (
  SELECT movieId, unnest(string_split(genres, '|')) AS genre,
         unnest(generate_series(0, len(string_split(genres, '|')) - 1)) AS genre_pos
  FROM movies) g""", ["movies"], bigint_cols=["genre_pos"])
def genres_parse(spark, sf):
    """Genres split on '|' (long form: one row per genre token)."""
    parsed = prep.parse_genres(movies_view(spark, sf))
    return parsed.select("movieId", F.posexplode("genres_list").alias("genre_pos", "genre"))


@register("implicit_confidence", """
SELECT userId, movieId,
       CASE WHEN rating >= 4.5 THEN 5.0 WHEN rating >= 4.0 THEN 4.0 WHEN rating >= 3.5 THEN 3.0
            WHEN rating >= 3.0 THEN 2.0 ELSE 1.0 END AS rating, "timestamp"
FROM ratings""", R, round_cols=["rating"])
def implicit_confidence(spark, sf):
    """P7."""
    return prep.implicit_confidence(ratings_view(spark, sf))


@register("implicit_binary", """
SELECT userId, movieId, CASE WHEN rating >= 3.5 THEN 1.0 ELSE 0.0 END AS rating, "timestamp"
FROM ratings""", R, round_cols=["rating"])
def implicit_binary(spark, sf):
    """P7b."""
    return prep.implicit_binary(ratings_view(spark, sf), 3.5)


_MD5_UNIT = ("('0x' || substr(md5(cast(userId AS VARCHAR) || '_' || cast(movieId AS VARCHAR) "
             "|| '_42'), 1, 8))::BIGINT / 4294967296.0e0")


@register("sample_fraction", f"SELECT * FROM ratings WHERE {_MD5_UNIT} < 0.2e0", R,
          round_cols=["rating"])
def sample_fraction(spark, sf):
    """Stable 20 % sample, seed 42."""
    return prep.sample_fraction(ratings_view(spark, sf), 0.2, 42)


_MD5_KEY = "md5(cast(userId AS VARCHAR) || '_' || cast(movieId AS VARCHAR) || '_42')"


@register("sample_rows", f"SELECT * FROM ratings ORDER BY {_MD5_KEY}, userId, movieId LIMIT 1000",
          R, round_cols=["rating"])
def sample_rows(spark, sf):
    """1000 rows chosen by md5 order, seed 42."""
    return prep.sample_rows(ratings_view(spark, sf), 1000, 42)


@register("id_map", """
SELECT userId, row_number() OVER (ORDER BY userId) - 1 AS userId_idx
FROM (SELECT DISTINCT userId FROM ratings) u""", R, bigint_cols=["userId_idx"])
def id_map(spark, sf):
    """M1: dense user index in id order."""
    return prep.dense_index(ratings_view(spark, sf), "userId")


@register("random_split", f"""
SELECT userId, movieId, rating, "timestamp",
       CASE WHEN pos < nt THEN 'test' WHEN pos < nt + nv THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY {_MD5_KEY}, userId, movieId) - 1 AS pos FROM ratings) t,
     (SELECT ceil(count(*) * 0.2e0) AS nt,
             ceil((count(*) - ceil(count(*) * 0.2e0)) * (0.1e0 / (1.0e0 - 0.2e0))) AS nv
      FROM ratings) k""", R, round_cols=["rating"])
def random_split(spark, sf):
    """M2: exact-count stable random split 70/10/20 (seed 42)."""
    return prep.random_split(ratings_view(spark, sf), 0.2, 0.1, 42, exact_counts=True)


@register("temporal_split", "SELECT * FROM temporal_split", ["temporal_split"],
          round_cols=["rating"])
def temporal_split(spark, sf):
    """M3: chronological 72/8/20 cut on (timestamp, userId, movieId)."""
    return prep.temporal_split(ratings_view(spark, sf))


@register("split_sizes", """
SELECT split, count(*) AS n, count(*) / (SELECT count(*) FROM ratings)::DOUBLE * 100 AS pct
FROM temporal_split GROUP BY split""", ["temporal_split"], round_cols=["pct"])
def split_sizes(spark, sf):
    """A15 on the temporal split."""
    return prep.split_sizes(prep.temporal_split(ratings_view(spark, sf)))


@register("split_read", "SELECT * FROM temporal_split WHERE split = 'test'", ["temporal_split"],
          round_cols=["rating"])
def split_read(spark, sf):
    """Splits written partitioned by ``split`` and read back with pruning."""
    from recspark.session import scratch_path
    from recspark.sources import read_splits, write_splits

    path = scratch_path(spark, "splits")
    write_splits(prep.temporal_split(ratings_view(spark, sf)), path)
    return read_splits(spark, path, "test").select("userId", "movieId", "rating", "timestamp", "split")


@register("matrix_density", """
SELECT count(DISTINCT userId) AS n_users, count(DISTINCT movieId) AS n_items, count(*) AS nnz,
       count(*)::DOUBLE / (count(DISTINCT userId)::DOUBLE * count(DISTINCT movieId)) AS density
FROM (SELECT userId, movieId, sum(rating) AS rating FROM raw_interactions GROUP BY userId, movieId) m""",
          ["raw_interactions"], round_cols=["density"])
def matrix_density(spark, sf):
    """A5: density of the merged interaction matrix."""
    return prep.matrix_density(raw_interactions_view(spark, sf).select("userId", "movieId", "rating"))


@register("interaction_merge", """
SELECT userId, movieId, sum(rating) AS rating FROM raw_interactions GROUP BY userId, movieId""",
          ["raw_interactions"], round_cols=["rating"])
def interaction_merge(spark, sf):
    """Duplicate (user, item) interactions summed."""
    return prep.merge_duplicates(raw_interactions_view(spark, sf).select("userId", "movieId", "rating"))


@register("relevant_items", """
SELECT userId, movieId, count(*) OVER (PARTITION BY userId) AS n_relevant
FROM temporal_split WHERE split = 'test'""", ["temporal_split"])
def relevant_items(spark, sf):
    """A10 (long form) on the temporal test split."""
    split = prep.temporal_split(ratings_view(spark, sf))
    return prep.relevant_items(split.filter(F.col("split") == "test"))


@register("quick_stats", """
SELECT count(DISTINCT userId) AS n_users, count(DISTINCT movieId) AS n_movies,
       avg(rating) AS mean_rating, stddev_samp(rating) AS std_rating FROM ratings""", R,
          round_cols=["mean_rating", "std_rating"])
def quick_stats(spark, sf):
    """A12."""
    return prep.quick_stats(ratings_view(spark, sf))


def _cold_sql(key: str) -> str:
    return f"""
SELECT sum(CASE WHEN n < 5 THEN 1 ELSE 0 END) AS n_cold, count(*) AS n_total,
       sum(CASE WHEN n < 5 THEN 1 ELSE 0 END) / count(*)::DOUBLE * 100 AS cold_pct
FROM (SELECT {key}, count(*) AS n FROM ratings GROUP BY {key}) c"""


@register("cold_start_users", _cold_sql("userId"), R, round_cols=["cold_pct"],
          bigint_cols=["n_cold"])
def cold_start_users(spark, sf):
    """A13 for users (fewer than 5 ratings)."""
    return prep.cold_start(ratings_view(spark, sf), "userId", 5)


@register("cold_start_items", _cold_sql("movieId"), R, round_cols=["cold_pct"],
          bigint_cols=["n_cold"])
def cold_start_items(spark, sf):
    """A13 for items."""
    return prep.cold_start(ratings_view(spark, sf), "movieId", 5)


def _hist_sql(source: str, col: str, bins: int) -> str:
    return f"""
SELECT a.bin, lo + (a.bin - 1) * ((hi - lo) / {bins}.0e0) AS bin_lo, lo + a.bin * ((hi - lo) / {bins}.0e0) AS bin_hi,
       count(b.bin) AS n
FROM (SELECT unnest(range(1, {bins} + 1)) AS bin) a
CROSS JOIN (SELECT min(cast({col} AS DOUBLE)) AS lo, max(cast({col} AS DOUBLE)) AS hi FROM {source}) k
LEFT JOIN (SELECT least({bins}, floor((cast({col} AS DOUBLE) - lo) / (hi - lo) * {bins}.0e0) + 1)::BIGINT AS bin
      FROM {source}, (SELECT min(cast({col} AS DOUBLE)) AS lo, max(cast({col} AS DOUBLE)) AS hi FROM {source}) k) b
ON a.bin = b.bin
GROUP BY a.bin, lo, hi"""


@register("rating_histogram", _hist_sql("ratings", "rating", 10), R,
          round_cols=["bin_lo", "bin_hi"])
def rating_histogram(spark, sf):
    """10-bin histogram of ratings."""
    return prep.rating_histogram(ratings_view(spark, sf, persist=True), 10)


@register("user_activity_histogram",
          _hist_sql("(SELECT userId, count(*) AS ratings_per_user FROM ratings GROUP BY userId) pu",
                    "ratings_per_user", 50), R, round_cols=["bin_lo", "bin_hi"])
def user_activity_histogram(spark, sf):
    """50-bin histogram of ratings per user."""
    return prep.user_activity_histogram(ratings_view(spark, sf, persist=True), 50)


@register("train_stats", """
SELECT count(DISTINCT userId) AS n_users, count(DISTINCT movieId) AS n_items, count(*) AS n_ratings,
       avg(rating) AS global_mean,
       count(*)::DOUBLE / (count(DISTINCT userId)::DOUBLE * count(DISTINCT movieId)) AS density
FROM temporal_split WHERE split = 'train'""", ["temporal_split"],
          round_cols=["global_mean", "density"])
def train_stats(spark, sf):
    """A18 on the temporal train split."""
    split = prep.temporal_split(ratings_view(spark, sf))
    return prep.train_stats(split.filter(F.col("split") == "train"))


@register("user_history", """
SELECT r.userId, r.movieId, m.title, m.genres, r.rating
FROM ratings r JOIN movies m ON r.movieId = m.movieId""", ["ratings", "movies"],
          round_cols=["rating"])
def user_history(spark, sf):
    """Every user's rated movies with title and genres."""
    return prep.user_history(ratings_view(spark, sf), movies_view(spark, sf))


@register("processing_info", """
SELECT n AS total_ratings, n - nt - nv AS train_size, nv AS val_size, nt AS test_size, n_users, n_movies,
       (1 - n::DOUBLE / (n_users::DOUBLE * n_movies::DOUBLE)) * 100 AS sparsity
FROM (SELECT count(*) AS n, ceil(count(*) * 0.2e0)::BIGINT AS nt,
             ceil((count(*) - ceil(count(*) * 0.2e0)) * (0.1e0 / (1.0e0 - 0.2e0)))::BIGINT AS nv,
             count(DISTINCT userId) AS n_users, count(DISTINCT movieId) AS n_movies FROM ratings) k""",
          R, round_cols=["sparsity"])
def processing_info(spark, sf):
    """Processing summary of the random 70/10/20 split."""
    ratings = ratings_view(spark, sf, persist=True)
    return prep.processing_info(ratings, prep.random_split(ratings, 0.2, 0.1, 42))


@register("eval_users", """
SELECT DISTINCT userId FROM temporal_split WHERE split = 'test' ORDER BY userId LIMIT 1000""",
          ["temporal_split"])
def eval_users(spark, sf):
    """First 1000 test users by id (the evaluation's user sample)."""
    test = prep.temporal_split(ratings_view(spark, sf)).filter(F.col("split") == "test")
    return prep.eval_users(test, 1000, "id")


@register("eval_users_appearance", """
SELECT userId, min("timestamp") AS first_seen FROM temporal_split WHERE split = 'test'
GROUP BY userId ORDER BY first_seen, userId LIMIT 100""", ["temporal_split"])
def eval_users_appearance(spark, sf):
    """First 100 test users by first appearance."""
    test = prep.temporal_split(ratings_view(spark, sf)).filter(F.col("split") == "test")
    return prep.eval_users(test, 100, "appearance")
