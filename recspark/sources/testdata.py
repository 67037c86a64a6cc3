"""Rating-domain views over the benchmark tables.

The driver's tables are a TPC-H-like star schema.  These functions re-read
them as the recommendation tables the operators expect:

* ratings      - (customer, part) pairs from lineitem ⋈ orders, latest order wins
* raw_interactions - the same join without de-duplication
* movies       - parts, with four '|'-separated genre tokens
* item_factors - embedding rows of the parts that have one
* user_factors - embedding rows mapped onto users active enough to be modelled
* prediction_log, request_log - monitoring feeds

All are lazy DataFrames; nothing is collected except scalar counts.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.functions.hashing import ab_group
from recspark.session import written


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _epoch_seconds(col: Column) -> Column:
    # timestamp_ntz -> epoch seconds; the session time zone is pinned to UTC
    return F.unix_timestamp(col.cast("timestamp"))


def _rating(quantity: Column) -> Column:
    return (F.ceil(quantity / 5) * 0.5).cast("double")


def raw_interactions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (customer, part) line with its rating; duplicates kept."""
    li = load_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("o_custkey").alias("userId"),
        F.col("l_partkey").alias("movieId"),
        _rating(F.col("l_quantity")).alias("rating"),
        _epoch_seconds(F.col("o_orderdate")).alias("timestamp"),
        "o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
    )


def ratings_view(spark: SparkSession, sf_dir: str, persist: bool = False, write: bool = False) -> DataFrame:
    """One rating per (user, movie): the line of the latest order.

    ``persist`` keeps the table (memory, then disk) for plans that run several
    actions over it; a lost block is recomputed from the lineage.  ``write`` keeps it
    in the shared folder instead, where it needs no memory, and drops the shuffle
    files that it was made of, several times its size.

    A max over a struct of the ordering columns is a plain aggregate, so Spark
    combines map-side before the shuffle and a hot user never needs one task
    to sort all of its lines (which a row_number window would).
    """
    raw = raw_interactions_view(spark, sf_dir)
    latest = raw.groupBy("userId", "movieId").agg(
        F.max(F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey",
                       "l_quantity", "l_extendedprice")).alias("m"))
    # rating and timestamp follow from two of these columns, so they are not moved
    out = latest.select("userId", "movieId", _rating(F.col("m.l_quantity")).alias("rating"),
                        _epoch_seconds(F.col("m.o_orderdate")).alias("timestamp"))
    if write:
        return written(out, "ratings")
    return out.persist(StorageLevel.MEMORY_AND_DISK) if persist else out


def movies_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load_table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("movieId"),
        F.col("p_name").alias("title"),
        F.concat_ws("|", F.regexp_replace("p_name", " ", "|"), F.col("p_type"),
                    F.col("p_brand")).alias("genres"),
    )


def item_factors_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that own an embedding row: bias (label-4.5)/10, features = embedding."""
    emb = load_table(spark, sf_dir, "embeddings")
    part = load_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"))
    return emb.join(part, "vec_id", "left_semi").select(
        F.col("vec_id").alias("movieId"),
        ((F.col("label") - 4.5) / 10.0).alias("bias"),
        F.col("embedding").alias("features"),
    )


def user_factors_view(spark: SparkSession, sf_dir: str, ratings: DataFrame | None = None,
                      min_ratings: int = 20) -> DataFrame:
    """Users with at least ``min_ratings`` ratings get a factor row.

    The embedding row of a user is ``(userId*7+3) mod n_embeddings``; users
    below the activity threshold stay unknown (cold start).
    """
    emb = load_table(spark, sf_dir, "embeddings")
    n_emb = emb.count()  # scalar only
    ratings = ratings if ratings is not None else ratings_view(spark, sf_dir)
    active = (ratings.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= min_ratings)
              .select("userId", F.pmod(F.col("userId") * 7 + 3, F.lit(n_emb)).alias("vec_id")))
    return active.join(emb, "vec_id").select(
        "userId",
        ((F.col("label") - 4.5) / 20.0).alias("bias"),
        F.col("embedding").alias("features"),
    )


def global_mean(ratings: DataFrame) -> float:
    """Mean rating as a driver-side scalar (one aggregate row)."""
    return float(ratings.agg(F.avg("rating")).first()[0])


def prediction_log_view(spark: SparkSession, sf_dir: str,
                        ratings: DataFrame | None = None) -> DataFrame:
    """Each rating scored by the user's mean rating; model_id = movieId mod 4."""
    ratings = ratings if ratings is not None else ratings_view(spark, sf_dir)
    user_mean = ratings.groupBy("userId").agg(F.avg("rating").alias("predicted"))
    return ratings.join(user_mean, "userId").select(
        F.pmod(F.col("movieId"), F.lit(4)).alias("model_id"),
        F.timestamp_seconds("timestamp").cast("timestamp_ntz").alias("ts"),
        F.col("userId").alias("user_id"),
        F.col("movieId").alias("movie_id"),
        F.col("predicted"),
        F.col("rating").alias("actual"),
    )


def request_log_view(spark: SparkSession, sf_dir: str, salt: str = "default",
                     n: int = 10) -> DataFrame:
    """Serving requests from ``events``: errors are event_type 'error'."""
    ev = load_table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id",
        F.lit(n).cast("bigint").alias("n"),
        ab_group(F.col("user_id"), salt).alias("experiment_group"),
        (F.col("event_type") == "error").alias("is_error"),
        F.col("value").alias("latency_ms"),
    )
