"""Readers and writers for rating-style tables.

Every reader takes an explicit schema.  CSV is supported because the public
rating datasets ship as CSV; parquet is the format we write.  Splits are
written partitioned by ``split`` so a reader of one split prunes the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark import schemas


def _read(spark: SparkSession, path: str, schema, fmt: str | None) -> DataFrame:
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.schema(schema)
    if fmt == "csv":
        # titles contain commas inside double quotes, quotes are doubled
        return reader.options(header=True, quote='"', escape='"', mode="FAILFAST").csv(path)
    return reader.format(fmt).load(path)


def read_ratings(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """userId, movieId, rating, timestamp (epoch seconds)."""
    return _read(spark, path, schemas.RATINGS, fmt)


def read_movies(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """movieId, title, genres ('|'-separated)."""
    return _read(spark, path, schemas.MOVIES, fmt)


def read_tags(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """S3: tags table (loaded for completeness)."""
    return _read(spark, path, schemas.TAGS, fmt)


def write_splits(split_df: DataFrame, path: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """One dataset partitioned by ``split`` (train / val / test)."""
    writer = split_df.write.mode(mode).partitionBy("split")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None,
                fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Read back the split dataset; ``split`` filters by partition pruning.
    ``schema`` names the columns that were written (ratings by default)."""
    fields = (schema or schemas.RATINGS).fields
    schema = T.StructType([f for f in fields if f.name != "split"] + [T.StructField("split", T.StringType())])
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return df.filter(F.col("split") == split) if split else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """Write a result table (parquet, csv with header, or json)."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, schema=None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def read_tuning_results(spark: SparkSession, path: str) -> DataFrame:
    """Tuning result CSV with its fixed columns."""
    return spark.read.schema(schemas.TUNING_RESULTS).option("header", True).csv(path)
