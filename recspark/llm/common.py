"""Small helpers shared by the operators: table access, word splitting as
Column expressions, tables written to the shared folder, connected
components."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.session import configure, scratch_path

#: ASCII white space of the word contracts: ``[\x20\x09-\x0D]``
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a cut of
    the lineage that survives the loss of executors and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: most rows of a table of a few short columns that is broadcast
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table of few short columns, marked for broadcast when its counted rows
    allow it; else the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  Pure ASCII texts take ``lower``, which is the
    same there and cheaper than ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null or blank: empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE, -1))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b) as (node, component), the
    component being its smallest node.  Alternating large-star / small-star
    steps: each step is two aggregates over the edge list, written to the
    shared folder; the number of steps grows with the logarithm of the longest
    path and no node's neighbours are ever collected."""
    cur = stored(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    seen = None
    while True:
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every neighbour larger than the node hangs on the least of node and neighbours
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: node and its smaller neighbours hang on the least of them
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low2, "a").select(F.col("b").alias("x"), F.col("m"))
                 .unionByName(low2.select(F.col("a").alias("x"), F.col("m")))
                 .where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        cur = stored(small, f"{name}-step")
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    # a star forest: each node once, pointing at its least
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))


#: Arrow batches stay under this size, so that long texts don't pile up in a worker
BATCH_BYTES = 16 * 1024 * 1024


def give_back() -> None:
    """Freed memory of this worker goes back to the system (where the C library
    can do that); a worker serves later stages too and else keeps its peak."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work):
    """``work`` of ``mapInArrow`` with freed memory given back before and after."""
    def run(batches):
        give_back()
        yield from work(batches)
        give_back()

    return run


def arrow_rows(df: DataFrame, work, schema) -> DataFrame:
    """``mapInArrow`` with the package on the workers and bounded batches."""
    spark = df.sparkSession
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(work, schema)
