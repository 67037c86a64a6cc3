"""Stateful streaming deduplication of whole texts (operator 13).

Texts are equal when they are identical after every run of ASCII white space
has become one blank.

1. ``ingest`` reads the Parquet files of a table as a stream.  A streaming
   aggregate keeps, for every digest ever seen, the smallest identifier, the
   locator of that row's content (file and row in the file) and the number of
   rows.  The state lies in RocksDB on the executors' disks, is written to the
   shared folder with every micro-batch and never expires; rows of a digest are
   combined before they reach it, so a group of copies costs one update a task.
   New files may arrive between two calls: the state goes on.
2. ``decisions`` reads the rows again.  A row whose digest the state has seen
   more than once is a hit; its whole content is compared with the content at
   the state's locator.  The copies of a digest are dealt over as many groups as
   their number asks for.  Where bytes differ under one digest, its rows are
   grouped by content instead, so the result doesn't rest on the digest.

Only hits' texts are shuffled, to be compared; the table of hit digests is
broadcast below a counted number of rows, else joined by shuffle.  DataFrame
functions only.

Defined cases: null texts count as empty, and all empty texts are one group; a
null identifier is larger than any other; repeated rows (same identifier and
text) are told apart by their locator, so one row of a group stays; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.llm.common import SPACE_RE, small, stored
from recspark.session import checkpoint_dir, configure, scratch_path

#: input read in one micro-batch, copies compared in one group, hit digests that are broadcast
BATCH_BYTES, COPIES, BROADCAST_HITS = 1 << 36, 1000, 200_000
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a micro-batch writes its changes, not a snapshot of the whole state
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores would each set megabytes of disk aside
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # all state stores of an executor share this much memory
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: a lone blank stays as it is
_RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def _located(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, at, content, digest); ``at`` is the locator of the row."""
    meta = rows.metadataColumn("_metadata")
    at = F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))
    rows = rows.select("doc_id", at.alias("at"), normalised(F.col("text")).alias("content"))
    return rows.withColumn("digest", digest(F.col("content")))


def _order() -> Column:
    """Rows by identifier, null last, and by locator."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "at")


def _as_glob(source: str) -> str:
    """A stream takes a single file only by a pattern; this one matches nothing else."""
    return source if set(source) & set("*?[{") else f"{source[:-1]}[{source[-1]}]"


def _columns(spark: SparkSession, source: str) -> T.StructType:
    found = spark.read.parquet(source).schema
    return T.StructType([found["doc_id"], found["text"]])


def ingest(spark: SparkSession, source: str, store: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Takes up all rows of ``source`` that ``store`` has not seen yet.  A
    micro-batch that is run again after a loss replaces what it had written."""
    configure(spark)
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    rows = (spark.readStream.schema(_columns(spark, source)).option("maxBytesPerTrigger", BATCH_BYTES)
            .parquet(_as_glob(source.rstrip("/"))))
    seen = (_located(rows, digest).groupBy("digest")
            .agg(F.min(_order()).alias("first"), F.count("*").alias("n")))
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{store}/updates/batch={i}")
    try:
        for k, v in _STATE_CONF.items():
            spark.conf.set(k, v)
        run = (seen.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True)
               .option("checkpointLocation", f"{store}/state").start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    run.awaitTermination()


def index(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """(digest, first, n): the state's last word on every digest.  Each update of
    a digest has a larger count than the one before."""
    first = T.StructType([T.StructField("unknown", T.BooleanType()), schema["doc_id"],
                          T.StructField("at", T.StructType([T.StructField("file", T.StringType()),
                                                            T.StructField("row", T.LongType())]))])
    updates = spark.read.schema(T.StructType([
        T.StructField("digest", T.BinaryType()), T.StructField("first", first), T.StructField("n", T.LongType())]))
    last = F.max(F.struct("n", "first"))
    return (updates.parquet(f"{store}/updates").groupBy("digest").agg(last.alias("_l"))
            .select("digest", "_l.first", "_l.n"))


def decisions(spark: SparkSession, source: str, store: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``source``, all of which ``store`` has taken up:
    doc_id, at, keep_id, group_size, kept, digest."""
    schema = _columns(spark, source)
    if not spark.read.parquet(source).limit(1).count():  # a stream without rows may write no update
        return spark.createDataFrame([], T.StructType([
            schema["doc_id"], T.StructField("keep_id", schema["doc_id"].dataType), T.StructField("group_size", T.LongType()),
            T.StructField("kept", T.BooleanType()), T.StructField("digest", T.StringType())]))
    hits = index(spark, store, schema).where("n > 1").select(F.col("digest").alias("_d"), "first", "n")
    hits = small(stored(hits, "dedup-hits"), BROADCAST_HITS)
    rows = _located(spark.read.schema(schema).parquet(source), digest).join(hits, F.col("digest") == F.col("_d"), "left")
    rows = stored(rows.select(
        "doc_id", "at", "digest", "n", F.col("first.doc_id").alias("keep_id"),
        F.coalesce(F.col("at") == F.col("first.at"), F.lit(True)).alias("kept"),
        F.when(F.col("n").isNotNull(), F.col("content")).alias("content")), "dedup-rows")

    hit, parts = rows.where("n IS NOT NULL"), F.ceil(F.col("n") / COPIES)
    copies = hit.where("NOT kept").select("digest", F.pmod(F.xxhash64("at"), parts).alias("part"), "content")
    firsts = hit.where("kept").select("digest", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"),
                                      F.col("content").alias("_first"))
    odd = stored(copies.join(firsts, ["digest", "part"]).where("content <> _first")
                 .select(F.col("digest").alias("_d")).distinct(), "dedup-odd")

    out = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), F.col("kept"), F.lower(F.hex("digest")).alias("digest")]
    single = rows.withColumn("keep_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    single = single.withColumn("group_size", F.coalesce("n", F.lit(1).cast("long")))
    if not odd.limit(1).count():
        return single.select(*out)
    # different texts under one digest
    at_odds = F.col("digest") == F.col("_d")
    mixed = rows.join(small(odd), at_odds, "left_semi")
    groups = (mixed.groupBy("digest", "content").agg(F.min(_order()).alias("first"), F.count("*").alias("group_size"))
              .withColumnsRenamed({"digest": "_g", "content": "_c"}))
    told = (mixed.drop("keep_id", "kept").join(groups, (F.col("digest") == F.col("_g")) & (F.col("content") == F.col("_c")))
            .withColumn("keep_id", F.col("first.doc_id")).withColumn("kept", F.col("at") == F.col("first.at")))
    return single.join(small(odd), at_odds, "left_anti").select(*out).unionByName(told.select(*out))


def exact_dedup(spark: SparkSession, source: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``decisions`` on a new store that has taken up all of ``source``."""
    checkpoint_dir(spark)
    store = scratch_path(spark, "exact-dedup")
    ingest(spark, source, store, digest)
    return decisions(spark, source, store, digest)


SQL = rf"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE_RE}', ' ', 'g') AS t FROM documents)
"""
