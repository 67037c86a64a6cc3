"""Structured Streaming versions of the monitoring operators.

* T1 ``degradation_stream``: per model, running (count, error sum) state of
  O(1) size in a table that each micro-batch folds by exact positions; every
  100th prediction closes a batch and emits its MAE, the baseline and the alert
  flag.  Equals ``monitor.degradation_batches`` when the feed arrives in
  (ts, user, movie) order.
* T2 ``request_classification_stream``: per (user, n, group) key a flag "has a
  successful request" and the time of the last one decide cache hits; keys
  expire by event-time timers; ``request_metrics_stream`` counts the
  classified requests per day with an event-time window and a watermark;
  ``latency_ema_stream`` folds the latency average with O(1) state.
* B8 ``session_stream``: sessions of an event feed by ``session_window``, closed
  by the watermark.

State functions sort each micro-batch's rows of a key by event order; rows of
later micro-batches must not be older than those already processed (the
source is time ordered, e.g. files written per time range).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recspark import schemas
from recspark.operators import ema
from recspark.operators.ordering import global_positions
from recspark.session import path_exists

BATCH_OUT = T.StructType([
    T.StructField("model_id", T.LongType()), T.StructField("batch", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("batch_end_ts", T.TimestampNTZType()),
    T.StructField("batch_mae", T.DoubleType()), T.StructField("baseline_mae", T.DoubleType()),
    T.StructField("degradation_pct", T.DoubleType()), T.StructField("alert", T.BooleanType()),
])
DEGRADATION_STATE = T.StructType([
    T.StructField("model_id", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("err_sum", T.DoubleType()), T.StructField("last_ts", T.TimestampNTZType()),
])


def time_chunks(df: DataFrame, ts_col: str, chunks: int = 4) -> list[DataFrame]:
    """Split ``df`` into ``chunks`` consecutive event-time ranges, to replay a
    table as a time-ordered feed.  The bounds only have to be ordered and
    cover every row, so they come from a quantile sketch of bounded size
    (relative error 1e-3), not an exact one that would ship every distinct
    timestamp to the driver."""
    t = F.unix_micros(F.col(ts_col).cast("timestamp")).cast("double")
    bounds = df.select(t.alias("t")).approxQuantile(
        "t", [i / chunks for i in range(1, chunks)], 1e-3)
    edges = [None] + sorted(set(bounds)) + [None]
    out = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (t > F.lit(lo))
        if hi is not None:
            cond = cond & (t <= F.lit(hi))
        out.append(df.filter(cond))
    return out


def write_time_ordered(df: DataFrame, path: str, ts_col: str, chunks: int = 4) -> None:
    """Append the time ranges one after another (arrival order = time order)."""
    for part in time_chunks(df, ts_col, chunks):
        part.write.mode("append").parquet(path)


def _latest(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """The rows that the last micro-batch before ``batch_id`` wrote under ``path``."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(full).parquet(path).filter(F.col("batch_id") < batch_id)
    last = rows.agg(F.max("batch_id")).first()[0]
    return rows.filter(F.col("batch_id") == F.lit(last)).drop("batch_id")


def degradation_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                       baseline: dict | float | None = 1.1, batch_size: int = 100,
                       threshold: float = 0.1, max_files_per_trigger: int | None = 16) -> DataFrame:
    """Run the stream over ``source_dir`` (prediction-log parquet) until all
    available files are processed; return all closed batches.

    A micro-batch numbers its rows per model by exact positions (range
    partitions, so a model with all of the traffic is spread over many tasks)
    and goes on from the state of the micro-batch before: one row per model with
    the next batch's number and the count and error sum it already has.  Closed
    batches and the new state are written under ``batch_id=<n>``; a micro-batch
    that is run again overwrites what it had written and counts once.

    The sums differ from the batch operator's only in order, i.e. in the last bits."""
    batches, states = f"{sink_dir}/batches", f"{sink_dir}/state"
    reader = spark.readStream.schema(schemas.PREDICTION_LOG)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if isinstance(baseline, dict):  # one entry a model
        own = F.create_map(*[F.lit(x) for kv in baseline.items() for x in kv])[F.col("model_id")] if baseline else F.lit(None)
    else:
        own = F.lit(baseline)

    def step(feed: DataFrame, batch_id: int) -> None:
        known = feed.filter("actual IS NOT NULL AND model_id IS NOT NULL").select(
            "model_id", "ts", "user_id", "movie_id", F.abs(F.col("predicted") - F.col("actual")).alias("err"))
        pos = global_positions(known, ["ts", "user_id", "movie_id"], by=["model_id"], name="pos")
        state = _latest(spark, states, batch_id, DEGRADATION_STATE)
        at = F.coalesce("n", F.lit(0)) + F.col("pos")
        rows = pos.join(F.broadcast(state.select("model_id", "batch", "n")), "model_id", "left").select(  # one row a model
            "model_id", (F.coalesce("batch", F.lit(0)) + F.floor(at / batch_size)).cast("long").alias("batch"), "err", "ts")
        sums = rows.groupBy("model_id", "batch").agg(F.count("*").alias("n"), F.sum("err").alias("err_sum"), F.max("ts").alias("last_ts"))
        sums = sums.unionByName(state).groupBy("model_id", "batch").agg(
            F.sum("n").alias("n"), F.sum("err_sum").alias("err_sum"), F.max("last_ts").alias("last_ts"))
        closed = F.col("n") == batch_size
        mae = F.col("err_sum") / F.col("n")
        base = F.coalesce(own.cast("double"), mae)
        deg = F.when(base != 0, (mae - base) / base)
        out = sums.filter(closed).select(
            "model_id", "batch", "n", F.col("last_ts").alias("batch_end_ts"), mae.alias("batch_mae"), base.alias("baseline_mae"),
            (deg * 100.0).alias("degradation_pct"), F.coalesce(deg > threshold, F.lit(False)).alias("alert"))
        # a model's last batch goes on, or the one after it begins empty
        last = sums.groupBy("model_id").agg(F.max(F.struct("batch", "n", "err_sum", "last_ts")).alias("l")).select("model_id", "l.*")
        new = last.select("model_id", (F.col("batch") + closed.cast("long")).alias("batch"), F.when(closed, 0).otherwise(F.col("n")).alias("n"),
                          F.when(closed, 0.0).otherwise(F.col("err_sum")).alias("err_sum"), "last_ts")
        out.write.mode("overwrite").parquet(f"{batches}/batch_id={batch_id}")
        new.write.mode("overwrite").parquet(f"{states}/batch_id={batch_id}")

    q = (reader.parquet(source_dir).writeStream.foreachBatch(step)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, batches):
        return spark.createDataFrame([], BATCH_OUT)
    return spark.read.schema(BATCH_OUT).parquet(batches).drop("batch_id")


CLASSIFIED_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("experiment_group", T.StringType()), T.StructField("is_error", T.BooleanType()),
    T.StructField("latency_ms", T.DoubleType()), T.StructField("cache_hit", T.BooleanType()),
    T.StructField("error", T.BooleanType()), T.StructField("latency_update", T.BooleanType()),
])
CLASSIFIED_STATE = T.StructType([T.StructField("has_success", T.BooleanType()), T.StructField("last_us", T.LongType())])


def _classify_fn(ttl_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:  # the watermark is past the key's horizon: no row can use it any more
            state.remove()
            return
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        ok = ~pdf["is_error"].to_numpy(dtype=bool)
        at = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        had, last = state.get if state.exists else (False, int(at[0]))
        # after a pause longer than the horizon a key starts anew
        fresh = np.diff(at, prepend=last) > ttl_us
        part = np.cumsum(fresh)
        done = np.concatenate([[0], np.cumsum(ok)[:-1]])  # successes before each row
        first = np.searchsorted(part, part, side="left")  # the first row of its part
        hit = (done - done[first] > 0) | ((part == 0) & bool(had))
        pdf = pdf.assign(cache_hit=hit, error=(~hit) & (~ok), latency_update=(~hit) & ok)
        end = part == part[-1]
        state.update((bool(ok[end].any() or (part[-1] == 0 and had)), int(at[-1])))
        state.setTimeoutTimestamp(max(int(at[-1] + ttl_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pdf[[f.name for f in CLASSIFIED_OUT.fields]]

    return fn


def request_classification_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                                  checkpoint: str, max_files_per_trigger: int | None = 16,
                                  ttl_seconds: float = 90 * 86400.0, watermark: str = "1 hour") -> DataFrame:
    """T2 part 1: classify a request-log stream into hits / misses / errors.

    A key (user, n, group) is remembered for ``ttl_seconds`` of event time after
    its last request: a request that comes later is a miss again.  The rule looks
    at event times only, so it doesn't depend on how the feed is cut into
    micro-batches; a timer on the watermark removes the key's state once no row
    can fall within the horizon.  Rows behind the watermark are dropped by Spark
    and counted in the query's progress.  With a horizon longer than the feed the
    result equals ``serving.classify_requests``."""
    reader = spark.readStream.schema(schemas.REQUEST_LOG)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    feed = reader.parquet(source_dir).withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", watermark)
    out = feed.groupBy("user_id", "n", "experiment_group").applyInPandasWithState(
        _classify_fn(int(ttl_seconds * 1e6)), CLASSIFIED_OUT, CLASSIFIED_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    q = (out.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(CLASSIFIED_OUT).parquet(sink_dir)


SESSIONS_OUT = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("start_ts", T.TimestampNTZType()),
    T.StructField("end_ts", T.TimestampNTZType()), T.StructField("n_events", T.LongType()),
    T.StructField("length_seconds", T.DoubleType()),
])


def session_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, gap_seconds: float = 1800.0,
                   watermark: str = "1 hour", max_files_per_trigger: int | None = 16) -> tuple[DataFrame, int]:
    """B8 as a stream over an event feed (user_id, ts): every session that the
    watermark has closed, appended once, and the number of late rows dropped.

    A pause of ``gap_seconds`` ends a session, as in ``sessions.sessions``; events
    are merged into sessions in each task before they are shuffled, so a user
    with most of the events is combined early.  Sessions that may still go on
    stay in the state until later events arrive."""
    reader = spark.readStream.schema("user_id long, ts timestamp_ntz")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    feed = reader.parquet(source_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)
    # Spark joins events whose windows touch; a pause of exactly the gap shall part them
    gap = f"{int(gap_seconds * 1e6) - 1} microseconds"
    found = feed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_events"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = found.select("user_id", "start_ts", "end_ts", "n_events", ((micros("end_ts") - micros("start_ts")) / 1e6).alias("length_seconds"))
    local = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(local, "false")
    spark.conf.set(local, "true")
    try:
        q = (out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set(local, before)
    q.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    return spark.read.schema(SESSIONS_OUT).parquet(sink_dir), late


def request_metrics_stream(spark: SparkSession, classified_dir: str, sink_dir: str, checkpoint: str,
                           watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """T2 part 2: requests, hits, misses and errors per tumbling event-time
    window; late rows beyond the watermark are dropped by Spark."""
    feed = spark.readStream.schema(CLASSIFIED_OUT).parquet(classified_dir)
    # watermarks need a TIMESTAMP event-time column (session time zone is UTC)
    agg = (feed.withColumn("event_time", F.col("ts").cast("timestamp"))
           .withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", window).alias("w"))
           .agg(F.count(F.lit(1)).alias("requests"),
                F.sum(F.col("cache_hit").cast("int")).cast("bigint").alias("cache_hits"),
                F.sum((~F.col("cache_hit")).cast("int")).cast("bigint").alias("cache_misses"),
                F.sum(F.col("error").cast("int")).cast("bigint").alias("errors")))
    out = agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                     "requests", "cache_hits", "cache_misses", "errors")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # update mode: each micro-batch carries the windows it changed
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(sink_dir)

    q = (out.writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_windows(spark.read.parquet(sink_dir))


def latest_windows(updates: DataFrame) -> DataFrame:
    """Final value of every window from an update-mode log (last batch wins)."""
    cols = ["window_end", "requests", "cache_hits", "cache_misses", "errors"]
    agg = updates.groupBy("window_start").agg(
        F.max_by(F.struct(*cols), F.col("batch_id")).alias("v"))
    return agg.select("window_start", *[F.col(f"v.{c}").alias(c) for c in cols])


EMA_OUT = T.StructType([T.StructField("n_updates", T.LongType()),
                        T.StructField("avg_latency_ms", T.DoubleType())])


def latency_ema_stream(spark: SparkSession, classified_dir: str, sink_dir: str, checkpoint: str,
                       alpha: float = 0.1) -> DataFrame:
    """T2 part 3: latency EMA over successful misses.  Each micro-batch is
    folded by range partitions and composed with the state of the batch before;
    its state is one row under ``batch_id=<n>``, overwritten when a batch is
    run again, so a replay does not count twice.  Returns the last state."""
    feed = spark.readStream.schema(CLASSIFIED_OUT).parquet(classified_dir)

    def step(batch: DataFrame, batch_id: int) -> None:
        before = _ema_states(spark, sink_dir).filter(F.col("batch_id") < batch_id)
        last = before.orderBy(F.col("batch_id").desc()).first()
        state = (last["n_updates"], last["avg_latency_ms"]) if last else (0, 0.0)
        n, value = ema.compose(ema.fold_parts(batch, alpha), state)
        spark.range(1).select(F.lit(int(n)).cast("bigint").alias("n_updates"), F.lit(float(value)).alias("avg_latency_ms")) \
            .write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    q = (feed.filter(F.col("latency_update")).writeStream.foreachBatch(step)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return (_ema_states(spark, sink_dir).orderBy(F.col("batch_id").desc()).limit(1)
            .select("n_updates", "avg_latency_ms"))


def _ema_states(spark: SparkSession, sink_dir: str) -> DataFrame:
    """(n_updates, avg_latency_ms, batch_id), empty before the first batch."""
    schema = T.StructType([*EMA_OUT.fields, T.StructField("batch_id", T.LongType())])
    if not path_exists(spark, sink_dir):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink_dir)
