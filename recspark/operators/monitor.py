"""Model-quality monitoring (V5-V7, W7): MAE of every full batch of 100
predictions with a known actual, per model, against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.operators.ordering import global_positions


def baselines(model_ids: DataFrame, mae: float | None) -> DataFrame:
    """V5: baseline table (model_id, baseline_mae); ``None`` leaves it unset."""
    return model_ids.select("model_id").distinct().withColumn(
        "baseline_mae", F.lit(mae).cast("double"))


def degradation_batches(log: DataFrame, baseline: DataFrame, batch_size: int = 100,
                        threshold: float = 0.1) -> DataFrame:
    """Rows with an actual value are numbered per model in (ts, user,
    movie) order; every full batch of ``batch_size`` gives one MAE.

    degradation = (batch_mae - baseline) / baseline; a missing baseline means
    degradation 0 (the reference falls back to the current value); a zero
    baseline gives NULL and no alert.  Numbering uses range partitioning, so a
    model with most of the traffic is still spread over many tasks.
    """
    known = log.filter(F.col("actual").isNotNull())
    pos = global_positions(known, ["ts", "user_id", "movie_id"], by=["model_id"], name="_pos")
    batched = pos.withColumn("batch", F.floor(F.col("_pos") / batch_size).cast("bigint"))
    agg = (batched.groupBy("model_id", "batch")
           .agg(F.count(F.lit(1)).alias("n"),
                F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("batch_mae"),
                F.max("ts").alias("batch_end_ts"))
           .filter(F.col("n") == batch_size))
    j = agg.join(baseline.select("model_id", "baseline_mae"), "model_id", "left")
    base = F.coalesce(F.col("baseline_mae"), F.col("batch_mae"))
    deg = F.when(base == 0, F.lit(None).cast("double")).otherwise((F.col("batch_mae") - base) / base)
    return j.select("model_id", "batch", "n", "batch_end_ts", "batch_mae",
                    base.alias("baseline_mae"), (deg * 100.0).alias("degradation_pct"),
                    F.coalesce(deg > threshold, F.lit(False)).alias("alert"))


def degradation_alerts(batches: DataFrame) -> DataFrame:
    """V7: alert rows with metric name and message."""
    return batches.filter(F.col("alert")).select(
        "model_id", "batch", F.col("batch_end_ts").alias("timestamp"), F.lit("MAE").alias("metric"),
        F.col("baseline_mae").alias("baseline"), F.col("batch_mae").alias("current"),
        "degradation_pct",
        # fixed output: the alert text
        F.format_string("Model degradation detected! MAE increased by %.1f%%",
                        F.col("degradation_pct")).alias("message"))
