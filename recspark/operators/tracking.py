"""Experiment tracking as tables.

A run log is four parquet tables under one root:
``runs(run_id, run_name, start_time, status)``, ``run_params(run_id, key,
value)``, ``run_metrics(run_id, key, value, step, ts)`` and
``run_tags(run_id, key, value)``.  The per-run API buffers a run's few rows
on the driver and appends them once at ``end_run``; ``log_results`` logs a
whole results DataFrame (e.g. a grid search) with one Spark write per table.
Queries over the log (compare, best run) are ordinary DataFrame plans.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark import schemas
from recspark.session import path_exists, scratch_path, shuffles_dropped


class ExperimentTracker:
    def __init__(self, spark: SparkSession, root: str, experiment: str = "default"):
        self.spark, self.root, self.experiment = spark, root.rstrip("/"), experiment
        self._run = None

    # ---------------------------------------------------------- per-run API

    def start_run(self, run_name: str | None = None, tags: dict | None = None) -> str:
        if self._run is not None:
            self.end_run()
        run_id = uuid.uuid4().hex
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        self._run = {"id": run_id, "name": run_name, "start": now, "params": [], "metrics": [],
                     "tags": [("run_name", run_name or "")] + [(k, str(v)) for k, v in (tags or {}).items()]}
        return run_id

    def log_params(self, params: dict) -> None:
        self._require()["params"].extend((k, str(v)) for k, v in params.items())

    def log_metrics(self, metrics: dict, step: int | None = None) -> None:
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        self._require()["metrics"].extend(
            (k, None if v is None else float(v), step, now) for k, v in metrics.items())

    def set_tags(self, tags: dict) -> None:
        self._require()["tags"].extend((k, str(v)) for k, v in tags.items())

    def end_run(self, status: str = "FINISHED") -> None:
        run = self._require()
        rid = run["id"]
        self._append("runs", [(rid, run["name"], run["start"], status)], schemas.RUNS)
        self._append("run_params", [(rid, k, v) for k, v in run["params"]], schemas.RUN_PARAMS)
        self._append("run_metrics", [(rid, k, v, s, t) for k, v, s, t in run["metrics"]], schemas.RUN_METRICS)
        self._append("run_tags", [(rid, k, v) for k, v in run["tags"]], schemas.RUN_TAGS)
        self._run = None

    def _require(self):
        if self._run is None:
            raise RuntimeError("no active run: call start_run first")
        return self._run

    def _append(self, table: str, rows: list, schema) -> None:
        if rows:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(
                f"{self.root}/{table}")

    # ---------------------------------------------------------- artifacts

    def artifact_path(self, name: str) -> str:
        return f"{self.root}/artifacts/run_id={self._require()['id']}/{name}"

    def log_table(self, df: DataFrame, name: str, fmt: str = "parquet") -> str:
        """Write a result table as an artifact of the active run."""
        path = self.artifact_path(name)
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
        return path

    def log_dict(self, data: dict, name: str) -> str:
        """Write a small dict (e.g. a results summary) as one JSON record."""
        import json

        path = self.artifact_path(name)
        self.spark.createDataFrame([(json.dumps(data, default=str),)], "json string") \
            .coalesce(1).write.mode("overwrite").text(path)
        return path

    def log_model(self, model, name: str = "model") -> str:
        """Save a FactorModel's tables under the run."""
        from recspark.operators.models import save_model

        path = self.artifact_path(name)
        save_model(model, path)
        return path

    # ---------------------------------------------------------- bulk logging

    def log_results(self, results: DataFrame, name_col: str, param_cols: list[str],
                    metric_cols: list[str], status: str = "FINISHED") -> None:
        """Log every row of ``results`` as one finished run.  run_id is the md5
        of experiment and run name, and of the number of earlier runs of that
        name when there are some, so logging again makes new runs."""
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        # four tables are made of the results: they are computed once
        path = scratch_path(self.spark, "results")
        results.write.parquet(path)
        results = self.spark.read.schema(results.schema).parquet(path)
        run = F.concat_ws("_", F.lit(self.experiment), F.col(name_col).cast("string"))
        base = results.withColumn("run_id", F.md5(run))
        if path_exists(self.spark, f"{self.root}/runs"):
            earlier = self.table("runs").groupBy(F.col("run_name").cast("string").alias("_name")).agg(F.count("*").alias("_k"))
            base = (results.join(earlier, F.col(name_col).cast("string") == F.col("_name"), "left")
                    .withColumn("run_id", F.md5(F.concat_ws("_", run, F.col("_k").cast("string")))).drop("_name", "_k"))
        base.select("run_id", F.col(name_col).alias("run_name"), F.lit(now).cast("timestamp_ntz")
                    .alias("start_time"), F.lit(status).alias("status")) \
            .write.mode("append").parquet(f"{self.root}/runs")
        params = base.select("run_id", F.explode(F.array(*[
            F.struct(F.lit(c).alias("key"), _as_text(F.col(c)).alias("value")) for c in param_cols
        ])).alias("p")).select("run_id", "p.key", "p.value")
        params.write.mode("append").parquet(f"{self.root}/run_params")
        mets = base.select("run_id", F.explode(F.array(*[
            F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in metric_cols
        ])).alias("m")).select("run_id", "m.key", "m.value", F.lit(None).cast("bigint").alias("step"),
                               F.lit(now).cast("timestamp_ntz").alias("ts"))
        mets.write.mode("append").parquet(f"{self.root}/run_metrics")
        base.select("run_id", F.lit("run_name").alias("key"), F.col(name_col).cast("string").alias("value")) \
            .write.mode("append").parquet(f"{self.root}/run_tags")

    # ---------------------------------------------------------- reads

    def table(self, name: str) -> DataFrame:
        schema = {"runs": schemas.RUNS, "run_params": schemas.RUN_PARAMS,
                  "run_metrics": schemas.RUN_METRICS, "run_tags": schemas.RUN_TAGS}[name]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def runs_wide(self) -> DataFrame:
        return runs_wide(self.table("runs"), self.table("run_params"), self.table("run_metrics"))

    def compare_runs(self, metric_name: str = "val_rmse", top_n: int = 5) -> DataFrame:
        return compare_runs(self.runs_wide(), metric_name, top_n)

    def get_best_run(self, metric_name: str = "val_rmse", ascending: bool = True) -> DataFrame:
        return best_run(self.table("runs"), self.table("run_params"), self.table("run_metrics"),
                        metric_name, ascending)


def _as_text(c):
    # str() of Python floats and ints, e.g. 15.0 -> '15.0', 3 -> '3'
    return c.cast("string")


def latest_metrics(run_metrics: DataFrame) -> DataFrame:
    """Latest value per (run, key) by (step, ts)."""
    return run_metrics.groupBy("run_id", "key").agg(
        F.max_by("value", F.struct(F.coalesce("step", F.lit(-1)), "ts")).alias("value"))


def runs_wide(runs: DataFrame, run_params: DataFrame, run_metrics: DataFrame) -> DataFrame:
    """One row per run: run_name, metric_<key> and param_<key> columns."""
    m = latest_metrics(run_metrics).withColumn("key", F.concat(F.lit("metric_"), "key"))
    p = run_params.groupBy("run_id", "key").agg(F.max("value").alias("value")) \
        .withColumn("key", F.concat(F.lit("param_"), "key"))
    mw = m.groupBy("run_id").pivot("key").agg(F.first("value"))
    pw = p.groupBy("run_id").pivot("key").agg(F.first("value"))
    return runs.select("run_id", "run_name", "start_time", "status").join(mw, "run_id", "left") \
        .join(pw, "run_id", "left")


def compare_runs(wide: DataFrame, metric_name: str = "val_rmse", top_n: int = 5) -> DataFrame:
    """Runs sorted by one metric ascending (always), top n."""
    col = f"metric_{metric_name}"
    if col not in wide.columns:
        raise ValueError(f"metric {metric_name!r} was never logged")
    return wide.orderBy(F.col(col).asc_nulls_last(), F.col("run_name")).limit(int(top_n))


def best_run(runs: DataFrame, run_params: DataFrame, run_metrics: DataFrame,
             metric_name: str = "val_rmse", ascending: bool = True) -> DataFrame:
    """The best run by one metric, with its params and metrics in long form
    (run_name defaults to 'unknown')."""
    lm = latest_metrics(run_metrics)
    target = lm.filter(F.col("key") == metric_name).join(runs.select("run_id", "run_name"), "run_id")
    if target.limit(1).count() == 0:
        raise ValueError(f"metric {metric_name!r} was never logged")
    value = F.when(~F.isnan("value"), F.col("value"))  # a NaN metric is no best value
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    best = target.orderBy(order, F.col("run_name")).limit(1).select("run_id", "run_name")
    params = run_params.join(best, "run_id").select(
        F.coalesce("run_name", F.lit("unknown")).alias("run_name"), F.lit("param").alias("kind"),
        "key", F.col("value").alias("value"))
    mets = lm.join(best, "run_id").select(
        F.coalesce("run_name", F.lit("unknown")).alias("run_name"), F.lit("metric").alias("kind"),
        "key", F.col("value").cast("string").alias("value"))
    return params.unionByName(mets)


def track_model_training(tracker: ExperimentTracker, run_name: str, fit, train: DataFrame,
                         val: DataFrame, test: DataFrame, algorithm_name: str,
                         hyperparams: dict) -> dict:
    """Log the algorithm, params and sizes, fit, score val and test in full,
    log metrics, the model and a results artifact, return the comparison row
    (algorithm, val/test rmse and mae, time)."""
    from recspark.operators.metrics import accuracy

    tracker.start_run(run_name, {"algorithm": algorithm_name})
    sizes = train.agg(F.count(F.lit(1)), F.countDistinct("userId"), F.countDistinct("movieId")).first()
    tracker.log_params({**hyperparams, "algorithm": algorithm_name, "train_size": sizes[0], "n_users": sizes[1],
                        "n_items": sizes[2], "val_size": val.count(), "test_size": test.count()})
    t0 = time.time()
    model = fit(train, **hyperparams)
    training_time = time.time() - t0
    out = {"algorithm": algorithm_name, "training_time": training_time}
    for name, df in (("val", val), ("test", test)):
        pairs = df.select("userId", "movieId", "rating")
        scored = model.predict(pairs)
        pcol = "predicted_rating" if "predicted_rating" in scored.columns else "score"
        with shuffles_dropped(tracker.spark):
            acc = accuracy(scored, "rating", pcol).first()
        out[f"{name}_rmse"], out[f"{name}_mae"] = acc["rmse"], acc["mae"]
    tracker.log_metrics({k: v for k, v in out.items() if k != "algorithm"})
    tracker.log_model(model)
    tracker.log_dict(out, "results.json")
    tracker.end_run()
    return out


def run_key(*parts) -> str:
    return hashlib.md5("_".join(str(p) for p in parts).encode()).hexdigest()
