"""Cases beyond the fixture: long and odd averages, ties and odd vectors in the
top-k kernel, order-statistic cuts, repeated and empty inputs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recspark.operators import blocks, ema, metrics, ordering, prep, serving
from recspark.operators.models import FactorModel
from recspark.operators.tracking import ExperimentTracker, best_run
from recspark.session import scratch_path
from recspark.sources import files


def _ema(values, alpha):
    x = 0.0
    for v in values:
        x = v if x == 0 else alpha * v + (1 - alpha) * x
    return x


def _updates(spark, values):
    pdf = pd.DataFrame({"event_id": range(len(values)), "latency_ms": values})
    return spark.createDataFrame(pdf).select(
        F.timestamp_seconds(F.lit(10**9) + F.floor(F.col("event_id") / 3)).cast("timestamp_ntz").alias("ts"), "event_id",
        "latency_ms", F.lit(True).alias("latency_update"))


@pytest.mark.parametrize("alpha", [0.001, 0.1, 1.0])
def test_latency_ema_counts_every_update(spark, alpha):
    rng = random.Random(1)
    values = [0.0] * 40 + [rng.uniform(5, 50) for _ in range(15_000)]
    row = serving.latency_ema(_updates(spark, values), alpha).first()
    assert row.n_updates == len(values) and row.avg_latency_ms == pytest.approx(_ema(values, alpha), rel=1e-9)


def test_ema_state_is_carried_over_batches(spark):
    values, state = [0.0, 0.0, 3.0, 7.0, 0.0, 5.0, 9.0, 1.0], (0, 0.0)
    df = _updates(spark, values)
    for a, b in ((0, 2), (2, 3), (3, 3), (3, 8)):
        state = ema.compose(ema.fold_parts(df.where(F.col("event_id").between(a, b - 1)), 0.3), state)
    assert state[0] == len(values) and state[1] == pytest.approx(_ema(values, 0.3))


def _topk(spark, users, items, n, **kw):
    u = spark.createDataFrame(users, "userId long, features array<double>")
    i = spark.createDataFrame(items, "movieId long, features array<double>")
    return blocks.block_topk(u, i, n, left_id="userId", right_id="movieId", **kw)


@pytest.mark.parametrize("limit", [None, 0])
def test_ties_keep_n_per_row(spark, limit):
    items = [(i, [1.0, float(i % 2)]) for i in range(200, 0, -1)]
    got = _topk(spark, [(1, [0.0, 0.0]), (2, [9.0, 0.0]), (3, [0.0, 1.0])], items, 10, hi=5.0, lo=0.5, broadcast_bytes=limit,
                left_block_rows=2, right_block_rows=32).collect()
    lists = {u: [r.movieId for r in sorted(got, key=lambda r: r["rank"]) if r.userId == u] for u in (1, 2, 3)}
    assert lists[1] == lists[2] == list(range(1, 11)) and lists[3] == list(range(1, 20, 2))


def test_kernel_emits_at_most_n_per_row():
    l = pd.DataFrame({"_lid": [1, 2], "_lb": [0.0, 0.0], "_lv": [[0.0], [1.0]], "_xr": [None, None]})
    out = blocks._score_rows(l, np.arange(5000), np.zeros(5000), np.ones((5000, 1)), n_keep=10, offset=0.0, lo=0.5, hi=5.0,
                             cosine=False, exclude_self=False, chunk_rows=512, col_chunk=700)
    assert out.groupby("_lid").size().tolist() == [10, 10] and out["_rid"].max() == 9


def test_repeated_exclusions_and_odd_widths(spark):
    seen = spark.createDataFrame([(1, 3)] * 50, "userId long, movieId long")
    items = [(i, [float(i)]) for i in range(1, 5)]
    got = _topk(spark, [(1, [1.0])], items, 2, exclude=seen).collect()
    assert sorted(r.movieId for r in got) == [2, 4]
    with pytest.raises(Exception, match="feature vectors of"):
        _topk(spark, [(1, [1.0])], [(1, [1.0]), (2, [1.0, 2.0])], 2).collect()


def test_keys_at_any_position(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 5, 5, 5, rng.randrange(10**9)]), rng.randrange(50) if i % 9 else None, i) for i in range(9000)]
    df = spark.createDataFrame(rows, "a long, b long, c long").persist()
    want = sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r])
    at = [0, 17, 1800, 4500, 5400, 8999]
    found = ordering.keys_at(df, ["a", "b", "c"], at)
    assert found == [want[k] for k in at]
    assert [df.where(ordering.before(["a", "b", "c"], k)).count() for k in found] == at


@pytest.mark.parametrize("exact, sizes", [(False, (7200, 800, 2000)), (True, (7000, 1000, 2000))])
def test_temporal_split_with_equal_timestamps(spark, exact, sizes):
    df = spark.range(10_000).selectExpr("id % 100 AS userId", "id AS movieId", "3.0 AS rating", "7L AS timestamp")
    split = prep.temporal_split(df, exact=exact)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    n = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert (n["train"], n["val"], n["test"]) == sizes
    assert prep.random_split(df.limit(0)).count() == 0


def test_metrics_off_the_happy_path(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 99, 1)], "userId long, movieId long, rank long")
    rel = spark.createDataFrame([(1, 10), (1, 10), (2, 5)], "userId long, movieId long")
    got = {(r.userId, r.k): r for r in metrics.ranking_metrics(recs, rel, (0, 5)).collect()}
    assert got[1, 5].precision == pytest.approx(0.2) and got[1, 5].ndcg <= 1
    assert got[1, 0].precision == got[1, 0].recall == got[1, 0].ndcg == 0
    factors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0])], "movieId long, features array<double>")
    div = {r.userId: r.diversity for r in metrics.diversity_similarity(recs, factors).collect()}
    assert div == {1: 1.0, 2: 1.0}


def test_implicit_candidates(spark):
    uf = spark.createDataFrame([(1, [1.0])], "userId long, features array<double>")
    itf = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "movieId long, features array<double>")
    pop = spark.createDataFrame([(1, 1.0, 1)], "movieId long, score double, rank long")
    cand = spark.createDataFrame([(2,), (3,)], "movieId long")
    got = FactorModel(0.0, uf, itf, "implicit").recommend(uf.select("userId"), 3, candidates=cand, popular=pop).collect()
    assert sorted(r.movieId for r in got) == [2, 3]


def test_tracking_again_and_nan(spark):
    tr = ExperimentTracker(spark, scratch_path(spark, "runs"), "exp")
    res = spark.createDataFrame([("a", 1, 0.5), ("b", 2, float("nan"))], "name string, p int, val_rmse double")
    tr.log_results(res, "name", ["p"], ["val_rmse"])
    tr.log_results(res.where("name = 'a'"), "name", ["p"], ["val_rmse"])
    assert tr.table("runs").select("run_id").distinct().count() == 3
    assert [r.run_name for r in tr.compare_runs("val_rmse").collect()] == ["a", "a", "b"]
    for up in (True, False):
        assert {r.run_name for r in tr.get_best_run("val_rmse", up).collect()} == {"a"}
    with pytest.raises(ValueError, match="never logged"):
        best_run(tr.table("runs"), tr.table("run_params"), tr.table("run_metrics"), "nope")


def test_empty_inputs_and_history_order(spark):
    schema = "userId long, movieId long, rating double, timestamp long"
    empty = spark.createDataFrame([], schema)
    assert prep.clean_report(empty, empty).first().removed_pct is None
    assert prep.histogram(empty, "rating", 5).count() == 0
    df = spark.createDataFrame([(1, 1, 1.0, 0), (1, 2, 5.0, 0), (1, 3, 3.0, 0)], schema)
    assert [r.n for r in prep.histogram(df, "rating", 4).orderBy("bin").collect()] == [1, 0, 1, 1]
    movies = spark.createDataFrame([(i, f"m{i}", "g") for i in (1, 2, 3)], "movieId long, title string, genres string")
    assert [r.movieId for r in prep.user_history(df, movies).collect()] == [2, 3, 1]


def test_split_csv_and_tables_round_trip(spark):
    schema = "userId long, movieId long, rating double, timestamp long"
    df = spark.createDataFrame([(1, 2, 3.0, 4), (5, 6, 1.0, 8)], schema).withColumn("split", F.lit("test"))
    for _ in range(2):
        path = scratch_path(spark, "csv-split")
        files.write_splits(df, path, "csv")
        assert sorted(files.read_splits(spark, path, "test", "csv").drop("split").collect()) == sorted(df.drop("split").collect())
    wide = df.withColumn("user_avg_rating", F.lit(2.5))
    path = scratch_path(spark, "csv-wide")
    files.write_splits(wide, path, "csv")
    assert files.read_splits(spark, path, None, "csv", wide.schema).columns == [c for c in wide.columns if c != "split"] + ["split"]
    for fmt in ("parquet", "csv", "json"):
        path = scratch_path(spark, f"table-{fmt}")
        files.write_table(wide, path, fmt)
        assert sorted(files.read_table(spark, path, wide.schema, fmt).collect()) == sorted(wide.collect())
