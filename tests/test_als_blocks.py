"""Model training with many ratings, and ratings that are written once."""

from __future__ import annotations

import datetime as dt

import pytest

from recspark.operators import models
from recspark.sources import ratings_view


def test_als_blocks_follow_the_ratings(spark, monkeypatch):
    least = models._default_blocks(spark, 100)
    assert least == max(2, spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(models, "ALS_BLOCK", 40)
    assert models._default_blocks(spark, 401) == 11
    rows = [(u, i, float((u * i) % 5 + 1)) for u in range(40) for i in range(30) if (u + i) % 3]
    train = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    for fit in (models.fit_explicit, models.fit_implicit):
        model = fit(train, rank=3, max_iter=2)
        assert model.user_factors.count() == 40 and model.item_factors.count() == 30
        assert model.predict(train).where("predicted_rating IS NULL" if model.kind == "explicit" else "score IS NULL").count() == 0


@pytest.mark.parametrize("blocks", [3])
def test_blocks_given_are_kept(spark, monkeypatch, blocks):
    monkeypatch.setattr(models, "ALS_BLOCK", 10)
    rows = [(u, i, float((u + i) % 5 + 1)) for u in range(12) for i in range(9)]
    train = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    many = {r["userId"]: r["features"] for r in models.fit_implicit(train, rank=2, max_iter=2, blocks=blocks).user_factors.collect()}
    monkeypatch.setattr(models, "ALS_BLOCK", 10_000)  # checkpoints have no effect on the factors
    few = {r["userId"]: r["features"] for r in models.fit_implicit(train, rank=2, max_iter=2, blocks=blocks).user_factors.collect()}
    assert set(many) == set(few) and all(many[u] == pytest.approx(few[u], abs=1e-5) for u in many)


def test_ratings_written_once(spark, tmp_path):
    day = lambda k: None if k is None else dt.datetime(1995, 1, 1 + k)
    orders = [(1, 7, day(3)), (2, 7, day(5)), (3, 8, None), (4, None, day(1)), (None, 9, day(2))]
    lines = [(1, 11, 1, 1, 10.0, 5.0), (2, 11, 1, 1, 31.0, 5.0), (2, 11, 1, 2, None, 5.0), (1, 12, 1, 2, 50.0, 1.0), (1, 12, 1, 2, 50.0, 1.0),
             (3, 11, 2, 1, 0.0, 1.0), (4, 13, 2, 1, 4.0, 1.0), (None, 13, 2, 1, 4.0, 1.0), (9, 13, 2, 1, 4.0, 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    got = ratings_view(spark, str(tmp_path), write=True)
    at = int(dt.datetime(1995, 1, 4, tzinfo=dt.timezone.utc).timestamp())
    want = {(7, 11, None, at + 2 * 86400), (7, 12, 5.0, at), (8, 11, 0.0, None), (None, 13, 0.5, at - 2 * 86400)}
    assert set(map(tuple, got.collect())) == want == set(map(tuple, ratings_view(spark, str(tmp_path)).collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
