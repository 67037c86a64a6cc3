"""Disk that stays bounded: packed factors, parts of pairs, written tables."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from recspark.operators import scoring, sgd
from recspark.session import checkpoint_dir, drop_path, runtime_conf, scratch_path, written


def _tables(spark, name):
    """Bytes of the scratch tables of a name."""
    root = f"{checkpoint_dir(spark).removeprefix('file:').rstrip('/')}/tables"
    return {t: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(f"{root}/{t}") for f in fs if f.endswith(".parquet"))
            for t in (os.listdir(root) if os.path.isdir(root) else []) if t.startswith(f"{name}-")}


def test_factors_are_kept_once(spark, monkeypatch):
    """Whatever the number of epochs, the folder holds each block of factors once, and cells are visited without a shuffle."""
    rows = [(u, i, ((u * 3 + i) % 10 + 1) / 2) for u in range(60) for i in range(40)]
    train = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    plans, write = [], sgd._written
    monkeypatch.setattr(sgd, "_written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    size = []
    for epochs in (1, 4):
        before = _tables(spark, "sgd")
        model = sgd.fit_sgd(train, n_factors=30, n_epochs=epochs, blocks=3)
        new = {t: n for t, n in _tables(spark, "sgd").items() if t not in before}
        size.append(sum(new.values()))
        assert model.user_factors.count() == 60 and model.item_factors.count() == 40
    assert size[1] < 1.1 * size[0] and size[0] >= 100 * 31 * 8
    visits = [p for p in plans if "MapInArrow" in p and "FlatMapGroups" not in p]
    assert len(visits) == 9 + 36 and not any("Exchange" in p for p in visits)
    model.drop()
    assert not any(n for t, n in _tables(spark, "sgd").items() if t in new)


def test_pairs_in_parts(spark):
    """Wide vectors beyond the broadcast bound: the same rows as with one broadcast, and nothing is left but the result."""
    rng = np.random.default_rng(4)
    vec = lambda: rng.normal(size=20).tolist()
    users = spark.createDataFrame([(u, 0.1 * u, vec()) for u in range(30)], "userId long, bias double, features array<double>")
    items = spark.createDataFrame([(i, 0.2, vec()) for i in range(40)], "movieId long, bias double, features array<double>")
    pairs = spark.createDataFrame([(int(u), int(i)) for u, i in zip(rng.integers(0, 35, 300), rng.integers(0, 45, 300))] + [(None, 1), (2, None)],
                                  "userId int, movieId int")
    whole = [sorted(map(str, f(pairs, users, items).collect()))
             for f in (lambda *a: scoring.predict_explicit(*a, 3.0), scoring.predict_implicit)]
    with runtime_conf(spark, "spark.recspark.topk.broadcastBytes", "4000"):
        parts = [f(pairs, users, items) for f in (lambda *a: scoring.predict_explicit(*a, 3.0), scoring.predict_implicit)]
    assert [sorted(map(str, p.collect())) for p in parts] == whole
    assert not any(sum(_tables(spark, t).values()) for t in ("pairs", "users", "items"))


def test_written_tables_and_settings(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    df = written(spark.range(50).groupBy((F.col("id") % 5).alias("k")).count(), "mine", ("k",))
    assert sorted(map(tuple, df.select("k", "count").collect())) == [(k, 10) for k in range(5)]
    assert spark.conf.get(key) == before
    path = scratch_path(spark, "mine")
    written(spark.range(3), "mine", path=path)
    drop_path(spark, path)
    assert path.rsplit("/", 1)[1] not in _tables(spark, "mine")
    with pytest.raises(ValueError):
        drop_path(spark, "/somewhere/else")
