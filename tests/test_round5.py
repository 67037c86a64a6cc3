"""Top lists: what is sent to Python, and exclusions without an item."""

import pytest

from recspark.operators import blocks


def _nodes(plan, name):
    found = [plan] if plan.getClass().getSimpleName().startswith(name) else []
    kids = plan.children()
    return found + [n for i in range(kids.size()) for n in _nodes(kids.apply(i), name)]


def _lists(spark, broadcast_bytes, width=3):
    users = spark.createDataFrame([(1, 0.0, [1.0] * width), (2, 0.5, None), (3, 0.0, [-1.0] * width)], "u long, b double, f array<float>")
    items = spark.createDataFrame([(i, i / 10, [float(i)] * 3) for i in range(6)] + [(9, 9.0, None)], "i long, b double, f array<float>")
    seen = spark.createDataFrame([(1, 5), (1, 5), (1, None), (2, 9), (7, 1)], "u long, i long")
    return blocks.block_topk(users, items, 2, left_id="u", right_id="i", left_vec="f", right_vec="f", left_bias="b", right_bias="b",
                             exclude=seen, broadcast_bytes=broadcast_bytes, right_block_rows=4)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_no_null_lists_are_sent(spark, broadcast_bytes):
    plan = _lists(spark, broadcast_bytes)._jdf.queryExecution().optimizedPlan()
    node, = _nodes(plan, "FlatMapGroupsIn") + _nodes(plan, "FlatMapCoGroupsIn")
    fields = [f for i in range(node.children().size()) for f in node.children().apply(i).schema().fields()]
    lists = [f for f in fields if f.dataType().typeName() == "array"]
    assert lists and not any(f.nullable() for f in lists)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_exclusion_without_item_excludes_nothing(spark, broadcast_bytes):
    got = {}
    for r in sorted(_lists(spark, broadcast_bytes).collect(), key=lambda r: (r["u"], r["rank"])):
        got.setdefault(r["u"], []).append(r["i"])
    assert got == {1: [4, 3], 2: [5, 4], 3: [9, 0]}


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_odd_width_raises(spark, broadcast_bytes):
    with pytest.raises(Exception, match="feature vectors of 2 and of 3 numbers"):
        _lists(spark, broadcast_bytes, width=2).collect()


def test_logged_results_are_computed_once(spark, tmp_path):
    """Runs, params, metrics and tags are made of one computation of the results."""
    from pyspark.sql import functions as F

    from recspark.operators.tracking import ExperimentTracker

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        seen.add(1)
        return x * 1.0

    results = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x long").select("name", "x", value("x").alias("rmse"))
    tracker = ExperimentTracker(spark, str(tmp_path), "once")
    tracker.log_results(results, "name", ["x"], ["rmse"])
    assert seen.value == 2
    assert sorted((r["key"], r["value"]) for r in tracker.table("run_metrics").collect()) == [("rmse", 1.0), ("rmse", 2.0)]


def test_grid_shares_columns_of_equal_damping(spark, monkeypatch):
    from recspark.operators import tuning

    rows = [(u, i, ((u * 7 + i * 3) % 10 + 1) / 2) for u in range(12) for i in range(9) if (u + i) % 4]
    ratings = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    cfg = lambda name, u, i, s: {"name": name, "reg_user": u, "reg_item": i, "n_sweeps": s}
    configs = [cfg("a", 5.0, 2.0, 1), cfg("b", 5.0, 2.0, 3), cfg("c", 1.0, 2.0, 2)]
    alone = {c["name"]: tuning.bias_grid(ratings, ratings, [c]).first() for c in configs}
    widths, kept = [], type(ratings).checkpoint
    monkeypatch.setattr(type(ratings), "checkpoint", lambda self, *a: widths.append(len(self.columns) - 1) or kept(self, *a))
    got = {r["name"]: r for r in tuning.bias_grid(ratings, ratings, configs).collect()}
    for name, r in alone.items():
        assert got[name]["val_rmse"] == pytest.approx(r["val_rmse"], abs=1e-12)
        assert got[name]["val_mae"] == pytest.approx(r["val_mae"], abs=1e-12)
    assert widths == [2, 2, 2, 2, 1, 1]  # items, then users, of three sweeps


def test_gradient_descent_sends_no_null_lists(spark, monkeypatch):
    from recspark.operators import sgd

    plans, written = [], sgd._written
    monkeypatch.setattr(sgd, "_written", lambda df, name: plans.append(df._jdf.queryExecution().analyzed().toString()) or written(df, name))
    rows = [(u, i, ((u + i) % 10 + 1) / 2) for u in range(6) for i in range(5)]
    sgd.fit_sgd(spark.createDataFrame(rows, "userId long, movieId long, rating double"), n_factors=3, n_epochs=1, blocks=2)
    cells = [p for p in plans if "FlatMapGroupsInArrow" in p]
    assert len(cells) == 2 and not any("cast(null as array<double>)" in p for p in cells)


def test_markers_of_a_block_are_bounded(spark):
    """Few users and many exclusions (a refresh): blocks follow the exclusions."""
    users = spark.range(1000).selectExpr("id u", "0D b", "array(1F) f")
    items = spark.createDataFrame([(1, 0.0, [1.0])], "i long, b double, f array<float>")
    got = blocks.block_topk(users, items, 1, left_id="u", right_id="i", left_vec="f", right_vec="f", left_bias="b",
                            right_bias="b", exclude=spark.range(40_000_000).selectExpr("id u", "1L i"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(_lid" in plan and ", 40)" in plan


@pytest.mark.parametrize("limit, joins", [(1 << 20, 1), (0, 0)])
def test_pairs_are_not_moved_with_vectors(spark, limit, joins):
    """Item factors that were measured to be small are broadcast whatever Spark's own threshold."""
    from recspark.operators import scoring

    users = spark.createDataFrame([(1, 0.5, [1.0, 2.0]), (2, 0.0, [0.5, 0.5])], "userId long, bias double, features array<double>")
    items = spark.createDataFrame([(1, 0.1, [1.0, 0.0]), (3, 0.2, [0.0, 1.0])], "movieId long, bias double, features array<double>")
    pairs = spark.createDataFrame([(1, 1), (1, 3), (2, 3), (2, 4), (5, 1), (None, None)], "userId long, movieId long")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.recspark.topk.broadcastBytes": str(limit)}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = scoring.predict_explicit(pairs, users, items, 1.0)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = {(r["userId"], r["movieId"]): (round(r["predicted_rating"], 6), r["was_impossible"]) for r in got.collect()}
        implicit = {(r["userId"], r["movieId"]): r["cold_start_type"] for r in scoring.predict_implicit(pairs, users, items).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert plan.count("BroadcastHashJoin") == joins
    assert rows == {(1, 1): (2.6, False), (1, 3): (3.7, False), (2, 3): (1.7, False), (2, 4): (1.0, True), (5, 1): (1.1, True),
                    (None, None): (1.0, True)}
    assert implicit == {(1, 1): None, (1, 3): None, (2, 3): None, (2, 4): "movie", (5, 1): "user", (None, None): "user"}
