"""Sources and sinks: CSV with quoted titles, partitioned splits, model files, run tables."""

import tempfile

from pyspark.sql import functions as F

from recspark.operators import models, tracking
from recspark.sources import files


def test_csv_round_trip_with_quoted_titles(spark):
    d = tempfile.mkdtemp(prefix="recspark-io-")
    with open(f"{d}/movies.csv", "w") as fh:
        fh.write('movieId,title,genres\n1,"American President, The (1995)",Comedy|Drama|Romance\n'
                 '2,"Say ""Hi"" (2001)",Comedy\n')
    with open(f"{d}/ratings.csv", "w") as fh:
        fh.write("userId,movieId,rating,timestamp\n1,1,4.5,964982703\n1,2,3.0,964982224\n")
    m = files.read_movies(spark, f"{d}/movies.csv").orderBy("movieId").collect()
    assert m[0].title == "American President, The (1995)" and m[1].title == 'Say "Hi" (2001)'
    r = files.read_ratings(spark, f"{d}/ratings.csv")
    assert r.schema["userId"].dataType.typeName() == "long" and r.count() == 2


def test_split_write_read_prunes(spark):
    d = tempfile.mkdtemp(prefix="recspark-split-")
    df = spark.createDataFrame([(1, 1, 4.0, 1, "train"), (1, 2, 3.0, 2, "test")],
                               "userId long, movieId long, rating double, timestamp long, split string")
    files.write_splits(df, d)
    t = files.read_splits(spark, d, "test")
    assert [r.movieId for r in t.collect()] == [2]
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan


def test_model_save_load(spark):
    uf = spark.createDataFrame([(1, 0.1, [1.0, 2.0])], "userId long, bias double, features array<float>")
    itf = spark.createDataFrame([(5, 0.2, [0.5, 0.5])], "movieId long, bias double, features array<float>")
    m = models.FactorModel(3.0, uf, itf, "explicit", {"rank": 2})
    d = tempfile.mkdtemp(prefix="recspark-model-")
    models.save_model(m, d)
    back = models.load_model(spark, d)
    assert back.mu == 3.0 and back.kind == "explicit" and back.params == {"rank": 2}
    pairs = spark.createDataFrame([(1, 5)], "userId long, movieId long")
    assert back.predict(pairs).first().predicted_rating == m.predict(pairs).first().predicted_rating


def test_tracker_runs(spark):
    d = tempfile.mkdtemp(prefix="recspark-runs-")
    tr = tracking.ExperimentTracker(spark, d)
    for name, rmse in (("a", 0.9), ("b", 0.8), ("c", None)):
        tr.start_run(name, {"team": "x"})
        tr.log_params({"rank": 10})
        if rmse is not None:
            tr.log_metrics({"val_rmse": rmse + 0.5}, step=0)
            tr.log_metrics({"val_rmse": rmse}, step=1)
        tr.end_run()
    top = tr.compare_runs("val_rmse", 2).collect()
    assert [r.run_name for r in top] == ["b", "a"] and top[0].metric_val_rmse == 0.8
    best = {(r.kind, r.key): r.value for r in tr.get_best_run("val_rmse").collect()}
    assert best[("param", "rank")] == "10" and float(best[("metric", "val_rmse")]) == 0.8
    import pytest

    with pytest.raises(ValueError):
        tr.compare_runs("rmse")
    assert tr.table("run_tags").filter(F.col("key") == "team").count() == 3


def test_package_probe_and_shared_write(spark):
    import io
    import zipfile

    from recspark.session import (_importable_on_executors, _package_zip, scratch_path,
                                  write_shared_bytes)

    assert _importable_on_executors(spark)
    path = scratch_path(spark, "pyfiles") + "/recspark.zip"
    write_shared_bytes(spark, path, _package_zip())
    local = path.split(":", 1)[1] if path.startswith("file:") else path
    names = zipfile.ZipFile(io.BytesIO(open(local, "rb").read())).namelist()
    assert "recspark/operators/blocks.py" in names and "recspark/session.py" in names
