"""The served table: a refresh equals a table built anew and touches only the
partitions of changed users."""

from pyspark.sql import functions as F

from recspark.operators import serving
from recspark.session import scratch_path

USERS = list(range(1, 41))
FACTORS = "userId long, features array<double>, bias double"


def _model(spark):
    uf = spark.createDataFrame([(u, [u % 3 - 1.0, u % 5 / 4.0], 0.01 * u) for u in USERS if u % 4], FACTORS)
    itf = spark.createDataFrame([(i, [i % 4 / 3.0, i % 7 - 3.0], 0.02 * i) for i in range(100, 112)],
                                FACTORS.replace("userId", "movieId"))
    return uf, itf


def _popular(spark, ids):
    return spark.createDataFrame([(i, 50.0 - k, k + 1) for k, i in enumerate(ids)], "movieId long, score double, rank long")


def _seen(spark, pairs):
    return spark.createDataFrame(pairs, "userId long, movieId long")


def _ids(spark, ids):
    return spark.createDataFrame([(u,) for u in ids], "userId long")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _files(spark, path):
    return {r[0] for r in spark.read.parquet(f"{path}/users").select(F.input_file_name()).distinct().collect()}


def test_refresh_equals_rebuild(spark):
    uf, itf = _model(spark)
    before, path = [(1, 100), (2, 101)], scratch_path(spark, "served-test")
    serving.write_served(path, _ids(spark, USERS[:30]), uf, itf, 3.0, _popular(spark, [100, 101]), 3, _seen(spark, before), parts=8)
    old_files = _files(spark, path)
    # one known user with new ratings, one who has now seen everything, a new known and a new unknown user, repeats
    after = [*before, (5, 111), (5, 110), *[(7, i) for i in range(100, 112)]]
    changed = [5, 7, 7, 31, 32]
    for _ in range(2):  # a repeated refresh changes nothing
        serving.refresh_served(path, _ids(spark, changed), uf, itf, 3.0, _popular(spark, [105, 103, 100]), 3,
                               _seen(spark, after), parts=8)
        log = _ids(spark, [*USERS[:30], 31, 32]).withColumnRenamed("userId", "user_id")
        whole = serving.serve_batch(log, uf, itf, 3.0, _popular(spark, [105, 103, 100]), 3, _seen(spark, after))
        got = serving.read_served(spark, path)
        assert got.columns == whole.columns
        assert _rows(got) == _rows(whole)
    assert not [r for r in _rows(serving.read_served(spark, path)) if r[0] == 7]
    kept = _files(spark, path) & old_files
    assert kept  # partitions without a changed user are the files of the first build
    parts = spark.read.parquet(f"{path}/users").where(F.col("user_id").isin(changed)).select("part").distinct().collect()
    assert not [f for f in kept for p in parts if f"part={p[0]}/" in f]


def test_nothing_changed_and_empty(spark):
    uf, itf = _model(spark)
    path = scratch_path(spark, "served-test")
    serving.write_served(path, _ids(spark, [1, 4]), uf, itf, 3.0, _popular(spark, [100]), 2, parts=4)
    files, rows = _files(spark, path), _rows(serving.read_served(spark, path))
    serving.refresh_served(path, _ids(spark, []), uf, itf, 3.0, _popular(spark, [100]), 2, parts=4)
    assert _files(spark, path) == files and _rows(serving.read_served(spark, path)) == rows
    serving.refresh_served(path, _ids(spark, []), uf, itf, 3.0, _popular(spark, []), 2, parts=4)
    assert {r[4] for r in _rows(serving.read_served(spark, path))} == {"collaborative_filtering"}
