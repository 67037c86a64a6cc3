"""Approximate and content-based similar items, factorisation by gradient
descent and the grid over it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recspark.operators import content, lsh, metrics, models, prep, scoring, sgd, tuning
from recspark.plans.tracking_plans import MF_GRID
from recspark.session import scratch_path
from recspark.sources import item_factors_view, ratings_view

SF = "/root/testdata/sf0.01"


def _factors(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vectors.items()],
                                 "movieId long, features array<double>")


def _recall(approximate, exact):
    a = approximate.select("movieId", "similar_movieId").toPandas()
    e = exact.select("movieId", "similar_movieId").toPandas()
    return len(a.merge(e)) / len(e)


# ---- approximate similar items ----

def test_lsh_recall_on_the_given_items(spark):
    f = item_factors_view(spark, SF).cache()
    got = lsh.similar_items_lsh(f, 10).cache()
    assert _recall(got, scoring.similar_items(f, 10)) >= 0.9
    assert got.count() == got.select("movieId", "rank").distinct().count() == got.select("movieId", "similar_movieId").distinct().count()


def test_lsh_recall_on_clusters_and_splits_large_buckets(spark):
    """40 clusters, one with a third of all items; buckets of at most 64 rows."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 16))
    of = np.where(np.arange(3000) % 3 == 0, 0, rng.integers(0, 40, 3000))
    f = _factors(spark, dict(enumerate(centres[of] + 0.3 * rng.standard_normal((3000, 16))))).cache()
    got = lsh.similar_items_lsh(f, 10, max_rows=64)
    assert _recall(got, scoring.similar_items(f, 10)) >= 0.9


def test_lsh_copies_null_and_zero_vectors(spark):
    """A third of the items are one vector: dealt over blocks and answered with the smallest ids."""
    rng = np.random.default_rng(1)
    vectors = {i: (np.ones(4) if i % 3 == 0 else rng.standard_normal(4)) for i in range(600)}
    vectors |= {9000: None, 9001: np.zeros(4), 9002: 2 * np.ones(4)}
    f = _factors(spark, vectors).cache()
    got = lsh.similar_items_lsh(f, 5, max_rows=16).toPandas().sort_values(["movieId", "rank"])
    assert not set(got.movieId) & {9000, 9001} and not set(got.similar_movieId) & {9000, 9001}
    mine = got[got.movieId == 300]
    assert list(mine.similar_movieId) == [0, 3, 6, 9, 12] and (mine.similarity == 1).all()
    assert list(got[got.movieId == 0].similar_movieId) == [3, 6, 9, 12, 15]


def test_lsh_blocks_meet_pairwise(spark, monkeypatch):
    """Where no bit cuts a bucket its blocks find what one block finds."""
    rng = np.random.default_rng(2)
    f = _factors(spark, dict(enumerate(np.ones(8) + 1e-4 * rng.standard_normal((300, 8))))).cache()
    exact = scoring.similar_items(f, 3).select("movieId", "similarity").groupBy("movieId").agg(F.min("similarity").alias("s"))
    got = lsh.similar_items_lsh(f, 3, bits=lsh.MAX_BITS, tables=1, max_rows=32)
    worst = got.groupBy("movieId").agg(F.min("similarity").alias("t"), F.count("*").alias("n")).join(exact, "movieId")
    assert worst.where("n = 3 AND abs(s - t) < 1e-5").count() >= 0.9 * 300


def test_lsh_few_and_no_items(spark):
    assert lsh.similar_items_lsh(_factors(spark, {})).count() == 0
    assert lsh.similar_items_lsh(_factors(spark, {1: None})).count() == 0
    assert lsh.similar_items_lsh(_factors(spark, {1: [1, 2]})).count() == 0
    assert lsh.similar_items_lsh(_factors(spark, {1: [1, 2], 2: [1, 2]})).count() == 2


# ---- content-based items ----

def _movies(spark, genres):
    return spark.createDataFrame([(i, f"m{i}", g) for i, g in enumerate(genres)], "movieId long, title string, genres string")


def _brute_content(genres, k, vocab):
    docs = [[t for t in (g or "").split("|") if t] for g in genres]
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    terms = sorted(df, key=lambda t: (-df[t], t))[:vocab]
    x = np.array([[d.count(t) * np.log((len(docs) + 1) / (df[t] + 1)) for t in terms] for d in docs])
    c = np.cov(x, rowvar=False)
    var, vec = np.linalg.eigh(c)
    at = np.argsort(-var, kind="stable")[:k]
    vec = vec[:, at]
    vec = vec * np.sign(vec[np.argmax(np.abs(vec), axis=0), np.arange(vec.shape[1])])
    return (x - x.mean(axis=0)) @ vec


def test_content_factors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["Action", "Drama", "Comedy", "Sci-Fi", "Noir", "War", "Crime"]
    genres = ["|".join(rng.choice(words, rng.integers(1, 5), p=np.arange(1, 8) / 28).tolist()) for _ in range(200)] + [None, "", "Drama|Drama"]
    for k, vocab in ((3, 100), (50, 5)):
        got = {r["movieId"]: r["features"] for r in content.content_factors(_movies(spark, genres), k, vocab).collect()}
        want = _brute_content(genres, k, vocab)
        assert len(got) == len(genres) and np.allclose([got[i] for i in range(len(genres))], want, atol=1e-8)


def test_content_similar_finds_equal_genres(spark):
    got = content.content_similar(_movies(spark, ["A|B", "C", "A|B", "C|D", "E", "D"]), 1).toPandas().set_index("movieId")
    assert got.similar_movieId[0] == 2 and got.similar_movieId[2] == 0 and got.similarity[0] == pytest.approx(1)
    assert content.content_similar(_movies(spark, [])).count() == 0


# ---- gradient descent ----

def _plain_sgd(rows, blocks, block_of, rank, epochs, lr, reg, seed):
    """One rating after the other, in the stated order of visits."""
    mu = np.mean([r for _, _, r in rows])
    ids = [sorted({x[k] for x in rows}) for k in (0, 1)]
    vec = [dict(zip(i, sgd.first_factors(np.array(i), k, rank, seed))) for k, i in enumerate(ids)]
    bias = [dict.fromkeys(i, 0.0) for i in ids]
    cells = {}
    for r in sorted(rows):
        cells.setdefault((block_of[r[0]], block_of[r[1]]), []).append(r)
    for _ in range(epochs):
        for s in range(blocks):
            for (ub, ib), rs in cells.items():
                if (ib - ub) % blocks != s:
                    continue
                rounds = sgd.rounds_of(np.array([r[0] for r in rs]), np.array([r[1] for r in rs]))
                for _, (u, i, r) in sorted(zip(rounds.tolist(), rs)):
                    p, q = vec[0][u], vec[1][i]
                    err = r - (mu + bias[0][u] + bias[1][i] + p @ q)
                    bias[0][u] += lr * (err - reg * bias[0][u])
                    bias[1][i] += lr * (err - reg * bias[1][i])
                    vec[0][u], vec[1][i] = p + lr * (err * q - reg * p), q + lr * (err * p - reg * q)
    return vec, bias


@pytest.mark.parametrize("blocks", [1, 3])
def test_sgd_equals_one_rating_after_the_other(spark, blocks):
    rng = np.random.default_rng(5)
    rows = sorted({(int(u), int(i)): (int(u), int(i), float(r)) for u, i, r in zip(
        rng.integers(0, 30, 400), rng.integers(0, 20, 400), rng.integers(1, 11, 400) / 2)}.values())
    df = spark.createDataFrame(rows, "userId long, movieId long, rating double").repartition(5)
    block_of = {r["id"]: r["b"] for r in spark.range(30).selectExpr("id", f"pmod(xxhash64(id), {blocks}) b").collect()}
    model = sgd.fit_sgd(df, n_factors=4, n_epochs=3, lr_all=0.05, reg_all=0.02, blocks=blocks)
    vec, bias = _plain_sgd(rows, blocks, block_of, 4, 3, 0.05, 0.02, 42)
    for k, (factors, key) in enumerate(((model.user_factors, "userId"), (model.item_factors, "movieId"))):
        got = {r[key]: r for r in factors.collect()}
        assert set(got) == set(vec[k])
        assert all(np.allclose(got[x]["features"], vec[k][x]) and abs(got[x]["bias"] - bias[k][x]) < 1e-9 for x in got)


def test_sgd_learns_and_its_parameters_take_effect(spark):
    """A table of rank two: the test error falls towards the noise, and is
    bounded by that of alternating least squares on the given split."""
    rng = np.random.default_rng(6)
    p, q = rng.standard_normal((80, 2)), rng.standard_normal((60, 2))
    rows = [(u, i, float(3 + p[u] @ q[i] * 0.7 + 0.1 * rng.standard_normal())) for u in range(80) for i in range(60)]
    df = spark.createDataFrame(rows, "userId long, movieId long, rating double").withColumn("t", F.expr("(userId * 7 + movieId) % 5 = 0")).cache()
    train, test = df.where("NOT t"), df.where("t").select("userId", "movieId", "rating")
    err = lambda **k: metrics.accuracy(sgd.fit_sgd(train, n_factors=4, **k).predict(test)).first()["rmse"]
    few, many, slow = err(n_epochs=3, lr_all=0.02), err(n_epochs=60, lr_all=0.02), err(n_epochs=3, lr_all=0.001)
    assert many < few < slow and many < 0.35


def test_sgd_not_worse_than_least_squares(spark):
    split = prep.temporal_split(ratings_view(spark, SF)).cache()
    train, test = split.where("split = 'train'"), split.where("split = 'test'").select("userId", "movieId", "rating")
    by_sgd = metrics.accuracy(sgd.fit_sgd(train).predict(test)).first()["rmse"]
    by_als = metrics.accuracy(models.fit_explicit(train, rank=8, max_iter=5).predict(test)).first()["rmse"]
    assert by_sgd <= by_als


def test_sgd_without_ratings(spark):
    empty = spark.createDataFrame([], "userId long, movieId long, rating double")
    assert sgd.fit_sgd(empty, n_epochs=1).user_factors.count() == 0


def test_grid_goes_on_after_a_stop(spark):
    assert len(MF_GRID) == 9 and {c["lr_all"] for c in MF_GRID} == {0.005, 0.007}
    rows = [(u, i, float((u + i) % 5 + 1)) for u in range(20) for i in range(15)]
    df = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    grid = [{"name": f"g{k}", "n_factors": 2, "n_epochs": k + 1, "lr_all": lr, "reg_all": 0.02} for k, lr in enumerate((0.005, 0.05, 0.05))]
    log, calls = scratch_path(spark, "grid"), []

    def fit(train, **params):
        calls.append(params["n_epochs"])
        if len(calls) == 3 and params["n_epochs"] == 3:
            raise RuntimeError("lost")
        return sgd.fit_sgd(train, **params)

    with pytest.raises(RuntimeError):
        tuning.grid_search(df, df, grid, fit, log, side_by_side=1)
    got = tuning.grid_search(df, df, grid, fit, log).toPandas().set_index("name")
    assert calls == [1, 2, 3, 3] and len(got) == 3
    assert got.val_rmse["g0"] > got.val_rmse["g1"] and got.lr_all["g0"] == 0.005 and (got.training_time > 0).all()


def test_bias_grid_without_ratings(spark):
    empty = spark.createDataFrame([], "userId long, movieId long, rating double")
    assert tuning.bias_grid(empty, empty, [{"name": "a", "reg_user": 5.0, "reg_item": 5.0, "n_sweeps": 2}]).count() == 1
