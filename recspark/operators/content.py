"""Content-based items (M16): terms of the genres, principal components, cosine.

* ``term_weights``  term count times log((N + 1) / (df + 1)), one row per item
  and term;
* ``components``    the first principal components of these rows.  Their Gram
  matrix is summed in Spark over the term pairs of each item; the driver gets at
  most ``vocab_size`` squared sums, never an item;
* ``content_factors`` every item on the components, centred: a factor table like
  that of a trained model, which ``scoring.similar_items`` and
  ``lsh.similar_items_lsh`` take.

Components are ordered by variance (ties by the eigenvector that comes first
from the solver) and signed so that the largest loading is positive.  The
vocabulary is a parameter of the model: the ``vocab_size`` terms in most items
(ties by term).  An item without a known term is the origin of term space, so its
vector is that of the centred zero row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.operators import scoring
from recspark.operators.prep import parse_genres
from recspark.session import configure, scratch_path


def _terms(movies: DataFrame) -> DataFrame:
    """(movieId, term, tf)"""
    rows = parse_genres(movies).select("movieId", F.explode("genres_list").alias("term")).where("term IS NOT NULL AND term <> ''")
    return rows.groupBy("movieId", "term").agg(F.count("*").alias("tf"))


def term_weights(movies: DataFrame, vocab_size: int = 1024) -> tuple[DataFrame, list[str], int]:
    """((movieId, t, w), terms, items): ``t`` is the place of the term."""
    items = movies.select("movieId").distinct().count()
    terms = _terms(movies)
    df = terms.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(vocab_size).collect()
    names = [r["term"] for r in df]
    idf = [(r["term"], i, float(np.log((items + 1) / (r["df"] + 1)))) for i, r in enumerate(df)]
    known = movies.sparkSession.createDataFrame(idf, "term string, t int, idf double")  # vocab_size rows
    rows = terms.join(F.broadcast(known), "term").select("movieId", "t", (F.col("tf") * F.col("idf")).alias("w"))
    path = scratch_path(movies.sparkSession, "term-weights")
    rows.write.parquet(path)
    return movies.sparkSession.read.parquet(path), names, items


def gram_matrix(weights: DataFrame, size: int) -> np.ndarray:
    """Sums of w_s * w_t over all items.  An item's terms meet in one array of
    at most ``size`` entries; sums are combined before the shuffle."""
    rows = weights.groupBy("movieId").agg(F.collect_list(F.struct("t", "w")).alias("x"))
    pairs = rows.select("x", F.explode("x").alias("a")).select("a", F.explode("x").alias("b")).where("a.t <= b.t")
    sums = pairs.groupBy(F.col("a.t").alias("s"), F.col("b.t").alias("t")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("g"))
    out = np.zeros((size, size))
    for r in sums.toLocalIterator():
        out[r["s"], r["t"]] = out[r["t"], r["s"]] = r["g"]
    return out


def components(weights: DataFrame, size: int, items: int, n_components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components as columns, variances)."""
    mean = np.zeros(size)
    for r in weights.groupBy("t").agg(F.sum("w").alias("s")).collect():
        mean[r["t"]] = r["s"] / items
    cov = (gram_matrix(weights, size) - items * np.outer(mean, mean)) / max(1, items - 1)
    var, vec = np.linalg.eigh(cov)
    order = np.argsort(-var, kind="stable")[:n_components]
    var, vec = var[order], vec[:, order]
    sign = np.sign(vec[np.argmax(np.abs(vec), axis=0), np.arange(vec.shape[1])])
    return mean, vec * np.where(sign == 0, 1, sign), var


def content_factors(movies: DataFrame, n_components: int = 50, vocab_size: int = 1024) -> DataFrame:
    """(movieId, features) of every movie."""
    spark = movies.sparkSession
    configure(spark)
    weights, names, items = term_weights(movies, vocab_size)
    ids = movies.select("movieId").distinct()
    if not names:
        return ids.select("movieId", F.array().cast("array<double>").alias("features"))
    mean, vec, _ = components(weights, len(names), items, n_components)
    centre = -(mean @ vec)

    def project(batches):
        import pyarrow as pa

        for b in batches:
            terms, n = b.column(1).flatten(), np.diff(b.column(1).offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), n)
            x = np.zeros((b.num_rows, vec.shape[1]))
            np.add.at(x, row, vec[terms.field("t").to_numpy()] * terms.field("w").to_numpy()[:, None])
            x += centre
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * vec.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([b.column(0), lists], names=["movieId", "features"])

    # an item's terms meet in one short list, in order; only lists are moved, not an item's components one by one
    known = weights.groupBy("movieId").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("x"))
    none = F.array().cast(known.schema["x"].dataType)
    rows = ids.join(known, "movieId", "left").select("movieId", F.coalesce("x", none).alias("x"))
    return rows.mapInArrow(project, f"movieId {ids.schema['movieId'].dataType.simpleString()}, features array<double>")


def content_similar(movies: DataFrame, n: int = 10, n_components: int = 50, vocab_size: int = 1024) -> DataFrame:
    """Top-n other items by cosine on the components."""
    return scoring.similar_items(content_factors(movies, n_components, vocab_size), n)
