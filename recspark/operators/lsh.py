"""Approximate similar items by random projections.

Each of ``tables`` hash tables cuts the space by hyperplanes through the origin;
the signs of a vector's projections are its bucket.  Items of one bucket are
scored exactly against each other and every item keeps its best ``n`` from each
table, so no pair rows leave a task.

* Bits and tables are chosen for a wanted recall: the angles between a sample of
  items and their true neighbours give the share of neighbours that meet in
  some table, the angles among the sample the work.  The recall is then measured
  on the sample and tables are added until it is reached (at most
  ``MAX_TABLES``; the exact path is ``scoring.similar_items``).
* A bucket above ``max_rows`` is cut by further bits of the same table, the
  same for all of its rows.  What no bit can cut (near copies) is dealt over
  blocks that meet pairwise, so every pair of a bucket is still scored.
* Equal vectors are one row in the tables; answers are handed to all of them.

Every item with a direction is indexed; null and zero vectors have no cosine and
no answer, as in the exact path.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.operators.blocks import _top as top_entries
from recspark.operators.blocks import block_topk
from recspark.session import checkpoint_dir, configure, scratch_path

#: bits of a table, bits added at a time to a large bucket, most tables
MAX_BITS, MORE_BITS, MAX_TABLES = 32, 4, 64
#: items whose true neighbours are looked up to choose the tables
SAMPLE = 256
#: pairs that could be scored while one more copy of a row is shuffled
_ROW_COST = 2000
_DIGITS = 6


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long vectors as a matrix."""
    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planes(width: int, tables: int, seed: int) -> np.ndarray:
    """(tables, MAX_BITS, width) normal vectors; more tables keep the first ones."""
    return np.stack([np.random.default_rng([seed, t]).standard_normal((MAX_BITS, width)) for t in range(tables)])


def expected(angles: np.ndarray, bits: int, tables: int) -> float:
    """Share of pairs at these angles that meet in at least one table."""
    return float(np.mean(1 - (1 - (1 - angles / math.pi) ** bits) ** tables))


def true_neighbours(items: DataFrame, n: int, sample: int = SAMPLE) -> DataFrame:
    """(movieId, other, s): the exact n nearest of a sample of items (those with
    the least hashes of their ids), looked up among all items."""
    some = items.orderBy(F.xxhash64("movieId"), "movieId").limit(sample)
    near = block_topk(some, items.withColumnRenamed("movieId", "other"), n, left_id="movieId", right_id="other",
                      cosine=True, exclude_self=True, score_name="s")
    return _written(near.select("movieId", "other", "s"), "lsh-truth")


def choose_tables(items: DataFrame, near: DataFrame, recall: float, max_rows: int) -> tuple[int, int]:
    """(bits, tables) of the least work that is expected to find ``recall`` of
    the true neighbours, with buckets of half of ``max_rows`` on the average at most."""
    cos = np.array([r["s"] for r in near.select("s").collect()])  # sample * n numbers
    some = items.join(F.broadcast(near.select("movieId").distinct()), "movieId").select("features")
    rows = np.array([r["features"] for r in some.collect()], float)
    count = items.count()
    least = max(1, math.ceil(math.log2(max(1, count) * 2 / max_rows)))
    if len(cos) == 0:
        return least, 1
    close = np.arccos(np.clip(cos, -1, 1))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    others = np.arccos(np.clip((unit @ unit.T)[np.triu_indices(len(unit), 1)], -1, 1)) if len(unit) > 1 else close
    best = None
    for bits in range(least, MAX_BITS + 1):
        tables = next((t for t in range(1, MAX_TABLES + 1) if expected(close, bits, t) >= recall), None)
        if tables is None:
            break
        work = tables * (_ROW_COST + count * expected(others, bits, 1))
        best = min(best or (work, bits, tables), (work, bits, tables))
    return best[1:] if best else (least, MAX_TABLES)


def _signatures(vectors: DataFrame, width: int, first: int, tables: int, seed: int) -> DataFrame:
    """(rep, features, sigs): the bits of every vector in the tables from
    ``first`` on, the first bit highest."""
    normals = planes(width, first + tables, seed)[first:].reshape(tables * MAX_BITS, width)
    weights = (1 << np.arange(MAX_BITS, dtype=np.int64))[::-1]

    def work(batches):
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column("features"))
            bits = (x @ normals.T >= 0).reshape(b.num_rows, tables, MAX_BITS)
            sig = bits.astype(np.int64) @ weights
            yield pa.record_batch([b.column("rep"), b.column("features"), pa.array(sig.tolist(), pa.list_(pa.int64()))],
                                  names=["rep", "features", "sigs"])

    schema = T.StructType([vectors.schema["rep"], vectors.schema["features"], T.StructField("sigs", T.ArrayType(T.LongType()))])
    return vectors.mapInArrow(work, schema)


def _cells(sigs: DataFrame, bits: int, max_rows: int) -> DataFrame:
    """(rep, table, level, bucket, rows): the bucket of each row and table, cut
    by as many bits as bring it to ``max_rows``, or by all."""
    levels = [*range(bits, MAX_BITS, MORE_BITS), MAX_BITS]
    rows = sigs.select("rep", F.posexplode("sigs").alias("table", "sig"))
    at = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("sig", MAX_BITS - k).alias("bucket")) for k in levels])
    each = rows.select("rep", "table", F.explode(at).alias("_c")).select("rep", "table", "_c.*")
    sizes = each.groupBy("table", "level", "bucket").agg(F.count("*").alias("rows"))
    # what is small at one level is small at all deeper ones: the first such level is the bucket
    fits = each.join(sizes.where((F.col("rows") <= max_rows) | (F.col("level") == MAX_BITS)), ["table", "level", "bucket"])
    first = F.min(F.struct("level", "bucket", "rows")).alias("_f")
    return fits.groupBy("rep", "table").agg(first).select("rep", "table", "_f.*")


def _scored(sigs: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """(rep, other, similarity): the best n of every vector in each cell."""
    parts = F.col("parts")
    dealt = (cells.withColumn("part", F.pmod(F.xxhash64("rep"), parts))
             # block p of a bucket meets every block q, itself included
             .withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
             .withColumn("i", F.least("part", "q")).withColumn("j", F.greatest("part", "q")))
    rows = dealt.join(sigs.select("rep", "features"), "rep").select("table", "level", "bucket", "i", "j", "part", "rep", "features")

    def work(key, group):
        import pyarrow as pa

        i, j = key[3].as_py(), key[4].as_py()
        group = group.sort_by("rep")
        ids, part = group["rep"].to_numpy(), group["part"].to_numpy()
        x = _matrix(group["features"])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        a, b, s = [], [], []
        for lo in range(0, len(x), 512):
            sims = np.round(x[lo:lo + 512] @ x.T, _DIGITS)  # -inf marks what is no pair of the cell
            own = np.arange(lo, min(lo + 512, len(x)))
            sims[np.arange(len(own)), own] = -np.inf
            if i != j:
                sims[part[own][:, None] == part[None, :]] = -np.inf
            r, c = top_entries(sims, n)  # of equal ones the smallest ids
            a.append(ids[own[r]])
            b.append(ids[c])
            s.append(sims[r, c])
        return pa.table({"rep": pa.array(np.concatenate(a), pa.int64()), "other": pa.array(np.concatenate(b), pa.int64()),
                         "similarity": pa.array(np.concatenate(s), pa.float64())})

    return rows.groupBy("table", "level", "bucket", "i", "j").applyInArrow(work, "rep long, other long, similarity double")


def similar_items_lsh(item_factors: DataFrame, n: int = 10, bits: int | None = None, tables: int | None = None,
                      recall: float = 0.95, max_rows: int = 4096, seed: int = 42) -> DataFrame:
    """Top-n other items by cosine among those that share a bucket.
    Result: movieId, similar_movieId, similarity, rank, as ``similar_items``."""
    spark = item_factors.sparkSession
    configure(spark)
    checkpoint_dir(spark)
    features = F.col("features").cast("array<double>")
    has_direction = F.exists(F.col("features"), lambda v: (v != 0) & ~F.isnan(v))
    items = item_factors.select(F.col("movieId").cast("bigint").alias("movieId"), features.alias("features"))
    items = _written(items.where(has_direction), "lsh-items")
    width = items.select(F.size("features").alias("w")).first()
    if width is None:
        return spark.createDataFrame([], "movieId bigint, similar_movieId bigint, similarity double, rank bigint")
    near = true_neighbours(items, n)
    chosen = choose_tables(items, near, recall, max_rows)
    bits, tables = bits or chosen[0], tables or chosen[1]

    reps = items.groupBy("features").agg(F.min("movieId").alias("rep"))
    members = _written(items.join(reps, "features").select("movieId", "rep"), "lsh-members")
    vectors = _written(reps.select("rep", "features"), "lsh-vectors")
    found, built = None, 0
    while True:
        sigs = _written(_signatures(vectors, width["w"], built, tables - built, seed), "lsh-signatures")
        cells = _cells(sigs, bits, max_rows).withColumn("parts", F.ceil(F.col("rows") / max_rows))
        more = _written(_scored(sigs, cells, n).groupBy("rep", "other").agg(F.max("similarity").alias("similarity")), "lsh-found")
        found, built = more if found is None else found.unionByName(more), tables
        asked = members.join(F.broadcast(near.select("movieId").distinct()), "movieId", "left_semi")
        hits = _answers(found, asked, members, n).join(near.withColumnRenamed("other", "similar_movieId"), ["movieId", "similar_movieId"])
        if built >= MAX_TABLES or hits.count() >= recall * near.count():
            return _answers(found, members, members, n)
        tables = min(MAX_TABLES, tables + max(1, tables // 2))


def _answers(found: DataFrame, asked: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The best n for every item of ``asked`` from the (rep, other, similarity) found."""
    found = found.join(asked.select("rep").distinct(), "rep", "left_semi").groupBy("rep", "other").agg(F.max("similarity").alias("similarity"))
    # ids that stand for a vector in an answer: its n + 1 smallest, one of which may be the asking item
    by_id = Window.partitionBy("rep").orderBy("movieId")
    firsts = members.withColumn("_k", F.row_number().over(by_id)).where(F.col("_k") <= n + 1)
    firsts = firsts.select(F.col("rep").alias("other"), F.col("movieId").alias("similar_movieId"))
    own = asked.select("rep").distinct().select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("similarity"))
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "similar_movieId")
    ranked = found.unionByName(own).join(firsts, "other").withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= n + 1)
    answers = ranked.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("_k", "similar_movieId", "similarity"))).alias("_a"))
    kept = F.slice(F.filter("_a", lambda x: x["similar_movieId"] != F.col("movieId")), 1, n)
    out = asked.join(answers, "rep").select("movieId", F.posexplode(kept).alias("_p", "_x"))
    return out.select("movieId", F.col("_x.similar_movieId").alias("similar_movieId"), F.col("_x.similarity").alias("similarity"),
                      (F.col("_p") + 1).cast("bigint").alias("rank"))
