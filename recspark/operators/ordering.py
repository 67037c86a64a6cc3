"""Exact positions in a global (or per-key) order without a one-partition window.

``Window.orderBy`` without ``partitionBy`` moves a whole table into one task,
and a per-key window moves a hot key into one task.  Instead:

1. range-partition on (keys, order) so partitions are balanced even when one
   key holds a third of the rows (the order columns split it),
2. sort within partitions and tag rows with ``monotonically_increasing_id``,
3. write the numbered rows as a table in the shared checkpoint folder, so
   the numbering is computed once and survives executor loss,
4. count rows per (partition, key) - a table of at most partitions + keys rows -
   and turn the counts into offsets with a window over that small table,
5. position = offset + (id - first id of the run).

This is the distributed equivalent of ``row_number() - 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recspark.session import checkpoint_dir, scratch_path


def global_positions(df: DataFrame, order_cols: list, by: list | None = None,
                     name: str = "pos", num_partitions: int | None = None,
                     with_total: bool = False):
    """Add ``name`` = 0-based position of each row in ``order_cols`` order
    (within each ``by`` group when given).  ``order_cols`` must make the order
    total, otherwise ties are numbered arbitrarily.  With ``with_total`` the
    result is ``(df, row_count)``; the count comes from the small offsets
    table, not from another pass over the input."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    by = list(by or [])
    keys = by + list(order_cols)
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = (df.repartitionByRange(parts, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mono", F.monotonically_increasing_id()))
    # the numbering is written once as a table in the shared folder: it is
    # computed once, survives executor loss, and the offsets pass below
    # reads only the (_pid, _mono, by) columns of it
    path = scratch_path(spark, "positions")
    numbered.write.parquet(path)
    numbered = spark.read.parquet(path)
    runs = numbered.groupBy("_pid", *by).agg(F.min("_mono").alias("_m0"),
                                              F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    runs = runs.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    # runs has <= partitions + distinct keys rows; AQE broadcasts it when its
    # measured size is under the broadcast threshold, else it is shuffled.
    out = numbered.join(runs.select("_pid", *by, "_m0", "_off"), ["_pid", *by])
    out = out.withColumn(name, (F.col("_off") + F.col("_mono") - F.col("_m0")).cast("bigint"))
    out = out.drop("_pid", "_mono", "_m0", "_off")
    if with_total:
        total = runs.agg(F.sum("_cnt")).first()[0] or 0
        return out, int(total)
    return out


#: buckets of a histogram pass, and rows that are sorted on the driver at the end
_BUCKETS, _FEW = 4096, 4096


def keys_at(df: DataFrame, cols: list[str], positions: list[int]) -> list[tuple]:
    """The values of the integer ``cols`` (a total order) in the rows at the
    given 0-based positions, without sorting or moving the table: a histogram
    of the first column finds the bucket that holds a position, the bucket is
    refined until few rows are left or one value, whose rows are then told
    apart by the next column.  Passes only aggregate; the driver gets at most
    ``_BUCKETS`` counts or ``_FEW`` keys at a time.  Nulls come first."""
    df = df.select(*cols)
    return [_key_at(df, list(cols), cols, int(k)) for k in positions]


def _key_at(df: DataFrame, cols: list[str], all_cols: list[str], k: int) -> tuple:
    while cols:
        c = F.col(cols[0])
        s = df.agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"),
                   F.count(F.when(c.isNull(), 1)).alias("nulls")).first()
        if s["n"] <= _FEW:
            return tuple(df.orderBy(*all_cols).limit(k + 1).collect()[k])
        if k < s["nulls"]:
            df, cols = df.where(c.isNull()), cols[1:]
            continue
        k -= s["nulls"]
        df = df.where(c.isNotNull())
        if s["lo"] == s["hi"]:
            cols = cols[1:]
            continue
        width = -(-(s["hi"] - s["lo"] + 1) // _BUCKETS)
        bucket = F.expr(f"(`{cols[0]}` - {s['lo']}L) div {width}L")
        for b, n in sorted(map(tuple, df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect())):
            if k < n:
                lo = s["lo"] + b * width
                df = df.where((c >= lo) & (c < lo + width))
                break
            k -= n
    return tuple(df.first())  # the rows that are left are equal


def before(cols: list[str], key: tuple) -> Column:
    """Whether a row stands before ``key`` in the order of ``cols``, nulls first."""
    out = F.lit(False)
    for c, v in reversed(list(zip(cols, key))):
        col = F.col(c)
        less = F.lit(False) if v is None else (col.isNull() | (col < F.lit(v)))
        out = less | (col.eqNullSafe(F.lit(v)) & out)
    return F.coalesce(out, F.lit(False))
