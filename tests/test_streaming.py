"""Streams against the batch operators: replayed batches, hot keys, expiry of
state, late rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from recspark import schemas
from recspark.operators import ab, monitor
from recspark.session import scratch_path
from recspark.streaming import monitor_stream as ms

T0 = dt.datetime(2024, 1, 1)


def _predictions(n, models):
    return [(i % 50, i, float(i % 7) / 2, None if i % 11 == 0 else float(i % 5), models(i), T0 + dt.timedelta(seconds=i // 3))
            for i in range(n)]


def _log(spark, rows):
    df = spark.createDataFrame(rows, "user_id long, movie_id long, predicted double, actual double, model_id long, ts timestamp_ntz")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.PREDICTION_LOG.fields])


def _rows(df):
    return sorted((r["model_id"], r["batch"], r["n"], r["batch_end_ts"], round(r["batch_mae"], 9), r["alert"]) for r in df.collect())


def _uncommit(path):
    """Forgets that the last micro-batch ended, as after the loss of the driver."""
    folder = path.removeprefix("file:") + "/commits"
    last = max(int(f) for f in os.listdir(folder) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{folder}/{name}"):
            os.remove(f"{folder}/{name}")


def test_degradation_with_a_hot_model_and_replays(spark):
    rows = _predictions(2500, lambda i: 7 if i % 10 else i % 3)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("feed", "sink", "ckpt"))
    for lo in range(0, 2500, 617):
        _log(spark, rows[lo:lo + 617]).repartition(3).write.mode("append").parquet(src)
        got = ms.degradation_stream(spark, src, sink, ckpt, baseline={7: 1.0, 0: 0.0}, batch_size=50)
    log = _log(spark, rows)
    base = spark.createDataFrame([(7, 1.0), (0, 0.0)], "model_id long, baseline_mae double")
    want = _rows(monitor.degradation_batches(log, base, batch_size=50))
    assert _rows(got) == want and len(want) > 30
    _uncommit(ckpt)
    assert _rows(ms.degradation_stream(spark, src, sink, ckpt, baseline={7: 1.0, 0: 0.0}, batch_size=50)) == want


def test_degradation_edges(spark):
    """No row, no known actual, batches that end with the feed, one file at a time."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("feed", "sink", "ckpt"))
    _log(spark, []).write.parquet(src)
    assert ms.degradation_stream(spark, src, sink, ckpt).count() == 0
    _log(spark, [(1, 1, 1.0, None, 1, T0)]).write.mode("append").parquet(src)
    assert ms.degradation_stream(spark, src, sink, ckpt).count() == 0
    rows = [(1, i, 2.0, 1.0, 1, T0 + dt.timedelta(seconds=i)) for i in range(20)]
    for lo in (0, 10):
        _log(spark, rows[lo:lo + 10]).coalesce(1).write.mode("append").parquet(src)
        got = ms.degradation_stream(spark, src, sink, ckpt, baseline=None, batch_size=10, max_files_per_trigger=1)
    assert [(r["batch"], r["batch_mae"], r["degradation_pct"]) for r in got.orderBy("batch").collect()] == [(0, 1.0, 0.0), (1, 1.0, 0.0)]


def _requests(spark, rows):
    """(event_id, hour, user, is_error)"""
    full = [(i, T0 + dt.timedelta(hours=h), u, 10, "control", e, 5.0) for i, h, u, e in rows]
    df = spark.createDataFrame(full, "event_id long, ts timestamp_ntz, user_id long, n long, experiment_group string, is_error boolean, latency_ms double")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.REQUEST_LOG.fields])


def _expected_hits(rows, ttl_hours):
    out, state = {}, {}
    for i, h, u, e in sorted(rows, key=lambda r: (r[1], r[0])):
        had, last = state.get(u, (False, h))
        had = had and h - last <= ttl_hours
        out[i] = had
        state[u] = (had or not e, h)
    return out


@pytest.mark.parametrize("cuts", [[], [100], [30, 60, 90, 200]])
def test_classification_expires_alike_however_the_feed_is_cut(spark, cuts):
    import random

    rng = random.Random(8)
    hours = sorted(rng.choice([0.01, 0.5, 3, 30]) * rng.random() for _ in range(300))
    rows = [(i, sum(hours[:i]) / 10, rng.randrange(6), rng.random() < 0.4) for i in range(300)]
    src, sink, ckpt = (scratch_path(spark, n) for n in ("feed", "sink", "ckpt"))
    for lo, hi in zip([0, *cuts], [*cuts, 300]):
        _requests(spark, rows[lo:hi]).write.mode("append").parquet(src)
        got = ms.request_classification_stream(spark, src, sink, ckpt, ttl_seconds=4 * 3600)
    assert {r["event_id"]: r["cache_hit"] for r in got.collect()} == _expected_hits(rows, 4)


def test_classification_state_expires_and_late_rows_are_dropped(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("feed", "sink", "ckpt"))
    feed = [[(1, 0, 1, False), (2, 0.5, 2, False)], [(3, 20, 3, False)], [(4, 21, 3, False), (5, 1, 1, False)], [(6, 22, 1, False)]]
    left = []
    for part in feed:
        _requests(spark, part).coalesce(1).write.mode("append").parquet(src)
        got = ms.request_classification_stream(spark, src, sink, ckpt, ttl_seconds=3600)
        state = spark.read.format("statestore").load(ckpt).count()
        left.append(state)
    hits = {r["event_id"]: r["cache_hit"] for r in got.collect()}
    assert hits == {1: False, 2: False, 3: False, 4: True, 6: False}  # 5 came 19 hours late
    assert left[0] == 2 and left[-1] <= 2  # users 1 and 2 were forgotten


def test_sessions_equal_the_batch_and_late_rows_are_counted(spark):
    import random

    rng = random.Random(9)
    at, rows = 0.0, []
    for i in range(600):
        at += rng.choice([0, 5, 1799.999999, 1800, 4000]) / 40
        rows.append((i, 1 if i % 3 else rng.randrange(5), T0 + dt.timedelta(seconds=round(at, 6))))
    # pauses of exactly the gap and of a microsecond less
    end = rows[-1][2]
    for k, pause in enumerate((1799.999999, 1800.0, 3600.0)):
        end += dt.timedelta(seconds=pause)
        rows.append((600 + k, 77, end))
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    src, sink, ckpt = (scratch_path(spark, n) for n in ("feed", "sink", "ckpt"))
    for lo in range(0, len(rows), 150):
        spark.createDataFrame([r[1:] for r in rows[lo:lo + 150]], "user_id long, ts timestamp_ntz").write.mode("append").parquet(src)
        ms.session_stream(spark, src, sink, ckpt)
    close = lambda rows: spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.mode("append").parquet(src)
    close([(None, end + dt.timedelta(days=2))])
    got, late = ms.session_stream(spark, src, sink, ckpt)
    assert late == 0
    cols = ["user_id", "start_ts", "end_ts", "n_events", "length_seconds"]
    want = sorted(map(tuple, ab.session_table(events, "30 minutes").select(*cols).collect()))
    assert sorted(tuple(r) for r in got.where("user_id IS NOT NULL").select(*cols).collect()) == want
    close([(1, end), (2, end), (3, end + dt.timedelta(days=2))])
    got, late = ms.session_stream(spark, src, sink, ckpt)
    assert late == 2 and sorted(tuple(r) for r in got.where("user_id IS NOT NULL").select(*cols).collect()) == want
