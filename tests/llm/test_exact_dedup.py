"""Streaming deduplication against grouping by text."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from recspark.llm import exact_dedup as ed
from recspark.session import scratch_path


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def _brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(_norm(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def _write(spark, rows, path, parts=3, mode="append", extra=()):
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *extra)
    df.repartition(parts).write.mode(mode).parquet(path)


def _got(df, sha=True):
    rows = df.select("doc_id", "keep_id", "group_size", "kept", "digest").collect()
    return sorted((tuple(r) if sha else tuple(r)[:4] for r in rows), key=str)


ROWS = [(9, "a  b"), (3, "a\tb"), (5, "a b"), (4, "a b "), (1, None), (2, ""), (6, " "), (7, "\n\n"), (8, "ä\xa0b"), (8, "ä\xa0b"),
        (None, "a b"), (None, "only null"), (None, "only null"), (10, "A b"), (11, "x" * 300_000), (12, "x" * 300_000), (13, "x" * 299_999)]


def test_against_brute_force(spark):
    path = scratch_path(spark, "docs")
    _write(spark, ROWS, path, extra=[F.lit(1).alias(c) for c in ("digest", "n", "first", "at", "content", "file", "_d")])
    assert _got(ed.exact_dedup(spark, path)) == _brute(ROWS)


def test_single_file_and_empty_table(spark):
    path = scratch_path(spark, "docs")
    _write(spark, ROWS, path, parts=1)
    file = [f for f in spark.read.parquet(path).inputFiles()][0]
    assert _got(ed.exact_dedup(spark, file)) == _brute(ROWS)
    empty = scratch_path(spark, "docs")
    _write(spark, [], empty, parts=1)
    out = ed.exact_dedup(spark, empty)
    assert _got(out) == [] and out.columns[:2] == ["doc_id", "keep_id"]


@pytest.mark.parametrize("bytes_per_batch", [1, 1 << 36])
def test_state_goes_on_with_new_files(spark, monkeypatch, bytes_per_batch):
    """Texts seen in earlier batches and runs are known; smaller ids that come later take over."""
    monkeypatch.setattr(ed, "BATCH_BYTES", bytes_per_batch)
    path, store = scratch_path(spark, "docs"), scratch_path(spark, "store")
    rows = [(1000 + i, f"t {i % 40}") for i in range(200)]
    _write(spark, rows, path)
    ed.ingest(spark, path, store)
    assert _got(ed.decisions(spark, path, store)) == _brute(rows)
    more = [(i, f"t \n{i % 60}") for i in range(120)]
    _write(spark, more, path)
    ed.ingest(spark, path, store)
    assert _got(ed.decisions(spark, path, store)) == _brute(rows + more)
    ed.ingest(spark, path, store)  # nothing new
    assert _got(ed.decisions(spark, path, store)) == _brute(rows + more)


def test_state_is_on_disk_and_settings_are_put_back(spark):
    path, store = scratch_path(spark, "docs"), scratch_path(spark, "store")
    _write(spark, ROWS, path)
    ed.ingest(spark, path, store)
    assert not any(spark.conf.get(k, None) == v for k, v in ed._STATE_CONF.items() if "providerClass" in k)
    # of each partition of the state the shared folder holds a change log of RocksDB
    logs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.changelog").load(f"{store}/state/state")
    assert logs.count() > 0


def test_different_bytes_under_one_digest(spark):
    """A digest of one bit: nearly all texts collide and the bytes decide."""
    bit = lambda content: F.unhex(F.lpad((F.crc32(content.cast("binary")) % 2).cast("string"), 2, "0"))
    path = scratch_path(spark, "docs")
    _write(spark, ROWS, path)
    assert _got(ed.exact_dedup(spark, path, bit), sha=False) == sorted((r[:4] for r in _brute(ROWS)), key=str)


def test_hot_group_is_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(ed, "COPIES", 10)
    monkeypatch.setattr(ed, "BROADCAST_HITS", 0)
    rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(900)]
    path = scratch_path(spark, "docs")
    _write(spark, rows, path)
    assert _got(ed.exact_dedup(spark, path)) == _brute(rows)
