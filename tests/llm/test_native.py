"""Queries with SQL against DuckDB, native operators without Python, and the
defined cases of quality rules and decontamination against brute force."""

import re

import pytest

from pyspark.sql import functions as F

from recspark.llm import decontamination as dc
from recspark.llm import quality_rules as qr
from recspark.llm.queries import oracle_sql, queries
from tools.oracle_check import duck, frame_hash

SF = "/root/testdata/sf0.001"
NATIVE = ["op6_quality_rules", "op7_tool_calls", "op10_decontamination", "op13_exact_dedup"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    got = queries()[name](spark, SF)
    a, b = frame_hash(got.toPandas()), frame_hash(duck(SF).execute(oracle_sql()[name]).df())
    assert a[0] > 0 and a[:3] == b[:3]


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_hold_no_python(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup, covered = set(), 0, set()
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            covered.update(p for i in places for p in range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def test_quality_base_cases(make_docs):
    one = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \t\n", "a", one, f"{one} {one}", one + "\x0b\x0c\r" + "é" * 5, "a b " * 30, "x\n" * 30, "|#*$%&<> " * 25,
             "w " * 7, "w " * 8, "w " * 9, f"{one}\n{one}\n \n{one}", "日本 " * 30, "long " * 40_000, "a\xa0b c"]
    rows = qr.line_rules(make_docs(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _base(texts[r["doc_id"]])


def test_lines_above_the_limit(make_docs):
    body = lambda i: "\n".join(" ".join(f"d{i}x{j}y{k}" for k in range(12)) for j in range(4))
    line = "All  Rights reserved by the 2024 owners of this page and of all others like it here"
    rows = [(i, f"{body(i)}\n{line}", "h") for i in range(30)]
    rows += [(100 + i, f"{line.lower().replace('2024', '1999')}\nshort text {i} of few words", "h") for i in range(3)]
    rows += [(200 + i, f"{body(200 + i)}\n{line}", "other") for i in range(5)]
    rows += [(300 + i, body(300), "h") for i in range(60)]  # exact copies are one text
    rows += [(None, f"{body(999)}\n{line}", "h"), (3, f"{body(3)}\n{line}", "h")]
    docs = make_docs(rows)
    got = {(r["doc_id"], r["n_removed_lines"], r["kept"]) for r in qr.line_rules(docs).collect()}
    assert {g for g in got if g[0] is not None and g[0] < 30} == {(0, 0, True), *((i, 1, True) for i in range(1, 30))}
    assert {g for g in got if g[0] in (100, 101, 102)} == {(100 + i, 1, False) for i in range(3)}
    assert all(k and n == 0 for i, n, k in got if i is not None and i >= 200) and (None, 1, True) in got
    out = qr.quality_filter(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r for r in out.collect()}
    assert line in texts[0]["text"] and texts[5]["text"] == body(5) and texts[5]["n_chars"] == len(body(5))
    assert out.count() == len(rows) - 3
    assert qr.line_rules(make_docs([])).collect() == []


def test_hot_host_keeps_its_clean_rows(make_docs):
    """One host of good texts: near copies and chance lines stay, boilerplate goes."""
    # digits do not tell lines apart, so names are letters
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    body = lambda i, n: "\n".join(" ".join(f"{name(i)}x{name(j)}y{name(k)}" for k in range(12)) for j in range(n))
    notice = "All rights reserved by the owners of this page and of all others like it here"
    rows = [(i, body(i, 3) + ("\nthe." if i % 30 == 0 else "") + (f"\n{notice}" if i % 10 == 1 else ""), "hot")
            for i in range(2000)]
    rows += [(5000 + i, f"{body(5000, 4)}\nname {name(i)} of the family", "hot") for i in range(50)]
    # a small host: one-word lines above the floor are cut, but do not speak against the document
    rows += [(8000 + i, "\n".join([body(8000 + i, 1), *[f"word{name(k)}." for k in range(40)]]), "small") for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in qr.quality_filter(make_docs(rows)).collect()}
    want = {d: t.replace(f"\n{notice}", "") if d != 1 else t for d, t, _ in rows if d < 8000}
    assert {d: t for d, t in got.items() if d < 8000} == want
    assert {d for d in got if d >= 8000} == {8000 + i for i in range(30)}
    assert got[8000] == rows[-30][1] and got[8001] == body(8001, 1)


def _words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_cases(spark, make_docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
        monkeypatch.setattr(dc, "BROADCAST_DOCS", 0)
    long = " ".join(f"b{i}" for i in range(30))
    items = [(1, long), (2, "short item"), (3, None), (4, "!!"), (5, long), (10, "É été"), (None, "nullid here"), (6, "rep " * 20)]
    texts = [f"x {long} y", "a Short, ITEM!", None, "", "été", "É ÉTÉ é été", " ".join(f"b{i}" for i in range(12)),
             "rep " * 13, "rep " * 12, "z " * 400 + long, "z " * 4000 + "short item", f"{long} {long}", "nullid here",
             "b0 b1-b2_b3\nb4 b5 b6 b7 b8 b9 B10 B11 B12"]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, n_words string")
    windows = set()
    for i, t in items:
        w = _words(t)
        n = min(13, len(w))
        windows |= {(tuple(w[k:k + n]), i) for k in range(len(w) - n + 1)} if w else set()
    rows = {r["doc_id"]: r for r in dc.contamination(make_docs(texts), bench).collect()}
    assert len(rows) == len(texts)
    import hashlib

    for d, text in enumerate(texts):
        w, hit, found = _words(text), set(), set()
        for g, i in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    if i is not None:
                        found.add(str(i))
        r = rows[d]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(found)), text[:50]
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r["contaminated"] == (bool(hit) and 20 * len(hit) >= len(w))


def test_rows_of_the_shuffled_windows_grow_with_the_words(make_docs, monkeypatch):
    """One row per window, and none of them carries the text."""
    rows = lambda n: dc.window_rows(make_docs([" ".join(f"w{i}" for i in range(n)), None, "one"]).select(
        "doc_id", F.xxhash64("text").alias("_th"), dc.item_words(F.col("text")).alias("_w")), [2, 13])
    assert rows(500).columns == ["doc_id", "_th", "start", "len", "_h"]
    assert [rows(n).count() for n in (1, 2, 13, 500, 5000)] == [0, 1, 13, 499 + 488, 4999 + 4988]


def test_copies_with_and_without_broadcast(spark, make_docs, monkeypatch):
    """Repeated rows, null ids and a passage in every text: the same rows both ways."""
    long = " ".join(f"b{i}" for i in range(30))
    docs = make_docs([(i, f"t{i % 7} {long}") for i in range(40)] + [(3, f"t3 {long}")] * 5 + [(None, long)] * 5 + [(None, None)] * 2)
    bench = spark.createDataFrame([(1, long), (2, "t3 b0")], "item_id long, text string")
    both = []
    for most in (500_000, 0):
        monkeypatch.setattr(dc, "BROADCAST_WINDOWS", most)
        both.append(sorted(map(str, dc.contamination(docs, bench).collect())))
    assert both[0] == both[1] and len(both[0]) == 52


def test_decontaminate_cuts_and_drops(spark, make_docs):
    bench = spark.createDataFrame([(2, "short item")], "item_id long, text string")
    many = " ".join(f"z{i}" for i in range(100))
    docs = make_docs([(1, "short item"), (2, f"({many} Short, item! tail"), (3, "plain"), (3, "plain"), (None, "plain"), (4, None)])
    out = dc.decontaminate(docs, bench)
    assert out.columns == docs.columns
    rows = sorted(((r["doc_id"] or 0), r["text"], r["n_chars"]) for r in out.collect() if r["text"])
    assert rows == [(0, "plain", 5), (2, f"({many} tail", len(many) + 6), (3, "plain", 5), (3, "plain", 5)]
    assert out.count() == 5
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(docs, empty).count() == 6 and dc.decontaminate(make_docs([]), bench).count() == 0
