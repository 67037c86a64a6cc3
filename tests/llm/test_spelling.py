"""Spelling variants against brute force, and the filters' parts."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recspark.llm import spelling as sp


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if _near(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def _got(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_against_brute_force(make_docs):
    rng = np.random.default_rng(3)
    rows = [(None, "nullword nullword"), (5, None), (6, ""), (7, "short words only"), (7, "short words only")]
    base = ["recommend", "straßeééé", "aaaaaaaaa", "quantité", "Überfluss", "×÷letters"]
    for i in range(600):
        words = []
        for _ in range(30):
            w = base[int(rng.integers(len(base)))]
            if rng.random() < 0.1:
                k, c = int(rng.integers(len(w))), "aezÿé"[int(rng.integers(5))]
                w = [w[:k] + w[k + 1:], w[:k] + c + w[k + 1:], w[:k] + c + w[k:]][int(rng.integers(3))]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words) + "’日本"))
    rows.append((9000, "z" * 3000 + " " + "z" * 3000 + "\n" + "z" * 2999 + "! " + "z" * 2999))
    got = _got(sp.variants(make_docs(rows)))
    assert len(got) == len(set(got)) and set(got) == _brute(rows)
    assert any(r[1] for r in got)


def test_chains_reach_the_last_form(make_docs):
    words = ["abcdefgh"] * 2 + ["abcdefghi"] * 30 + ["abcdefghij"] * 400 + ["abcdefghijk"] * 6000
    rows = [(i, w) for i, w in enumerate(words)]
    got = _got(sp.variants(make_docs(rows)))
    assert set(got) == _brute(rows) and ("abcdefgh", "abcdefghi", "abcdefghijk") in {r[:3] for r in got}


def test_a_full_filter_changes_nothing(make_docs, monkeypatch):
    rows = [(i, f"fullfil{'abcdefghij'[i % 10]}er fullfiller{'abc'[i % 3]} filters") for i in range(300)]
    whole = _got(sp.variants(make_docs(rows)))
    monkeypatch.setattr(sp, "BITS", 1)
    monkeypatch.setattr(sp, "_CHUNK", 64)
    assert sorted(whole, key=str) == sorted(_got(sp.variants(make_docs(rows))), key=str)
    assert set(whole) == _brute(rows)


def test_empty_and_clashing_columns(spark, make_docs):
    assert sp.variants(make_docs([])).count() == 0
    assert sp.variants(make_docs([None, "", "kurz"])).count() == 0
    docs = make_docs(["variant variant"]).selectExpr("*", "1 AS word", "2 AS n", "3 AS near", "4 AS root", "5 AS form")
    assert _got(sp.variants(docs)) == [("variant", None, "variant", 2, 0, None)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abzéÿ", min_size=7, max_size=70), min_size=1, max_size=20, unique=True))
def test_no_near_word_is_missed(words):
    sizes, letters = Counter(), {}
    for w in words:
        s = sp.shard_of(len(w))
        sizes[s] += 1
        letters[s] = bytes(sorted({*letters.get(s, b""), *w.encode("latin-1")}))
    filters = sp.Filters(dict(sizes))
    for _, matrix in sp.by_length(words):
        h = sp.word_hashes(matrix)
        blocks = filters.block(sp.shard_of(matrix.shape[1]), h)
        for run in np.unique(blocks // np.uint64(sp._RUN_OF_BLOCKS)).tolist():
            own = blocks // np.uint64(sp._RUN_OF_BLOCKS) == run
            at = run * sp._RUN_OF_BLOCKS * 8
            bits = filters.bits_of_run(blocks[own], h[own])
            filters.words[at:at + len(bits)] |= bits[:len(filters.words) - at]
    found = set()
    for at, matrix in sp.by_length(words):
        for r, w in sp.probe(matrix, filters, letters[sp.shard_of(matrix.shape[1])]):
            if w.decode("latin-1") in words:
                pair = tuple(sorted((words[at[r]], w.decode("latin-1"))))
                assert pair not in found
                found.add(pair)
    assert found == {tuple(sorted((a, b))) for a in words for b in words if a < b and _near(a, b)}


@pytest.mark.parametrize("most", [1 << 9, 1 << 12, 1 << 20])
def test_filters_stay_below_their_bound(most):
    f = sp.Filters({7: 100_000, 8: 3, 64: 50_000}, most)
    assert len(f.words) * 64 <= max(most, 3 * 512)


def test_a_cut_run_that_gives_another_cut_run():
    """A run is cut to a word that is itself a run of the text and cut: only
    that run's own occurrences are cut again."""
    for k in range(1, 200_000):
        short = "abcdefg" + "".join(chr(97 + k // 26 ** i % 26) for i in range(4))
        if zlib.crc32(f"1:{short}".encode()) % 31:
            continue
        long = next((w for at in range(len(short) + 1) for c in "abcdefghijklmnopqrstuvwxyz"
                     for w in (short[:at] + c + short[at:],) for h in (zlib.crc32(f"1:{w}".encode()),)
                     if h % 31 == 0 and w[:h % len(w)] + w[h % len(w) + 1:] == short), None)
        if long:
            break
    at = zlib.crc32(f"1:{short}".encode()) % len(short)
    want = {short.encode(): 2, (short[:at] + short[at + 1:]).encode(): 3}
    for text in (f"{long} {long} {short} {short} {short}", f"{short} {long} {short} {long} {short}"):
        assert sp.words_of(1, text) == want
