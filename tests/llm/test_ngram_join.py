"""Components against all pairs, on families, shared passages and odd texts."""

import random
import re

import numpy as np
import pytest

from recspark.llm import ngram_join as nj


def _set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def _brute(rows):
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def _got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def _corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 6)))
    prose = lambda n: [word() for _ in range(n)]
    line = prose(9)
    texts = []
    for _ in range(12):
        base = prose(rng.choice([6, 20, 60, 200, 900]))
        for _ in range(rng.choice([2, 3, 15])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 45)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
            base = w if rng.random() < 0.5 else base  # some families drift
    texts += [" ".join(line + prose(k % 7)) for k in range(40)]  # short texts round one line
    texts += [" ".join(prose(30) + line) for _ in range(20)]
    texts += [t.upper() for t in texts[:5]] + texts[5:9]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(make_docs, seed):
    rows = [(7 * i % 1009, t) for i, t in enumerate(_corpus(seed))]
    assert _got(nj.jaccard_components(make_docs(rows))) == _brute(rows)


def test_prefix_join_alone_finds_all_links(make_docs, monkeypatch):
    """Without partners from the sorts, the prefix join has to find every link."""
    monkeypatch.setattr(nj, "near_pairs", lambda nodes: nodes.select(nodes.row.alias("a"), nodes.row.alias("b")).limit(0))
    monkeypatch.setattr(nj, "CHUNK", 3000)
    rows = list(enumerate(_corpus(4)))
    assert _got(nj.jaccard_components(make_docs(rows))) == _brute(rows)


def test_shuffled_joins_give_the_same(make_docs, monkeypatch):
    monkeypatch.setattr(nj, "small", lambda df, rows=0: df)
    rows = list(enumerate(_corpus(5)))
    assert _got(nj.jaccard_components(make_docs(rows))) == _brute(rows)


def test_defined_cases(make_docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "x " * 30_000), (8, "x " * 40_000),
            (9, "one two three four five six"), (9, "one two three four five six"), (9, "another text under an id in use"),
            (None, "one two three four five six"), (None, "lonely words without any id at all"), (2**60 + 1, "é É ü x\xa0y z")]
    assert _got(nj.jaccard_components(make_docs(rows))) == _brute(rows)
    assert nj.jaccard_components(make_docs([])).collect() == []


def test_keep_one(make_docs):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (8, "other words altogether in here"), (9, None), (9, None)]
    docs = make_docs(rows)
    out = nj.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 8, 9, 9]


def test_keep_one_of_repeated_rows_and_null_ids(make_docs):
    """One row of each component, whatever its ids are."""
    one, two, three = "a b c d e f g", "quite other words are in here", "no one has said any of this"
    rows = [(3, one), (3, one), (5, one), (None, two), (None, two), (7, two), (None, three), (None, three), (3, "one more text under three")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in nj.keep_one(make_docs(rows)).collect())
    assert got == sorted([("3", one), ("7", two), ("None", three), ("3", "one more text under three")])


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for n in (0, 1, 500, 513, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2**63, n // 8).astype(np.uint64)]))
        x, y = nj.parity_sketch(a).view(np.uint64), nj.parity_sketch(b).view(np.uint64)
        while len(x) != len(y):
            x, y = (x, np.bitwise_xor(*np.split(y, 2))) if len(y) > len(x) else (np.bitwise_xor(*np.split(x, 2)), y)
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_shingles_do_not_depend_on_the_batch(monkeypatch):
    """Texts hashed together, in pieces or alone: equal sets of equal words only."""
    rng = random.Random(6)
    texts = [None, "", " \t", "one", "a b c d", "A b\x0bC d e", "é É \xa0x", "w" * 500, "\r".join("ab" * 40), " lead", "trail \n", "\ud800 x"]
    texts += [" ".join(rng.choice(["a", "bb", "ccc" * 9, "ä"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    alone = [next(nj.shingle_sets([t])).tolist() for t in texts]
    assert [len(s) for s in alone] == [len(_set(t)) for t in texts]
    assert [s.tolist() for s in nj.shingle_sets(texts)] == alone
    monkeypatch.setattr(nj, "PIECE", 64)
    monkeypatch.setattr(nj, "_POWERS", [])
    assert [s.tolist() for s in nj.shingle_sets(texts)] == alone
    named = {}
    for t, s in zip(texts, alone):
        assert named.setdefault(tuple(s), _set(t)) == _set(t)
    hashes, start = nj._words(" ".join(f"w{i}" for i in range(100_000)).encode())
    assert len(np.unique(hashes)) == len(start) == 100_000


def test_null_ids_never_meet_as_a_product(make_docs):
    """Two families of 5,000 rows without an id."""
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(None, f"{t} {i % 7}") for t in (one, two) for i in range(5000)] + [(4, one)]
    got = nj.jaccard_components(make_docs(rows)).groupBy("component_id").count().collect()
    assert sorted((str(r["component_id"]), r["count"]) for r in got) == [("4", 5001), ("None", 5000)]


def test_keep_one_with_clashing_columns(make_docs):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")]
    docs = make_docs(rows).selectExpr("*", "doc_id * 10 AS _row", "1 AS doc", "2 AS _r", "3 AS component_id", "4 AS comp")
    out = nj.keep_one(docs)
    assert out.columns == docs.columns and sorted(r["_row"] for r in out.collect()) == [10, 30]
