"""The manifest against a plain tree, and persistence of versions."""

import hashlib
import zlib

import pytest

from recspark.llm import merkle as mk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(r, lower=False):
    text = r["text"]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                      for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def _levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def _path(levels, at):
    out = []
    for nodes in levels[:-1]:
        lo = at // 8 * 8
        out.append(("".join(nodes[lo:at]), "".join(nodes[at + 1:lo + 8])))
        at //= 8
    return out


def _brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for rs in trees.values():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
    levels = {lang: _levels([_leaf(r) for r in trees[lang]]) for lang in langs}
    top = _levels([levels[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, r in enumerate(trees[lang]):
            path = _path(levels[lang], at) + _path(top, k)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            end = _leaf(r, hit)
            for left, right in path:
                end = _h(left + end + right)
            root = top[-1][0]
            out.append((r["doc_id"], _leaf(r), levels[lang][-1][0], root, _h("".join(a + b for a, b in path)), end, end == root))
    return out


def _rows(n, lang=lambda i: "en"):
    return [{"doc_id": i, "text": f"Text {i} É", "lang": lang(i), "source": None if i % 7 == 0 else "s", "n_chars": i} for i in range(n)]


def _got(spark, rows, docs=None):
    docs = docs if docs is not None else spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    return mk.manifest(docs)


CASES = {
    "one": _rows(1), "eight": _rows(8), "nine": _rows(9),
    # a lone language, one below and one above a block, one with a single leaf, one without a name
    "langs": _rows(700, lambda i: "en" if i < 520 else [None, "de", "é", "fr"][i % 4] if i < 699 else "zz"),
    "many_langs": _rows(90, lambda i: f"l{i % 45}"),
    "nulls": [{"doc_id": None, "text": "A", "lang": None, "source": None, "n_chars": None},
              {"doc_id": None, "text": None, "lang": "", "source": "", "n_chars": 0},
              {"doc_id": 3, "text": "", "lang": "", "source": "x", "n_chars": -5},
              *[{"doc_id": 8, "text": "Same", "lang": "", "source": "x", "n_chars": 4}] * 3,
              {"doc_id": 9, "text": "Lang " * 40_000, "lang": None, "source": "x", "n_chars": 4}],
}


@pytest.mark.parametrize("name", CASES)
def test_against_a_plain_tree(spark, name):
    rows = CASES[name]
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = [tuple(r) for r in _got(spark, rows).select(*cols).collect()]
    assert sorted(got, key=str) == sorted(_brute(rows), key=str)


def test_rounds_above_small_blocks(spark, monkeypatch):
    """Blocks of one level: every level is a round of its own."""
    rows = CASES["langs"]
    whole = sorted(map(tuple, _got(spark, rows).collect()), key=str)
    monkeypatch.setattr(mk, "HEIGHT", 1)
    monkeypatch.setattr(mk, "BLOCK", 8)
    assert sorted(map(tuple, _got(spark, rows).collect()), key=str) == whole


def test_empty_and_clashing_columns(spark):
    assert _got(spark, []).count() == 0
    docs = spark.createDataFrame([(1, "T", "en", "s", 1, 2, 3, 4)], SCHEMA + ", pos long, tree long, hash long")
    assert _got(spark, [], docs).count() == 1


def test_a_version_shares_all_but_the_way():
    tree = mk.subtree([_h(str(i)) for i in range(500)], 3)
    way = mk.places(77, 3)
    version = mk.changed(tree, way, "other")
    a, b, fresh = tree, version, 0
    for i in way:
        assert all(x is y for k, (x, y) in enumerate(zip(a[1], b[1])) if k != i)
        a, b, fresh = a[1][i], b[1][i], fresh + (a is not b)
    assert fresh == 3 and b[0] == "other" and tree == mk.subtree([_h(str(i)) for i in range(500)], 3)
    assert mk.changed(tree, way, _h("77")) == tree


def test_copied_nodes_lead_to_the_folded_root(spark):
    rows = _got(spark, CASES["langs"]).collect()
    assert all((r["copied"] is None) == (zlib.crc32(str(r["doc_id"]).encode()) % 3 != 0) for r in rows)
    assert all(r["copied"][-1] == r["folded_root"] for r in rows if r["copied"])
    assert all(r["verified"] for r in rows if not r["copied"])
