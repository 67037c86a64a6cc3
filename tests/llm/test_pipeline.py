"""Every stage of the pipeline against a brute-force version on the rows that
the stage before it kept."""

import re
from collections import defaultdict

import corpus_pipeline as cp
from recspark.llm import pii
from recspark.llm import quality_rules as qr
from recspark.llm.common import stored, table
from tests.llm.test_native import _base, _words
from tests.llm.test_ngram_join import _brute as components
from tests.llm.test_packing import _check as check_pieces

SF = "/root/testdata/sf0.001"
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def _quality(rows):
    def normal(line):
        return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower())

    texts, first = defaultdict(set), {}
    for d, t, _, host, _ in rows:
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                key = host, normal(line)
                texts[key].add(t)
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t, lang, host, _ in rows:
        base = _base(t)
        lines = (t or "").split("\n")
        cut = {i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)
               and len(texts[host, normal(x)]) > qr.MAX_DOCS_PER_HOST and first[host, normal(x)] != d}
        left = base[0] - sum(len(re.findall(r"[^\x20\x09-\x0D]+", lines[i])) for i in cut)
        if base[-1] or cut and (left < qr.MIN_LEFT_WORDS or 100 * left < qr.MIN_LEFT_PCT * base[0]):
            continue
        text = "\n".join(x for i, x in enumerate(lines) if i not in cut) if cut else t
        out.append((d, text, lang, host, len(text)))
    return out


def _near(rows):
    least = {d: c for d, _, c in components([(r[0], r[1]) for r in rows])}
    return [r for r in rows if least[r[0]] == r[0]]


def _decontaminate(rows, items):
    windows = set()
    for t in items:
        w = _words(t)
        n = min(13, len(w))
        windows |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes = {len(g) for g in windows}
    out = []
    for d, t, lang, host, n in rows:
        w = _words(t)
        hit = {p for n_ in sizes for k in range(len(w) - n_ + 1) if tuple(w[k:k + n_]) in windows for p in range(k, k + n_)}
        if hit and 20 * len(hit) >= len(w):
            continue
        if hit:
            cls = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
            units = re.findall(rf"[^{cls}]+[{cls}]*", t)
            t = re.match(rf"[{cls}]*", t).group() + "".join(u for i, u in enumerate(units) if i not in hit)
            n = len(t)
        out.append((d, t, lang, host, n))
    return out


def _redact(rows):
    out = []
    for d, t, lang, host, _ in rows:
        t = pii.redacted(t)
        out.append((d, t, lang, host, len(t)))
    return out


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    rows = [tuple(r) for r in docs.select(COLS).collect()]
    brute = {"quality_rules": _quality, "ngram_jaccard_join": _near, "pii": _redact,
             "benchmark_decontamination": lambda rows: _decontaminate(rows, items)}
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == COLS
        rows = brute[name](rows)
        assert sorted(map(tuple, docs.collect())) == sorted(rows), name
    check_pieces(cp.STAGES[-1][1](spark, docs, SF).collect(), {r[0]: r[1] for r in rows}, padding=0.05)
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5


def test_odd_documents(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, f"{long} x y"), (4, " \n\t"), (5, f"{long} mail a@b.cc")]
    docs = make_docs(rows).selectExpr("*", "'clash' AS n_words", "1 AS kept")
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == [*COLS, "n_words", "kept"]
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} <= {3, 5, None} and pieces
    empty = make_docs([])
    for _, stage in cp.STAGES:
        empty_out = stage(spark, empty, SF)
        assert empty_out.count() == 0
