"""Chunks against a byte-by-byte gear hash; spans against a dictionary."""

import random

import numpy as np

from recspark.llm import substring_dedup as sd
from recspark.llm.common import table
from recspark.llm.queries import op1_substring_dedup

SF = "/root/testdata/sf0.001"


def _slow_ends(raw):
    out, last, h = [], 0, 0
    cont = lambda k: k < len(raw) and raw[k] & 0xC0 == 0x80
    ends = []
    for i, b in enumerate(raw):
        h = ((h << 1) + int(sd._GEAR[b])) & 0xFFFFFFFF
        if h < 2 ** 32 // sd.DISTANCE:
            e = i + 1
            while cont(e):
                e += 1
            ends.append(e)
    for end in [*ends, len(raw)]:
        while end - last > sd.LARGEST:
            cut = last + sd.LARGEST
            while cont(cut):
                cut += 1
            if cut >= end:
                break
            out.append(cut)
            last = cut
        if end - last >= sd.LEAST or (end == len(raw) and end > last):
            out.append(end)
            last = end
    return out


def _brute(rows):
    """Spans as {(doc, start, end, chunks, cut bytes, first docs)}."""
    lists = [(d, t.encode(), sd.chunk_ends(t.encode()) if t else []) for d, t in rows]
    first, count = {}, {}
    for k, (d, raw, ends) in sorted(enumerate(lists), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        for a, b in zip([0, *ends], ends):
            first.setdefault(raw[a:b], (k, d, a))
            count[raw[a:b]] = count.get(raw[a:b], 0) + 1
    out = []
    for k, (d, raw, ends) in enumerate(lists):
        run = []
        for a, b in [*zip([0, *ends], ends), (None, None)]:
            if a is not None and count[raw[a:b]] > 1:
                run.append((a, b))
                continue
            if run and run[-1][1] - run[0][0] >= sd.SPAN_BYTES:
                firsts = [first[raw[x:y]] for x, y in run]
                cut = sum(y - x for (x, y), f in zip(run, firsts) if f[::2] != (k, x))
                out.append((d, run[0][0], run[-1][1], len(run), cut, tuple(sorted({f[1] for f in firsts if f[1] is not None}))))
            run = []
    return sorted(out, key=str)


def _got(df):
    return sorted(((r["doc_id"], r["start_byte"], r["end_byte"], r["n_chunks"], r["cut_bytes"], tuple(r["first_doc_ids"]))
                   for r in df.collect()), key=str)


def test_chunk_ends():
    rng = random.Random(1)
    texts = ["", "a", "é" * 500, "a" * 1000, "日本語テキスト" * 60, "".join(rng.choice("abc déf\n ") for _ in range(5000))]
    for t in texts:
        raw = t.encode()
        ends = sd.chunk_ends(raw) if raw else []
        assert ends == (_slow_ends(raw) if raw else [])
        assert not raw or ends[-1] == len(raw)
        for a, b in zip([0, *ends], ends):
            raw[a:b].decode()


def test_insertion_moves_only_near_chunks():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(3000)).encode()

    def pieces(raw):
        ends = sd.chunk_ends(raw)
        return {raw[a:b] for a, b in zip([0, *ends], ends)}

    a, b = pieces(text), pieces(text[:7000] + b"inserted words" + text[7000:])
    assert len(a - b) <= 6


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert _got(op1_substring_dedup(spark, SF)) == _brute(rows)


def test_passages_of_fifty_words_are_found(make_docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, pairs = [], 60
    for k in range(pairs):
        passage = prose(55)
        rows += [(2 * k, f"{prose(80)} {passage} {prose(60)}"), (2 * k + 1, f"{prose(30)} {passage}{prose(90)}")]
    rows += [(1000 + k, prose(200)) for k in range(100)]
    found = sd.repeated(make_docs(rows)).collect()
    hit = {r["doc_id"] for r in found}
    assert not [d for d in hit if d >= 1000]
    assert len(hit) >= 2 * pairs * 0.95
    assert all(r["first_doc_ids"] == [r["doc_id"] // 2 * 2] for r in found)


def test_defined_cases_and_dedup(make_docs):
    text = "some words that come again and again in more than one of the texts here, and nothing else at all"
    rows = [(5, text), (5, text), (3, f"{text} tail"), (None, text), (7, None), (8, ""), (2**60 + 1, "unique words of no importance")]
    docs = make_docs(rows)
    got = sd.repeated(docs).collect()
    assert {r["doc_id"] for r in got} == {3, 5, None}
    left = sorted(((r["doc_id"] or 0), r["text"]) for r in sd.dedup(docs).collect() if r["text"])
    assert sd.dedup(docs).columns == docs.columns
    assert (2**60 + 1, "unique words of no importance") in left and (3, f"{text} tail") in left
    assert sum(len(t) for _, t in left) < 2.2 * len(text) + 60
    assert sd.repeated(make_docs([])).collect() == []
    assert np.sum([r["n_chars"] or 0 for r in sd.dedup(docs).collect()]) == sum(len(t) for _, t in left)


def test_dedup_with_clashing_columns(make_docs):
    same = " ".join(f"passage{i}" for i in range(60))
    docs = make_docs([(1, same), (2, same), (None, "own")]).selectExpr(
        "*", "doc_id * 10 AS _row", "1 AS doc", "2 AS _r", "3 AS _cuts", "4 AS _text")
    out = {r["doc_id"]: r for r in sd.dedup(docs).collect()}
    assert sd.dedup(docs).columns == docs.columns and out[1]["_row"] == 10 and out[2]["_row"] == 20
    assert out[1]["text"] == same and len(out[2]["text"]) < len(same) and out[2]["n_chars"] == len(out[2]["text"])
    assert (out[2]["doc"], out[2]["_r"], out[2]["_cuts"], out[2]["_text"]) == (1, 2, 3, 4)
