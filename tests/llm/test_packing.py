"""Every id lies in exactly one piece, checksums are those of the tokenizer's
ids, sequences are gapless and nearly full."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from recspark.llm import packing
from recspark.llm.queries import op2_packing
from recspark.llm.wordbpe import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"

ODD = ["Ünï ÇAFÉ naïve İstanbul", "a<|endoftext|>b", "don't we'll I'M 'S  x", "½ cup x²", "", "   ", None,
       "!!!'s '' ' \"", "Σίσυφος ΣΑΣ", "日本 語", "é \x85 a\xa0b", "ǅ ß ſ K", "a\x1cb", "x" * 3000]


PLAIN = Tokenizer.from_file(PATH)


def _ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_is_exact():
    with open(PATH, encoding="utf-8") as f:
        enc = WordEncoder(f.read(), max_pieces=8)
    for _ in range(2):
        for text, got in zip(ODD, enc.ids(ODD)):
            assert got.tolist() == _ids(text)[:-1], text


def _check(rows, texts, size=4096, padding=None):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = np.array(_ids(texts[d]), "<u4"), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
        assert at == len(ids)
    used = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        used += at
    if padding is not None:
        assert 1 - used / (size * len(by_seq)) <= padding


def test_query_matches_the_tokenizer(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    _check(op2_packing(spark, SF).collect(), docs, padding=0.02)


def test_odd_texts_and_small_sequences(make_docs):
    docs = make_docs(ODD)
    _check(packing.pack(docs, PATH, size=64).collect(), dict(enumerate(ODD)), size=64)


def test_nulls_repeats_and_empty_table(make_docs):
    rows = packing.pack(make_docs([(None, "a b"), (7, "a b"), (7, "a b"), (2**60 + 1, None)]), PATH).collect()
    assert sorted(((r["doc_id"] or 0), r["length"]) for r in rows) == [(0, 3), (7, 3), (7, 3), (2**60 + 1, 1)]
    assert len({r["sequence_id"] for r in rows}) == 1
    assert packing.pack(make_docs([]), PATH).collect() == []


def test_rows_without_text_are_spread_over_groups(make_docs):
    rows = packing.pack(make_docs([None] * 3000), PATH, size=4).collect()
    assert len(rows) == 3000 and len({r["sequence_id"] >> 32 for r in rows}) == 3


def test_assign_balances_cost():
    lengths = sorted([1000] * 8 + [100] * 80, reverse=True)
    pieces = packing.assign(lengths)
    cost = {}
    for _, _, length, s, _ in pieces:
        cost[s] = cost.get(s, 0) + packing.cost(length)
    assert len(cost) == 4 and max(cost.values()) / min(cost.values()) < 1.2


def test_slices_hold_every_text_once():
    import pyarrow as pa

    texts = ["a" * 10, None, "", "b" * (packing.SLICE + 5), "c", "d" * (packing.SLICE - 1), "e", "f"]
    parts = list(packing.slices(pa.array(texts)))
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= packing.SLICE for p in parts) and len(parts) == 4
    assert list(packing.slices(pa.array([], pa.string()))) == []
