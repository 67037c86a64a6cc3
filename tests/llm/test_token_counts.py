"""Edited counts against encoding the edited text anew."""

import random

import public_tokenizers
import pytest

from recspark.llm import token_counts as tc
from recspark.llm.queries import op5_token_counts

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    with open(RANKS, encoding="utf-8") as f:
        return tc.Counter(f.read(), public_tokenizers.PATTERN)


def _edit(text, pos, delete, insert):
    pos = min(max(pos, 0), len(text))
    return text[:pos] + (insert or "") + text[pos + max(delete, 0):]


def test_random_edits_on_odd_texts(counter):
    rng = random.Random(5)
    bits = ["the", " ", "  ", "\n", "\t", "don't", "é", "\x1c", "\x85", "\xa0", "\u1680", "\u2028", "\u3000",
            "12", "!?", "日本", "x" * 30, "'", "s "]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 900)))
        tree = tc.SegmentTree(text, counter)
        for _ in range(25):
            assert tree.text() == text and tree.n_tokens == len(counter.encoding.encode_ordinary(text))
            pos, cut = rng.randrange(-3, len(text) + 4), rng.choice([0, 0, 1, 2, 40, 500])
            ins = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 30])))
            tree.edit(pos, cut, ins)
            text = _edit(text, pos, cut, ins)


def test_only_touched_blocks_are_encoded_again(counter):
    tree = tc.SegmentTree("word " * 100_000, counter)
    tree.edit(250_000, 3, "xyz")
    assert tree.reencoded <= 3 * tc.LEAF
    tree.edit(0, 0, "many " * 5000)  # outgrows its leaf: built anew
    assert tree.n_tokens == len(counter.encoding.encode_ordinary(tree.text()))


def test_query_against_full_encoding(spark, counter):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    edits = {r["doc_id"]: r for r in tc.revision_edits(docs).collect()}
    rows = op5_token_counts(spark, SF).collect()
    assert len(rows) == len(edits)
    for r in rows:
        text = edits[r["doc_id"]]["text"] or ""
        assert r["n_tokens"] == len(counter.encoding.encode_ordinary(text))
        for e in edits[r["doc_id"]]["edits"]:
            text = _edit(text, e["pos"], e["del"], e["ins"])
        assert r["n_tokens_after"] == len(counter.encoding.encode_ordinary(text))


def test_edit_table_and_defined_cases(spark, make_docs):
    docs = make_docs([(1, "a b c"), (2, None), (3, ""), (3, ""), (None, "x y"), (2**60 + 1, "one two")])
    edits = spark.createDataFrame([(1, 2, 0, 2, ""), (1, 1, 5, 0, " d e"), (2, 1, 0, 0, "new text"), (9, 1, 0, 0, "q"),
                                   (None, 1, 0, 0, "q"), (3, 1, 10, 10, None)],
                                  "doc_id long, seq long, pos long, del long, ins string")
    rows = tc.counts(tc.with_edits(docs, edits), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(((r["doc_id"] or 0), r["n_tokens"], r["n_tokens_after"]) for r in rows) == [
        (0, 2, 2), (1, 3, 4), (2, 0, 2), (3, 0, 0), (3, 0, 0), (2**60 + 1, 2, 2)]
    assert tc.counts(tc.with_edits(make_docs([]), edits), RANKS, public_tokenizers.PATTERN).collect() == []
