"""Edit-aware token counts (operator 5).

A text is cut into pre-token segments (white space and the word after it),
where the tokenizer's own pattern never joins two of them, so the number of
tokens is a sum over segments.  Blocks of segments are the leaves of a binary
tree of sums of characters and tokens.  An edit finds its blocks by descending
the tree, re-encodes them together with the neighbours its ends may have merged
with, and updates the sums on the path to the root.

Texts are independent: no shuffle when the edits come with the documents;
edits in a table of their own are gathered by document first.  Memory per task
is one text and a bounded table of known segments.

Defined cases: a null or empty text has no tokens and can be edited like the
empty text; edits apply in order, positions and lengths are clipped to the
text as it then is; no edits leave the counts as they are; repeated rows each
get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.llm.common import arrow_rows

#: segments in a leaf, and in a leaf that makes the tree be built anew
LEAF, LEAF_MOST = 64, 1024
_KNOWN = 400_000
# Unicode white space, as the tokenizer's pattern has it
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_IS_SPACE = re.compile(f"[{_SPACE}]")

EDITS = "array<struct<pos:bigint,del:bigint,ins:string>>"


class Counter:
    """Tokens of segments; ``ranks`` is a file of base64 tokens and ranks."""

    def __init__(self, ranks: str, pattern: str):
        import base64

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, segments: list[str]) -> int:
        known = self.known
        for s in set(segments).difference(known):
            known[s] = len(self.encoding.encode_ordinary(s))
        n = sum(map(known.__getitem__, segments))
        if len(known) > _KNOWN:
            known.clear()
        return n


class SegmentTree:
    def __init__(self, text: str, counter: Counter):
        self.counter, self.reencoded = counter, 0
        self._build(text)

    def _build(self, text: str) -> None:
        seg = _SEGMENT.findall(text)
        self.n_segments = len(seg)
        self.blocks = ["".join(seg[i:i + LEAF]) for i in range(0, len(seg), LEAF)] or [""]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, b in enumerate(self.blocks):
            self.chars[self.size + i] = len(b)
            self.tokens[self.size + i] = self.counter.count(seg[i * LEAF:(i + 1) * LEAF])
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.blocks)

    def _find(self, pos: int) -> tuple[int, int]:
        """(block, offset in it) of a character position."""
        i = 1
        while i < self.size:
            i *= 2
            if pos > self.chars[i]:
                pos -= self.chars[i]
                i += 1
        return min(i - self.size, len(self.blocks) - 1), pos

    def _set(self, block: int, text: str, tokens: int) -> None:
        self.blocks[block] = text
        i = self.size + block
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, pos: int, delete: int, insert: str) -> None:
        total = self.chars[1]
        pos = min(max(pos or 0, 0), total)
        delete = min(max(delete or 0, 0), total - pos)
        lo, a = self._find(pos)
        hi, b = self._find(pos + delete)
        new = self.blocks[lo][:a] + (insert or "") + self.blocks[hi][b:]
        # a block begins with white space unless it is the first, and ends without; where the edit
        # broke that, the neighbour belongs to the same segment
        while lo > 0 and new and not _IS_SPACE.match(new[0]):
            lo -= 1
            new = self.blocks[lo] + new
        while hi < len(self.blocks) - 1 and new and _IS_SPACE.match(new[-1]):
            hi += 1
            new += self.blocks[hi]
        seg = _SEGMENT.findall(new)
        self.reencoded += len(seg)
        self._set(lo, new, self.counter.count(seg))
        for i in range(lo + 1, hi + 1):
            if self.blocks[i]:
                self._set(i, "", 0)
        if len(seg) > LEAF_MOST:
            self._build(self.text())


_OPEN: dict[int, Counter] = {}


def _counter(ranks: str, pattern: str) -> Counter:
    """The worker's counter for a vocabulary; it outlives a task."""
    key = zlib.crc32((pattern + ranks).encode())
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Counter(ranks, pattern)
    return _OPEN[key]


def counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_segments, n_reencoded) for
    documents with ``doc_id, text, edits`` (``EDITS``)."""
    with open(ranks_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))  # one vocabulary file

    def work(batches):
        import pyarrow as pa

        counter = _counter(*shared.value)
        for b in batches:
            out = []
            for text, edits in zip(b.column("text").to_pylist(), b.column("edits").to_pylist()):
                tree = SegmentTree(text or "", counter)
                before, segments = tree.n_tokens, tree.n_segments
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["pos"], e["del"], e["ins"])
                out.append((before, tree.n_tokens, segments, tree.reencoded))
            cols = zip(*out) if out else ([], [], [], [])
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)],
                                  names=["doc_id", "n_tokens", "n_tokens_after", "n_segments", "n_reencoded"])

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in
                                                    ("n_tokens", "n_tokens_after", "n_segments", "n_reencoded")]])
    return arrow_rows(docs.select("doc_id", "text", F.col("edits").cast(EDITS)), work, schema)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents with the edits of a table (doc_id, seq, pos, del, ins), in the
    order of ``seq``; a null id matches no edit."""
    per = edits.groupBy(F.col("doc_id").alias("_d")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "pos", "del", "ins"))).alias("edits"))
    out = docs.join(per, F.col("doc_id") == F.col("_d"), "left").drop("_d")
    return out.withColumn("edits", F.transform("edits", lambda e: F.struct(e["pos"], e["del"], e["ins"])))


def revision_edits(docs: DataFrame) -> DataFrame:
    """Documents with edits that Spark derives from each text: the middle tenth
    goes, the first 30 characters are put after the first third, the last
    character is replaced by a line break and a word, and two letters are
    joined over a blank near the end."""
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("bigint")
    third, mid = F.floor(n / 3), F.floor(n * 45 / 100)
    edit = lambda pos, cut, ins: F.struct(pos.alias("pos"), cut.alias("del"), ins.alias("ins"))
    zero = F.lit(0).cast("bigint")
    return docs.withColumn("edits", F.array(
        edit(mid, F.floor(n / 10), F.lit("")),
        edit(third, zero, F.substring(F.coalesce("text", F.lit("")), 1, 30)),
        edit(n - F.floor(n / 10) + 29, F.lit(1).cast("bigint"), F.lit("\nrevised")),
        edit(F.floor(n * 4 / 5), F.lit(1).cast("bigint"), F.lit(""))))
