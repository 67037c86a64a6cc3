"""Spelling variants grouped under their common form (operator 11).

Two words are near when one inserted, deleted or replaced code point makes one
out of the other.

1. Words are counted over all texts, combined in each task; the vocabulary is
   written once.
2. A blocked Bloom filter is built for each word length (``LONGEST`` and more
   share one): the blocks' words are hashed in the tasks and each run of blocks
   is set in one group.  All filters together have ``BITS`` bits a word and
   ``MOST_BITS`` at most, which bounds the broadcast.  A fuller filter lets
   more through and never loses a word.
3. Every word's edits are probed against the filter of their length.  Being
   near is symmetric, so of a pair only one side has to find the other:
   deletions reach the shorter word, replacements by a larger letter the other
   one of equal length.  Hashes are XORs of one number for each place and
   letter, so an edit's hash follows from the word's.
4. Only positives are shuffled, to an exact join with the vocabulary that
   removes the false ones; both directions of the pairs are aggregated by word.
5. Roots by pointer doubling: counts grow tenfold along a chain, so a few
   rounds suffice.

A word has at most a few neighbours for each letter, so no key is hot.

Defined cases: null texts have no words; a null id is hashed as an empty one;
repeated rows count again; letters are ``[A-Za-z\\u00C0-\\u00FF]``, of which only
A-Z are lower-cased; runs of any length are words, and their edits are probed
piece by piece; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import arrow_rows, stored

LEAST_LENGTH, LEAST_COUNT, CUT_ONE_IN, FACTOR = 7, 2, 31, 10
#: lengths from here on share a filter; bits a word; bits of all filters; bits set for a word
LONGEST, BITS, MOST_BITS, PROBES = 64, 16, 1 << 29, 6
_BLOCK_BITS = 512
#: blocks that are set in one group; probes computed at a time; words counted before they are handed on
_RUN_OF_BLOCKS, _CHUNK, _COUNTED = 1024, 1 << 20, 500_000
#: words probed by one task
_PROBED = 50_000

# one byte a letter: Latin-1 holds them all, other characters become "?"
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(doc_id, text: str | None) -> Counter:
    """Words of a text, as Latin-1 bytes, and how often they occur."""
    runs = Counter(_RUN.findall((text or "").encode("latin-1", "replace").lower()))
    found = Counter(runs)
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % CUT_ONE_IN == 0:
            # its own occurrences only: words that other runs were cut to stay
            found[run] -= n
            if len(run) > LEAST_LENGTH:
                at = h % len(run)
                found[run[:at] + run[at + 1:]] += n
    return +found


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with at least ``LEAST_COUNT`` occurrences."""
    def work(batches):
        import pyarrow as pa

        def report(total):
            return pa.record_batch([pa.array([w.decode("latin-1") for w in total], pa.string()),
                                    pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        total = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                # a cut word may be a run elsewhere in the text: counts add up
                for word, n in words_of(doc_id, text).items():
                    total[word] += n
                if len(total) > _COUNTED:
                    yield report(total)
                    total = Counter()
        yield report(total)

    counts = arrow_rows(docs.select("doc_id", "text"), work, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- hashes and filters ----

def place_hash(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """A 64-bit number for each letter at each place."""
    x = (place.astype(np.uint64) * np.uint64(256) + letter.astype(np.uint64) + np.uint64(1)) * _SPREAD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_length(words: list[str]):
    """(indices, matrix of letters) for each length."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, at in groups.items():
        letters = "".join(words[i] for i in at).encode("latin-1")
        yield at, np.frombuffer(letters, np.uint8).reshape(len(at), length)


def word_hashes(letters: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(place_hash(np.arange(letters.shape[1]), letters), axis=1)


class Filters:
    """Blocked Bloom filters, one for each length, in one array."""

    def __init__(self, sizes: dict[int, int], most_bits: int = MOST_BITS):
        """``sizes``: words of each shard."""
        bits = BITS
        while True:
            self.power = {s: max(0, int(np.ceil(np.log2(max(1, n * bits / _BLOCK_BITS))))) for s, n in sizes.items()}
            if sum(1 << p for p in self.power.values()) * _BLOCK_BITS <= most_bits or bits < 1e-3:
                break
            bits /= 2
        self.first, total = {}, 0
        for s in sorted(self.power):
            self.first[s] = total
            total += 1 << self.power[s]
        self.blocks = total
        self.words = np.zeros(total * (_BLOCK_BITS // 64), np.uint64)

    def block(self, shard: int, h: np.ndarray) -> np.ndarray:
        p = self.power[shard]
        own = (h * _SPREAD) >> np.uint64(64 - p) if p else np.zeros(h.shape, np.uint64)
        return own + np.uint64(self.first[shard])

    @staticmethod
    def _bit(h: np.ndarray, k: int) -> np.ndarray:
        return (h >> np.uint64(9 * k)) & np.uint64(_BLOCK_BITS - 1)

    @classmethod
    def bits_of_run(cls, blocks: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The words of a run of blocks with all hashes set."""
        out = np.zeros(_RUN_OF_BLOCKS * (_BLOCK_BITS // 64), np.uint64)
        blocks = blocks % np.uint64(_RUN_OF_BLOCKS)
        for k in range(PROBES):
            bit = cls._bit(h, k)
            np.bitwise_or.at(out, (blocks * np.uint64(8) + (bit >> np.uint64(6))).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        return out

    def may_hold(self, shard: int, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that the shard's filter lets through.  Most
        fail at the first bits, so later ones are looked up for the rest only."""
        if shard not in self.power:
            return np.empty(0, np.int64)
        at = np.arange(len(h))
        base = self.block(shard, h) * np.uint64(8)
        for k in range(PROBES):
            bit = self._bit(h, k)
            word = self.words[(base + (bit >> np.uint64(6))).view(np.int64)]
            ok = np.flatnonzero((word >> (bit & np.uint64(63))) & np.uint64(1))
            at, h, base = at[ok], h[ok], base[ok]
        return at


def shard_of(length: int) -> int:
    return min(length, LONGEST)


def shard_letters(words: DataFrame) -> tuple[dict[int, int], dict[int, bytes]]:
    """Words and letters of each shard; at most 58 times 91 rows are collected."""
    def work(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        for b in batches:
            for at, letters in by_length(b.column("word").to_pylist()):
                s = shard_of(letters.shape[1])
                seen[s, 0] += len(at)
                for c in np.unique(letters).tolist():
                    seen[s, c] += 1
        yield pa.record_batch([pa.array([s for s, _ in seen], pa.int64()), pa.array([c for _, c in seen], pa.int64()),
                               pa.array(list(seen.values()), pa.int64())], names=["shard", "letter", "n"])

    rows = arrow_rows(words.select("word"), work, "shard long, letter long, n long")
    sizes, letters = {}, {}
    for r in rows.groupBy("shard", "letter").agg(F.sum("n").alias("n")).collect():
        if r["letter"]:
            letters.setdefault(r["shard"], []).append(r["letter"])
        else:
            sizes[r["shard"]] = r["n"]
    return sizes, {s: bytes(sorted(c)) for s, c in letters.items()}


def build_filters(words: DataFrame, sizes: dict[int, int]) -> Filters:
    filters = Filters(sizes)
    plan = Filters.__new__(Filters)  # the layout without the bits
    plan.power, plan.first = filters.power, filters.first

    def hashes(batches):
        import pyarrow as pa

        for b in batches:
            found = [(plan.block(shard_of(letters.shape[1]), h), h)
                     for _, letters in by_length(b.column("word").to_pylist()) for h in (word_hashes(letters),)]
            blocks = np.concatenate([x for x, _ in found] or [np.empty(0, np.uint64)])
            h = np.concatenate([y for _, y in found] or [np.empty(0, np.uint64)])
            yield pa.record_batch([pa.array((blocks // np.uint64(_RUN_OF_BLOCKS)).view(np.int64)), pa.array(blocks.view(np.int64)),
                                   pa.array(h.view(np.int64))], names=["run", "block", "hash"])

    def set_bits(key, group):
        import pyarrow as pa

        block, h = (group[c].to_numpy().astype(np.int64, copy=False).view(np.uint64) for c in ("block", "hash"))
        return pa.table({"run": [key[0].as_py()], "bits": pa.array([Filters.bits_of_run(block, h).tobytes()], pa.binary())})

    rows = arrow_rows(words.select("word"), hashes, "run long, block long, hash long")
    runs = rows.groupBy("run").applyInArrow(set_bits, "run long, bits binary")
    for r in runs.toLocalIterator():  # MOST_BITS in all
        at = r["run"] * _RUN_OF_BLOCKS * (_BLOCK_BITS // 64)
        bits = np.frombuffer(bytes(r["bits"]), np.uint64)
        filters.words[at:at + len(bits)] = bits[:len(filters.words) - at]
    return filters


def probe(letters: np.ndarray, filters: Filters, alphabet: bytes):
    """(row, near word as Latin-1 bytes) for all edits of the words (of one
    length) that the filters let through."""
    m, length = letters.shape
    shard = shard_of(length)
    chars = np.frombuffer(alphabet, np.uint8)
    rows_at_once = max(1, _CHUNK // (length * max(1, len(chars))))
    places_at_once = max(1, _CHUNK // max(1, len(chars)))
    for lo in range(0, m, rows_at_once):
        part = letters[lo:lo + rows_at_once]
        own = place_hash(np.arange(length), part)
        whole = np.bitwise_xor.reduce(own, axis=1)
        for p in range(0, length, places_at_once):
            here = part[:, p:p + places_at_once]
            other = place_hash(np.arange(p, p + here.shape[1])[:, None], chars[None, :])
            row, place, char = np.nonzero(here[:, :, None] < chars)  # the larger letter only
            h = (whole[:, None] ^ own[:, p:p + places_at_once])[row, place] ^ other[place, char]
            for k in filters.may_hold(shard, h).tolist():
                near = bytearray(part[row[k]].tobytes())
                near[p + place[k]] = chars[char[k]]
                yield lo + int(row[k]), bytes(near)
        if length > LEAST_LENGTH:
            moved = place_hash(np.arange(length) - 1, part)  # the first place is never used
            before = np.bitwise_xor.accumulate(own, axis=1) ^ own
            after = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1] ^ moved
            first = np.ones(part.shape, bool)  # of equal letters in a row only the first is deleted
            first[:, 1:] = part[:, 1:] != part[:, :-1]
            row, place = np.nonzero(first)
            for k in filters.may_hold(shard_of(length - 1), (before ^ after)[row, place]).tolist():
                word = part[row[k]].tobytes()
                yield lo + int(row[k]), word[:place[k]] + word[place[k] + 1:]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of near words, once.  ``words`` is a
    written table (word, n)."""
    spark = words.sparkSession
    sizes, letters = shard_letters(words)
    shared = spark.sparkContext.broadcast((build_filters(words, sizes), letters))  # MOST_BITS

    def work(batches):
        import pyarrow as pa

        filters, letters = shared.value
        for b in batches:
            words, n = b.column("word").to_pylist(), b.column("n").to_numpy()
            for at, matrix in by_length(words):
                row, near = [], []
                for r, w in probe(matrix, filters, letters[shard_of(matrix.shape[1])]):
                    row.append(at[r])
                    near.append(w.decode("latin-1"))
                yield pa.record_batch([pa.array([words[i] for i in row], pa.string()), pa.array(n[row] if row else [], pa.int64()),
                                       pa.array(near, pa.string())], names=["word", "n", "near"])

    # a word means hundreds of probes: the tasks are cut by words, not by bytes
    dealt = words.repartition(max(1, -(-sum(sizes.values()) // _PROBED)))
    positives = arrow_rows(dealt, work, "word string, n long, near string")
    return positives.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over (word, form)."""
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        nxt = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        links = stored(links.join(nxt, "root", "left").select(
            "word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")), "spelling-roots")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = stored(vocabulary(docs), "vocabulary")
    pairs = near_words(words)
    sides = F.array(F.struct("word", "near", "near_n"),
                    F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    by_word = (pairs.select(F.explode(sides).alias("_s")).select("_s.*").groupBy("word")
               .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best")))
    common = -F.col("_best.less") >= FACTOR * F.col("n")
    rows = stored(words.join(by_word, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(common, F.col("_best.near")).alias("form"), F.when(common, -F.col("_best.less")).alias("form_n")), "spelling")
    found = roots(rows.where("form IS NOT NULL"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _sql_crc32(hexed: str) -> str:
    """crc32 of bytes written in hex, four bits at a time."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    nibbles = (f"list_transform(range(0, length({hexed})), lambda i: "
               f"(strpos('0123456789ABCDEF', substr({hexed}, (CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END)::INT, 1)) - 1)::BIGINT)")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {nibbles}), "
            f"lambda c, x: xor(c >> 4, ({table}::BIGINT[])[((xor(c, x)) & 15) + 1])), 4294967295::BIGINT)")


SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, c, {_sql_crc32("x")} AS h FROM (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs)),
cut AS (SELECT c, CASE WHEN h % {CUT_ONE_IN} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                  ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
p AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
      FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
replaced AS (SELECT x.word, y.word AS near, y.n AS near_n FROM p x JOIN p y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word),
deleted AS (SELECT DISTINCT p.word, p.n, v.word AS near, v.n AS near_n FROM p JOIN v ON v.word = p.a || p.b),
pairs AS (SELECT word, near, near_n FROM replaced UNION ALL SELECT word, near, near_n FROM deleted
          UNION ALL SELECT near, word, n FROM deleted),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FACTOR} * n THEN near END AS form,
             CASE WHEN near_n >= {FACTOR} * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
r(word, root, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, z.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM r GROUP BY word) z ON z.word = f.word
"""
