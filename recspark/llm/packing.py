"""Cost-balanced packing (operator 2).

Texts become ids of a public tokenizer plus an end id.  A document's full
sequences of ``SEQUENCE`` tokens stand alone; what is left over goes, by a hash
of the document, to a group of about ``GROUP_SEQUENCES`` sequences.  In a group
the number of sequences is the least possible; the leftovers, largest first, go
to the sequence of lowest cost (linear plus quadratic in each piece's length,
as attention does not cross documents) with room for them.  One that fits
nowhere is cut: a part fills the roomiest sequence, the rest is placed in its
turn.  So only the last sequence of a group is padded.

Groups are made by the number of bytes of all texts and of rows, hold a bounded number of
tokens and are independent of each other; their ids are shuffled once, full
sequences send only their checksum.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed as documents of their own; an empty table gives no pieces; columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.llm.common import arrow_rows, give_back, lean
from recspark.llm.wordbpe import encoder

SEQUENCE = 4096
END_ID = 2
GROUP_SEQUENCES = 256
#: bytes of text per token used to size the groups; only their number hangs on it
BYTES_PER_TOKEN = 2.5
#: cost of a piece: length + QUADRATIC * length ** 2
QUADRATIC = 1 / 2048
#: texts are split into pieces about so many characters at a time
SLICE = 1 << 22

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(length: float) -> float:
    return length + QUADRATIC * length * length


def assign(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with
    fewer than ``size`` tokens each, given in descending order."""
    n = -(-sum(lengths) // size)
    costs, free = np.zeros(n), np.full(n, size)
    waiting = [(-length, k, 0) for k, length in enumerate(lengths)]
    heapq.heapify(waiting)
    out = []
    while waiting:
        length, k, start = heapq.heappop(waiting)
        length = -length
        fits = np.flatnonzero(free >= length)
        s = int(fits[np.argmin(costs[fits])]) if len(fits) else int(np.argmax(free))
        part = min(length, int(free[s]))
        out.append((k, start, part, s, size - int(free[s])))
        free[s] -= part
        costs[s] += cost(part)
        if part < length:
            heapq.heappush(waiting, (part - length, k, start + part))
    return out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def slices(texts):
    """The texts of an Arrow column as lists of about ``SLICE`` characters; a
    longer text is a list of its own."""
    part, size = [], 0
    for text in texts:
        text = text.as_py()
        if part and size + len(text or "") > SLICE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def token_rows(docs: DataFrame, tokenizer_path: str, groups: int, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, grp, n, full: checksums of full sequences, rest: ids as bytes)."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # one vocabulary file

    def work(batches):
        import pyarrow as pa

        enc = encoder(shared.value)
        for b in batches:
            n, full, rest = [], [], []
            for ids in (ids for texts in slices(b.column("text")) for ids in enc.ids(texts)):
                ids = np.append(ids, np.array([END_ID], enc.dtype))
                whole = len(ids) // size
                n.append(len(ids))
                full.append([crc(ids[i * size:(i + 1) * size]) for i in range(whole)])
                rest.append(ids[whole * size:].tobytes())
            yield pa.record_batch([b.column("doc_id"), b.column("grp"), pa.array(n, pa.int64()),
                                   pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary())],
                                  names=["doc_id", "grp", "n", "full", "rest"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("grp", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("full", T.ArrayType(T.LongType())), T.StructField("rest", T.BinaryType())])
    rows = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("grp"), "text")
    return arrow_rows(rows, lean(work), schema)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    # each row has an end id, whatever its text
    groups = max(1, round((total["b"] / BYTES_PER_TOKEN + total["n"]) / (size * GROUP_SEQUENCES)))
    rows = token_rows(docs, tokenizer_path, groups, size)

    def place(key, group):
        import pyarrow as pa

        ids, n, full, rest = (group.column(c).to_pylist() for c in ("doc_id", "n", "full", "rest"))
        grp = key[0].as_py()
        narrow = all(len(r) == 2 * (k % size) for r, k in zip(rest, n))
        order = sorted(range(len(n)), key=lambda i: (-len(rest[i]), _key(ids[i]), rest[i]))
        rest = [np.frombuffer(r, "<u2" if narrow else "<u4") for r in rest]
        made = [(ids[i], k * size, size, checksum, n[i], i, k) for i in order for k, checksum in enumerate(full[i])]
        made = [(*m[:5], s, 0) for s, m in enumerate(made)]
        first = len(made)
        todo = [i for i in order if len(rest[i])]
        for k, start, length, s, offset in assign([len(rest[i]) for i in todo], size):
            i = todo[k]
            made.append((ids[i], n[i] - len(rest[i]) + start, length, crc(rest[i][start:start + length]), n[i],
                         first + s, offset))
        doc, start, length, checksum, tokens, seq, offset = zip(*made)
        seq = [(grp << 32) + s for s in seq]
        cols = [pa.array(doc, group.schema.field("doc_id").type)]
        cols += [pa.array(c, pa.int64()) for c in (start, length, checksum, tokens, seq, offset)]
        give_back()
        return pa.table(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}"
    return rows.groupBy("grp").applyInArrow(place, schema)


def _key(doc_id):
    return (1, 0) if doc_id is None else (0, doc_id)
