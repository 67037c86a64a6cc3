"""Substring deduplication by content-defined chunks (operator 1).

A gear hash rolls over the UTF-8 bytes of each text; where it falls below a
threshold a chunk may end, so chunk borders depend on the 32 bytes before them
and an insertion moves only the chunks around it.  Chunks are compared by
digest and length over all documents.  Consecutive chunks that occur again
somewhere make a span; the first occurrence (least document, then position)
stays and the others can be cut.

The chunk lists are written once.  Occurrences are combined before the
shuffle, so a passage in a third of all documents costs one row per task and
chunk; the join back is an equi-join on the digest that adaptive execution can
split.  A document's spans are built from its own chunks only.

Defined cases: null and empty texts have no chunks; repeated rows and equal
texts repeat each other; a passage repeated inside one document counts too;
rows with null ids come last when the first occurrence is chosen; an empty
table gives no spans; other columns are ignored by ``spans`` and kept by
``dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from recspark.llm.common import arrow_rows, stored
from recspark.session import configure

#: bytes: least and largest chunk, mean distance of possible ends, least span
LEAST, LARGEST, DISTANCE = 16, 128, 24
SPAN_BYTES = 64
_WINDOW = 32

_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of ``gear[byte] << age`` over the
    last 32 bytes, by doubling the window."""
    h = _GEAR[raw]
    width = 1
    while width < _WINDOW:
        moved = h.copy()
        moved[width:] += h[:-width] << np.uint32(width)
        h, width = moved, 2 * width
    return h


def chunk_ends(raw: bytes) -> list[int]:
    """End offsets of the chunks of a text, between characters."""
    b = np.frombuffer(raw, np.uint8)
    possible = np.flatnonzero(gear(b) < np.uint32(2 ** 32 // DISTANCE)) + 1
    # an end inside a character moves behind it
    nxt = np.append(b, 0)
    while len(inside := np.flatnonzero(nxt[possible] & 0xC0 == 0x80)):
        possible[inside] += 1
    out, last, size = [], 0, len(raw)
    for end in [*possible.tolist(), size]:
        while end - last > LARGEST:
            cut = last + LARGEST
            while cut < size and raw[cut] & 0xC0 == 0x80:
                cut += 1
            if cut >= end:
                break
            out.append(cut)
            last = cut
        if end - last >= LEAST or (end == size and end > last):
            out.append(end)
            last = end
    return out


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(row, doc_id, ends, digests), written once."""
    def work(batches):
        import pyarrow as pa

        for b in batches:
            ends, digests = [], []
            for text in b.column("text").to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                e = chunk_ends(raw) if raw else []
                ends.append(e)
                digests.append(np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip([0, *e], e)], np.uint64).view(np.int64))
            at = pa.array(np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32))
            yield pa.record_batch([
                b.column("doc_id"),
                pa.ListArray.from_arrays(at, pa.array([x for e in ends for x in e], pa.int64())),
                pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.empty(0, np.int64), *digests])))],
                names=["doc_id", "ends", "digests"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ends", T.ArrayType(T.LongType())),
                           T.StructField("digests", T.ArrayType(T.LongType()))])
    rows = arrow_rows(docs.select("doc_id", "text"), work, schema)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "chunks")


def spans(docs: DataFrame) -> DataFrame:
    """Spans of repeated text: row, doc_id, start_byte, end_byte, n_chunks,
    cut_bytes (bytes whose first occurrence is elsewhere), cuts (their byte
    ranges), first_doc_ids (documents that hold the first occurrences)."""
    lists = chunk_lists(docs)
    chunks = lists.select("row", "doc_id", "ends", F.posexplode("digests").alias("i", "digest"))
    start = F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0).cast("bigint"))
    chunks = chunks.select("row", "doc_id", "i", "digest", start.alias("start"), F.get("ends", F.col("i")).alias("end"))
    size = (F.col("end") - F.col("start")).alias("size")
    # null ids last; the row number makes the order total
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "start")
    again = (chunks.select("digest", size, place.alias("p")).groupBy("digest", "size")
             .agg(F.min("p").alias("p"), F.count("*").alias("n")).where("n > 1")
             .select("digest", "size", F.col("p.row").alias("first_row"), F.col("p.doc_id").alias("first_doc"),
                     F.col("p.start").alias("first_start")))
    hit = chunks.withColumn("size", size).join(again, ["digest", "size"])
    first = (F.col("row") == F.col("first_row")) & (F.col("start") == F.col("first_start"))
    hit = hit.withColumn("cut", ~first)
    # chunks with consecutive numbers make a span
    by_doc = Window.partitionBy("row").orderBy("i")
    hit = hit.withColumn("span", F.col("i") - F.row_number().over(by_doc))
    cut_range = F.when(F.col("cut"), F.struct("start", "end"))
    out = hit.groupBy("row", "span").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start_byte"), F.max("end").alias("end_byte"),
        F.count("*").alias("n_chunks"), F.sum(F.when(F.col("cut"), F.col("size")).otherwise(0)).alias("cut_bytes"),
        F.sort_array(F.collect_list(cut_range)).alias("cuts"),
        F.sort_array(F.collect_set("first_doc")).alias("first_doc_ids"))
    return out.where(F.col("end_byte") - F.col("start_byte") >= SPAN_BYTES).drop("span")


def repeated(docs: DataFrame) -> DataFrame:
    """One row per span, for every document that holds repeated text."""
    return spans(docs).select("doc_id", "start_byte", "end_byte", "n_chunks", "cut_bytes", "first_doc_ids")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated span cut from the texts but the first."""
    configure(docs.sparkSession)
    cols = docs.columns
    # written once, so that a document and its spans meet by the row number; the
    # row is kept in a struct, so that no column of its own can be overwritten
    whole = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc"),
                               F.monotonically_increasing_id().alias("_row")), "dedup-docs")
    key = F.struct(F.col("doc.doc_id").isNull().alias("z"), F.col("doc.doc_id").alias("doc_id"), "_row")
    found = spans(whole.select(key.alias("doc_id"), F.col("doc.text").alias("text")))
    cuts = (found.where("cut_bytes > 0").groupBy(F.col("doc_id._row").alias("_r"))
            .agg(F.sort_array(F.flatten(F.collect_list("cuts"))).alias("_cuts")))

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(text, ranges):
            if text is None or ranges is None:
                return text
            raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
            for r in ranges:
                out.append(raw[at:r["start"]])
                at = r["end"]
            return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
        return pd.Series([one(t, r) for t, r in zip(texts, cuts)], dtype=object)

    out = whole.join(cuts, F.col("_row") == F.col("_r"), "left").select(
        "doc", without("doc.text", "_cuts").alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in cols:
        new["n_chars"] = F.char_length("_text").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in cols])
