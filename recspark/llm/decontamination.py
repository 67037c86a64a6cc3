"""Benchmark decontamination (operator 10, DataFrame functions only).

The benchmark's normalised 13-word windows form a hash set that is broadcast
when its counted size allows it.  Documents are then scanned once.  Each window
of the set has an anchor, its longest word; only document windows that hold an
anchor at the right place are spelled out and looked up in the set (equality of
the whole window, so a hit is verified by the join itself).

A larger set is joined by shuffle with the same result: one narrow row per
document window (its place and 64-bit hash, no words) meets the hashed set, and
the places found are verified word by word against the document.  Rows grow
with the words of a text, times the distinct window lengths (13 at most).

Defined cases: a null or wordless text has no words and is not contaminated; a
null or wordless item gives no window; an item of 1 to 12 words is one window;
null item ids are not counted; repeated documents each give a row, repeated
items count once; empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import ascii_lower, small, stored

WINDOW = 13
#: contaminated: 100 * hit words >= MIN_HIT_PCT * words
MIN_HIT_PCT = 5
#: largest set that is broadcast; windows are about 100 bytes each
BROADCAST_WINDOWS = 500_000
#: most documents with hits that are broadcast to the texts
BROADCAST_DOCS = 200_000

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATOR, -1), "")


def window_set(benchmark: DataFrame) -> DataFrame:
    """(item_id, gram, len, word, off): every window with its anchor word and
    the anchor's place in the window."""
    w = benchmark.select("item_id", item_words(F.col("text")).alias("_w")).withColumn("_n", F.size("_w"))
    w = w.where(F.col("_n") > 0).withColumn("len", F.least(F.lit(WINDOW), F.col("_n")))
    w = w.withColumn("_i", F.explode(F.expr("sequence(1, _n - len + 1)")))
    w = w.withColumn("_g", F.expr("slice(_w, _i, len)"))
    w = w.withColumn("_a", F.array_max(F.transform("_g", lambda x, i: F.struct(
        F.octet_length(x).alias("l"), (-i).alias("o"), x.alias("x")))))
    return w.select("item_id", F.array_join("_g", " ").alias("gram"), "len",
                    F.col("_a")["x"].alias("word"), (-F.col("_a")["o"]).alias("off")).distinct()


def scan(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """One pass over ``docs`` (doc_id, text): per document a row with
    ``gram`` = '' that carries the number of words, and a row per window of
    the set at each place it occurs: (doc_id, _th, n_words, start, len, gram)."""
    spark = docs.sparkSession
    none = spark.range(1).select(F.lit("").alias("gram"), F.lit(0).alias("len"), F.lit("").alias("word"),
                                 F.lit(0).alias("off"))
    grams = windows.select("gram", "len", "word", "off").distinct().unionByName(none)
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), item_words(F.col("text")).alias("_w"))
    if grams.count() > BROADCAST_WINDOWS:
        return _scan_large(rows, grams.where("len > 0"))
    anchors = grams.select(F.col("word").alias("_word"), F.col("off").alias("_off"), F.col("len").alias("_len")).distinct()
    known = grams.select(F.col("gram").alias("_gram"), F.col("off").alias("_goff"))
    # the word list starts with '' so that every document gives its own row
    rows = rows.withColumn("_w", F.concat(F.array(F.lit("")), F.col("_w")))
    rows = rows.select("doc_id", "_th", "_w", F.posexplode("_w").alias("_p", "_x"))
    rows = rows.join(F.broadcast(anchors), F.col("_x") == F.col("_word"))
    rows = rows.withColumn("start", F.col("_p") - F.col("_off"))
    rows = rows.where((F.col("_len") == 0) | ((F.col("start") >= 1) & (F.col("start") + F.col("_len") <= F.size("_w"))))
    rows = rows.withColumn("gram", F.when(F.col("_len") == 0, F.lit("")).otherwise(
        F.array_join(F.slice("_w", F.greatest(F.col("start") + 1, F.lit(1)), F.col("_len")), " ")))
    rows = rows.withColumn("n_words", F.size("_w") - 1)
    rows = rows.join(F.broadcast(known), (F.col("gram") == F.col("_gram")) & (F.col("_off") == F.col("_goff")))
    return rows.select("doc_id", "_th", "n_words", "start", F.col("_len").alias("len"), "gram")


def _window(start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice("_w", start, length), " ")


def window_rows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, _th, start, len, _h): every window of the given lengths."""
    def of(n):
        return F.when(F.size("_w") >= n, F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("_w") - (n - 1), F.lit(1))),
            lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), F.xxhash64(_window(i, n)).alias("_h"))))
    none = F.array().cast("array<struct<start:int,len:int,_h:bigint>>")
    at = F.concat(none, *[F.coalesce(of(n), none) for n in lengths])
    return rows.select("doc_id", "_th", F.inline(at))


def _scan_large(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """``scan`` for a set beyond the broadcast bound; ``rows``: doc_id, _th, _w."""
    grams = stored(grams.select("gram", "len").distinct(), "windows")
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # 13 values at most
    keys = grams.select(F.xxhash64("gram").alias("_h"), "len").distinct()
    met = window_rows(rows, lengths).join(keys, ["_h", "len"])
    # a document's places are bounded by its words
    met = met.groupBy(F.col("doc_id").alias("_d"), F.col("_th").alias("_t")).agg(
        F.collect_set(F.struct("start", "len")).alias("_at"))
    met = small(stored(met, "window-places"), BROADCAST_DOCS)
    hit = rows.join(met, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")))
    hit = hit.select("doc_id", "_th", F.size("_w").alias("n_words"), F.inline(F.transform(
        "_at", lambda a: F.struct(a["start"].alias("start"), a["len"].alias("len"),
                                  _window(a["start"], a["len"]).alias("gram")))))
    hit = hit.join(grams, ["gram", "len"], "left_semi")
    own = rows.select("doc_id", "_th", F.size("_w").alias("n_words"), F.lit(0).alias("start"), F.lit(0).alias("len"),
                      F.lit("").alias("gram"))
    return own.unionByName(hit.select(*own.columns))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text): n_words, hits (sorted structs
    start, len; start counts words from 1), items (sorted strings), n_rows."""
    windows = window_set(benchmark)
    items = (windows.groupBy("gram").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("_items")))
    found = stored(scan(docs, windows), "window-hits")  # the texts are scanned once
    hit = F.col("gram") != ""
    # at most one row per place and window, so a document's list is bounded by its words
    per = found.groupBy("doc_id", "_th").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(~hit, 1)).alias("n_rows"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("start", "len")))).alias("hits"),
        F.collect_set(F.when(hit, F.col("gram"))).alias("_grams"))
    listed = (per.where(F.size("_grams") > 0).select("doc_id", "_th", F.explode("_grams").alias("gram"))
              .join(items, "gram").select("doc_id", "_th", F.explode("_items").alias("_item")).distinct()
              .groupBy("doc_id", "_th").agg(F.sort_array(F.collect_list("_item")).alias("items"))
              .select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), "items"))
    out = per.drop("_grams").join(
        listed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).drop("_d", "_t")


def _hit_words(hits: str) -> Column:
    """Words under the union of the (start, len) intervals, sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(F.col(hits), zero, lambda acc, h: F.struct(
        F.greatest(acc["end"], h["start"] + h["len"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), h["start"] + h["len"] - F.greatest(acc["end"], h["start"]))).alias("n")),
        lambda acc: acc["n"].cast("bigint"))


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = find(docs.select("doc_id", "text"), benchmark).withColumn("n_hit", _hit_words("hits"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0)
                          & (100 * F.col("n_hit") >= MIN_HIT_PCT * F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    out = judged(docs, benchmark).withColumn("_r", F.explode(F.expr("array_repeat(1, cast(n_rows as int))")))
    return out.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), "n_hit",
                      F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; from the others the hit words
    are cut, with what stands between them and the next word."""
    cols = docs.columns
    bad = judged(docs, benchmark).where(F.col("n_hit") > 0).select(
        F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), F.col("hits").alias("_hits"),
        F.col("contaminated").alias("_bad"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col("doc_id").alias("_id"),
                       F.xxhash64("text").alias("_th"))
    bad = small(stored(bad, "hit-documents"), BROADCAST_DOCS)
    out = rows.join(bad, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    out = out.where(~F.coalesce("_bad", F.lit(False)))
    text = F.col("_row")["text"]
    # head before the first word, then each word with what follows it
    unit = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    head = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    out = out.withColumn("_text", F.when(F.col("_hits").isNull(), text).otherwise(F.concat(head, F.array_join(
        F.filter(F.regexp_extract_all(text, F.lit(unit), F.lit(0)),
                 lambda u, i: ~F.exists("_hits", lambda h: (h["start"] <= i + 1) & (i + 1 < h["start"] + h["len"]))),
        ""))))
    new = {"text": F.col("_text")}
    if "n_chars" in cols:
        new["n_chars"] = F.char_length("_text").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in cols])


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
b AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, list_slice(ws, i, i + least(len(ws), 13) - 1) AS g
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM b),
dg AS (SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 1, 0) + 1)) AS i FROM dw, lens)),
hit AS (SELECT doc_id, item_id, i, b.n FROM dg JOIN b ON dg.n = b.n AND dg.g = b.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
