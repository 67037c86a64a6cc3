"""Cross-document line frequency (operator 6, DataFrame functions only).

Base rules look at one text: words, symbols, repeated lines, words inside
repeated 8-word windows.  The corpus rule hashes normalised lines, counts per
host the distinct texts that carry a line, removes lines above the limit from
every document but the first that has it, and rejects documents of which too
little is left.

Defined cases: a null text has no words and fails the base rules; an empty
table gives an empty result; repeated rows each get the same verdict; rows
with a null ``doc_id`` or ``source`` are treated like any other value.  Exact
copies of a text count once for a line, so copies of a good document do not
turn its lines into boilerplate.  Extra columns of the input are ignored by
``line_rules`` and kept by ``quality_filter``.

The limit of ``line_rules`` is the SQL's ``MAX_DOCS_PER_HOST`` at every host
size.  ``quality_filter`` takes it as the floor of a share of the host's
distinct texts, and words of very short lines do not count as taken from a
document when it is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.llm.common import SPACE_RE, small, space_words, stored

MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
MAX_DOCS_PER_HOST = 20
#: quality_filter: a line is above the limit in more than this share of its host's texts (MAX_DOCS_PER_HOST at least)
MAX_SHARE_PCT = 4
#: quality_filter: lines of fewer words are cut but do not speak for a document's depletion
SPEAKING_WORDS = 3
MIN_LEFT_PCT = 30
MIN_LEFT_WORDS = 10
#: most documents with removed lines that are broadcast to the texts
BROADCAST_DOCS = 200_000

_HAS_WORD = r"[^\x20\x09-\x0D]"


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed``.  One row of work: no shuffle, no Python."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_w", space_words(F.col(text)))
    out = out.withColumns({
        "n_words": F.size("_w").cast("bigint"),
        "_wh": F.transform("_w", lambda w: F.xxhash64(w)),
        "word_chars": F.char_length(F.regexp_replace(t, SPACE_RE, "")).cast("bigint"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "_ln": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(_HAS_WORD)),
    })
    out = out.withColumns({
        "n_dup_lines": (F.size("_ln") - F.size(F.array_distinct("_ln"))).cast("bigint"),
        "_win": F.when(F.col("n_words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
            lambda i: F.xxhash64(*[F.get("_wh", i + k) for k in range(WINDOW)]))),
    })
    out = out.withColumn("_dup", F.size(F.array_distinct("_win")) < F.size("_win"))
    # only texts with a repeated window are sorted
    out = out.withColumn("_s", F.when(F.col("_dup"), F.sort_array(
        F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda k, j: F.get("_s", k)["h"] == F.get("_s", j)["h"]
    out = out.withColumn("_pos", F.when(F.col("_dup"), F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_s") - 1),
                 lambda k: ((k > 0) & same(k, F.greatest(k - 1, F.lit(0))))
                 | F.coalesce(same(k, k + 1), F.lit(False))),
        lambda k: F.get("_s", k)["i"]))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_dup"), F.aggregate(
        F.sequence(F.lit(0), F.size("_pos") - 1), F.lit(0).cast("bigint"),
        lambda acc, k: acc + F.least(F.lit(WINDOW), F.coalesce(F.get("_pos", k + 1) - F.get("_pos", k), F.lit(WINDOW)))
    )), F.lit(0)).cast("bigint"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    return out.drop("_w", "_wh", "_ln", "_win", "_dup", "_s", "_pos")


def normalised_line(line: Column) -> Column:
    """Case, white space and digits do not tell lines apart."""
    squeezed = F.btrim(F.regexp_replace(line, SPACE_RE, " "), F.lit(" "))
    return F.regexp_replace(F.lower(squeezed), "[0-9]", "0")


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, share_pct: int = 0,
                   least_words: int = 0) -> DataFrame:
    """Lines of each document that are above the limit for its host:
    (doc_id, source, _th, removed_words, removed_lines).

    A line is a (host, hash) key.  Texts are counted, not rows: the first
    aggregate makes one row per (key, text), combined before the shuffle, so a
    line that every document of a hot host carries is spread over its texts.
    The document with the smallest id keeps the line.  With ``share_pct`` the
    limit is that share of the host's distinct texts, ``max_docs`` at least;
    lines of fewer than ``least_words`` words add nothing to removed_words."""
    lines = docs.select("doc_id", "source", F.xxhash64("text").alias("_th"),
                        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("_i", "_line"))
    lines = lines.where(F.col("_line").rlike(_HAS_WORD))
    lines = lines.select("doc_id", "source", "_th", "_i",
                         F.xxhash64("source", normalised_line(F.col("_line"))).alias("_lh"),
                         F.size(space_words(F.col("_line"))).alias("_n"))
    host = [F.first("source").alias("source")] if share_pct else []
    counted = lines.groupBy("_lh", "_th").agg(F.min("doc_id").alias("_first"), *host)
    above = (counted.groupBy("_lh").agg(F.count("*").alias("_docs"), F.min("_first").alias("_first"), *host)
             .where(F.col("_docs") > max_docs))
    if share_pct:
        texts = docs.where(F.col("text").isNotNull()).select(F.col("source").alias("_s"), F.xxhash64("text").alias("_th"))
        hosts = texts.distinct().groupBy("_s").agg(F.count("*").alias("_texts"))
        # only hosts whose share is above the floor
        hosts = small(hosts.where(share_pct * F.col("_texts") > 100 * max_docs))
        above = above.join(hosts, F.col("source").eqNullSafe(F.col("_s")), "left").where(
            F.col("_texts").isNull() | (100 * F.col("_docs") > share_pct * F.col("_texts")))
    above = above.select("_lh", "_first")
    hit = lines.join(above, "_lh").where(~F.col("doc_id").eqNullSafe(F.col("_first")))
    words = F.when(F.col("_n") >= least_words, F.col("_n")).otherwise(0) if least_words else F.col("_n")
    # repeated rows give each (document, line number) once
    return (hit.groupBy("doc_id", "source", "_th", "_i").agg(F.first("_n").alias("_n"))
            .groupBy("doc_id", "source", "_th")
            .agg(F.sum(words).alias("removed_words"), F.collect_set("_i").alias("removed_lines")))


def _verdict(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Joins the removed lines to ``rows`` (with ``_th``) and adds ``kept``."""
    cut = cut.select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_h"), F.col("_th").alias("_t"),
        F.col("removed_words").alias("_rw"), F.col("removed_lines").alias("_rl"))
    on = (F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_h"))
          & F.col("_th").eqNullSafe(F.col("_t")))
    left = F.col("n_words") - F.coalesce(F.col("_rw"), F.lit(0))
    depleted = F.col("_rw").isNotNull() & (
        (left < MIN_LEFT_WORDS) | (100 * left < MIN_LEFT_PCT * F.col("n_words")))
    # one sum, not a conjunction: a filter on base_failed alone would be pushed below the metrics
    # and spell their expressions out once more for each use
    failed = F.col("base_failed").cast("int") + F.coalesce(depleted.cast("int"), F.lit(0))
    return (rows.join(cut, on, "left").withColumn("_kept", failed == 0)
            .withColumn("_left", left).drop("_d", "_h", "_t", "_rw"))


def line_rules(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """One row per document: the base metrics, ``n_removed_lines``, ``kept``."""
    docs = docs.select("doc_id", "source", "text")
    rows = base_metrics(docs.withColumn("_th", F.xxhash64("text"))).drop("text")
    out = _verdict(rows, frequent_lines(docs, max_docs))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", F.col("_kept").alias("kept"),
                      F.coalesce(F.size("_rl"), F.lit(0)).cast("bigint").alias("n_removed_lines"))


def quality_filter(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, share_pct: int = MAX_SHARE_PCT) -> DataFrame:
    """The kept documents with the columns of ``docs``; lines above the limit
    are gone from ``text`` (and from ``n_chars`` where there is one)."""
    cols = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), "doc_id", "source", "text")
    rows = base_metrics(rows.withColumn("_th", F.xxhash64("text")))
    # few documents lose lines: when their counted number allows it, the texts are not shuffled
    cut = frequent_lines(docs.select("doc_id", "source", "text"), max_docs, share_pct, SPEAKING_WORDS)
    cut = small(stored(cut, "cut-lines"), BROADCAST_DOCS)
    out = _verdict(rows.drop("text"), cut).where("_kept")
    text = F.col("_row")["text"]
    cleaned = F.when(F.size("_rl") > 0, F.array_join(F.filter(
        F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_rl", i)), "\n")).otherwise(text)
    out = out.withColumn("_text", cleaned)
    new = {"text": F.col("_text")}
    if "n_chars" in cols:
        new["n_chars"] = F.char_length("_text").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in cols])


SQL = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, text, t,
             list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
base AS (SELECT w.doc_id, w.source, w.text, len(ws)::BIGINT AS n_words,
                coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
         FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
judged AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM base),
line AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d),
norm AS (SELECT doc_id, source, text,
                regexp_replace(lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), '[0-9]', '0', 'g') AS nl,
                len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
         FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
above AS (SELECT source, nl, min(doc_id) AS first_doc FROM norm GROUP BY source, nl
          HAVING count(DISTINCT text) > 20),
cut AS (SELECT norm.doc_id, sum(n) AS rw, count(*) AS n_removed_lines
        FROM norm JOIN above ON norm.source = above.source AND norm.nl = above.nl
        WHERE norm.doc_id <> first_doc GROUP BY norm.doc_id)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (rw IS NOT NULL AND (n_words - rw < 10 OR 100 * (n_words - rw) < 30 * n_words)) AS kept,
       coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines
FROM judged j LEFT JOIN cut ON j.doc_id = cut.doc_id
"""
