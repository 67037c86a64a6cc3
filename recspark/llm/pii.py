"""Personal data spans (operator 9).

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod-97 for IBANs, ranges for addresses and lengths), and words near a span
raise or lower its score.  The four base kinds are always reported; the kinds
the method adds (``iban``, ``ssn``, ``phone_local``) only above the threshold.

One text at a time in Arrow batches: nothing is shuffled, a hot source or a
very long text is just more of the same work, and every expression is linear
in the length of the text.

Defined cases: a null or empty text has no spans; repeated rows each give a
row; an empty table gives an empty result; other columns are ignored by
``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.llm.common import arrow_rows, lean

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "phone_local")
BASE = KINDS[:4]
#: score before the context is read, and the least score of an added span
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "phone_local": 0.4}
THRESHOLD = 0.5
#: texts that are redacted at a time
_AT_ONCE = 512
CONTEXT_CHARS = 48
CONTEXT_UP, CONTEXT_DOWN = 0.2, 0.2
#: words near a span that speak for its kind
SPEAKS_FOR = {
    "email": {"email", "e-mail", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "credit", "visa", "mastercard", "payment", "pay"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "bic", "swift"},
    "ssn": {"ssn", "social", "security"},
    "phone_local": {"phone", "tel", "telephone", "call", "mobile", "fax"},
}
#: words that speak against any kind: identifiers, versions, examples
SPEAKS_AGAINST = {"version", "build", "isbn", "issn", "order", "sku", "part", "serial", "example"}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only start where a run of digits starts: the lookbehind keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
#: characters of an IBAN by country
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PHONE_LOCAL = re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[a-z][a-z-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def _emails(text: str):
    """Leftmost non-overlapping addresses.  The local part holds no ``@``, so
    it is the run of its characters that ends at the ``@``, cut at the end of
    the match before."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def _ibans(text: str):
    """Leftmost non-overlapping IBANs.  Capital words and numbers may follow
    one, so its end is tried at the country's length, then at each border of a
    group, longest first, until mod-97 holds; a start without one is passed."""
    at = 0
    while m := _IBAN_START.search(text, at):
        at = m.end()
        rest = _IBAN_REST.match(text, at)
        if not rest:
            continue
        ends = [k for k in range(at + 11, rest.end() + 1) if text[k - 1] != " " and not (text[k:k + 1].isascii() and text[k:k + 1].isalnum())]
        size = lambda k: k - m.start() - text.count(" ", m.start(), k)
        usual = IBAN_LENGTH.get(m.group()[:2])
        for k in sorted(ends, key=lambda k: (size(k) != usual, -k)):
            if size(k) >= 15 and mod97(text[m.start():k].replace(" ", "")):
                yield m.start(), k
                at = k
                break


def proposals(text: str):
    """(kind, start, end) of every confirmed span."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                yield "phone", *m.span()
    for a, b in _ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()
    for m in _PHONE_LOCAL.finditer(text):
        yield "phone_local", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS):start] + " \n " + text[end:end + CONTEXT_CHARS]
    words = set(_WORD.findall(near.lower()))
    s = PRIOR[kind]
    if words & SPEAKS_FOR[kind]:
        s += CONTEXT_UP
    if words & SPEAKS_AGAINST:
        s -= CONTEXT_DOWN
    return round(min(1.0, max(0.0, s)), 2)


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) ordered by start, then kind as listed; offsets
    are code points, the end is exclusive."""
    if not text:
        return []
    found = [(k, a, b, score(text, k, a, b)) for k, a, b in proposals(text)]
    taken = [(a, b) for k, a, b, _ in found if k in BASE or k == "iban"]
    kept = [x for x in found if x[0] in BASE
            or (x[3] >= THRESHOLD and (x[0] == "iban" or not any(a < x[2] and x[1] < b for a, b in taken)))]
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                      T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: array of kind, start, end, score) for every document."""
    def work(batches):
        import pyarrow as pa

        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                    ("score", pa.float64())]))
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t)]
                    for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(rows, spans)], names=["doc_id", "spans"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", T.ArrayType(_SPAN))])
    return arrow_rows(docs.select("doc_id", "text"), work, schema)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base
    spans, and all spans as ``kind:start:end`` joined by commas."""
    def label(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    rows = find(docs).withColumn("_base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(label(F.col("_base")), 256).alias("base_sha256"),
                       label(F.col("spans")).alias("spans"))


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by ``<KIND>``; overlapping spans become
    one, named by the span with the highest score."""
    spans = spans_of(text)
    if not spans:
        return text
    merged: list[list] = []
    for kind, a, b, s in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
            if s > merged[-1][3]:
                merged[-1][2:] = [kind, s]
        else:
            merged.append([a, b, kind, s])
    out, at = [], 0
    for a, b, kind, _ in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of every text replaced; no document is lost."""
    def work(batches):
        import pyarrow as pa

        for b in batches:
            k = b.schema.get_field_index("text")
            for at in range(0, b.num_rows, _AT_ONCE):
                part = b.slice(at, _AT_ONCE)
                texts = pa.array([redacted(t) for t in part.column(k).to_pylist()], b.schema.field(k).type)
                yield part.set_column(k, b.schema.field(k), texts)

    cols = docs.columns
    # whole rows in bounded batches: no queue of rows beside the texts in the executor,
    # and workers that served earlier stages give their freed memory back first
    out = arrow_rows(docs, lean(work), docs.schema)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in cols])
