"""WARC archives with segmented records (operator 3).

``write`` makes one record for each page and writes real WARC files with
Spark's text writer: a row is a record, the line separator is the blank line
that ends one.  A record whose block is longer than ``SEGMENT`` bytes is split
into a first record and continuations; bodies carry chunked transfer framing.
``read`` parses the files, takes whole records as they are, groups the others
by their origin, orders them by segment number, checks the total length, and
decodes the framing.

Equal payloads are found by digest in an aggregate that is combined before the
shuffle.  While the repeated digests fit a broadcast, a payload is shuffled only
if it is segmented, and then a group holds one page; beyond that the pages are
written with row numbers and shuffled once by those, never by digest.  Files hold at most ``FILE_RECORDS`` records, which bounds what
a task reads at once.

Defined cases: a null or empty page has an empty payload; null ids and repeated
rows each get a record of their own; a page that equals the response in id as
well is a response; null urls have no target; an empty table gives an empty
archive; extra columns are ignored.  A record with missing segments, a wrong
length or a wrong digest is reported in ``problem``, with a null payload.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import arrow_rows, stored
from recspark.session import scratch_path

SEGMENT = 32 * 1024
#: characters of a transfer chunk
CHUNK = 4096
FILE_RECORDS = 2000
#: payloads below this size are always responses
REVISIT_BYTES = 1000
#: most repeated digests (about 60 bytes each) that are broadcast
BROADCAST_DIGESTS = 500_000

_CRLF = "\r\n"


def _record(fields: list[tuple[str, object]], block: str) -> str:
    size = len(block.encode())
    head = "".join(f"{k}: {v}{_CRLF}" for k, v in [*fields, ("Content-Length", size)] if v is not None)
    return f"WARC/1.1{_CRLF}{head}{_CRLF}{block}"


def chunked(payload: str) -> str:
    """The payload in chunked transfer framing."""
    out = []
    for i in range(0, len(payload), CHUNK):
        part = payload[i:i + CHUNK]
        out.append(f"{len(part.encode()):x}{_CRLF}{part}{_CRLF}")
    return "".join(out) + f"0{_CRLF}{_CRLF}"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        at = end + 2 + size
        if len(out[-1]) != size or body[at:at + 2] != b"\r\n":
            raise ValueError("broken transfer chunk")
        at += 2


def _pieces(block: str, size: int) -> list[str]:
    """The block cut into parts of at most ``size`` bytes between characters."""
    raw, out, at = block.encode(), [], 0
    while len(raw) - at > size:
        end = at + size
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode())
        at = end
    return [*out, raw[at:].decode()]


def records_of(name: str, page_id, url, html, digest: str, refers_to, segment: int = SEGMENT) -> list[str]:
    """The records of one page; ``name`` is unique in the archive."""
    uri = None if url is None else "".join(f"%{ord(c):02X}" if c < " " else c for c in url)
    payload = html or ""
    fields = [("WARC-Target-URI", uri), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    head = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:x-page:{name}>"), *fields,
                         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                         ("X-Refers-To-Page-Id", refers_to), ("X-Payload-Length", len(payload.encode()))], head + _CRLF)]
    block = f"{head}Transfer-Encoding: chunked{_CRLF}{_CRLF}{chunked(payload)}"
    parts = _pieces(block, segment)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x-page:{name}>"), *fields]
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(block.encode()) if k == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:x-page:{name}-{k}>"),
                            ("WARC-Segment-Origin-ID", f"<urn:x-page:{name}>"), ("WARC-Segment-Number", k),
                            ("WARC-Segment-Total-Length", total)], part))
    return out


def _typed(sized: DataFrame, same: DataFrame) -> DataFrame:
    """``sized`` with the response's page (``ref``) of repeated payloads.  Many
    repeated digests meet narrow (row, digest) rows, and the pages take what was
    found by their row numbers, so no task gets the payloads of one digest."""
    if same.count() <= BROADCAST_DIGESTS:
        return sized.join(F.broadcast(same), F.col("digest") == F.col("_d"), "left")
    rows = stored(sized.withColumn("_row", F.monotonically_increasing_id()), "pages")
    refs = (rows.where(F.col("_b") >= REVISIT_BYTES).select("_row", "digest")
            .join(same, F.col("digest") == F.col("_d")).select("_row", "ref"))
    return rows.join(refs, "_row", "left")


def write(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Archives the pages (page_id, url, html) under ``path``."""
    pages = pages.select("page_id", "url", "html")
    payload = F.coalesce("html", F.lit(""))
    sized = pages.withColumns({"digest": F.sha1(payload.cast("binary")), "_b": F.octet_length(payload)})
    same = stored(sized.where(F.col("_b") >= REVISIT_BYTES).groupBy(F.col("digest").alias("_d"))
                  .agg(F.max("page_id").alias("ref"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "digests")
    typed = _typed(sized, same).select("page_id", "url", "html", "digest",
                                       F.when(~F.col("page_id").eqNullSafe(F.col("ref")), F.col("ref")).alias("ref"))

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "ref"))):
                out += records_of(f"{task}-{k}", *row, segment=segment)
                k += 1
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    (arrow_rows(typed, work, "value string").write.option("lineSep", _CRLF * 2)
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parse(content: bytes):
    """(fields, block) of each record of a file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split(_CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, content[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def body_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_PAGE = "page_id long, record_type string, refers_to long, digest string, length long, payload string, problem string"


def _page(fields: dict, block: bytes | None, problem: str | None = None):
    """A page row from the first record's fields and the whole block."""
    number = lambda k: int(fields[k]) if k in fields else None
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    kind = fields.get("WARC-Type")
    if kind == "revisit":
        return (number("X-Page-Id"), kind, number("X-Refers-To-Page-Id"), digest, number("X-Payload-Length"), None, None)
    payload = None
    if problem is None:
        try:
            payload = body_of(block)
            if digest and hashlib.sha1(payload).hexdigest() != digest:
                problem, payload = "digest differs", None
        except ValueError as e:
            problem = str(e)
    return (number("X-Page-Id"), kind, None, digest, None if payload is None else len(payload),
            None if payload is None else payload.decode("utf-8", "replace"), problem)


def _table(rows):
    import pyarrow as pa

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = [x.split()[0] for x in _PAGE.split(", ")]
    cols = zip(*rows) if rows else [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives under ``path``: page_id, record_type, refers_to,
    digest, length, payload, problem."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def whole(batches):
        for b in batches:
            for content in b.column("content"):
                rows = [_page(f, block) for f, block in parse(content.as_py()) if "WARC-Segment-Number" not in f]
                yield from _table(rows).to_batches()

    def segments(batches):
        import json

        import pyarrow as pa

        for b in batches:
            for content in b.column("content"):
                rows = [(f.get("WARC-Segment-Origin-ID", f.get("WARC-Record-ID")), int(f["WARC-Segment-Number"]), json.dumps(f), block)
                        for f, block in parse(content.as_py()) if "WARC-Segment-Number" in f]
                origin, number, fields, block = zip(*rows) if rows else ([], [], [], [])
                yield pa.record_batch([pa.array(origin, pa.string()), pa.array(number, pa.int64()),
                                       pa.array(fields, pa.string()), pa.array(block, pa.binary())],
                                      names=["origin", "number", "fields", "block"])

    def join_up(group):
        import json

        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("number", "fields", "block"))))
        fields = json.loads(rows[0][1])
        total = json.loads(rows[-1][1]).get("WARC-Segment-Total-Length")
        block = b"".join(r[2] for r in rows)
        problem = None
        if [r[0] for r in rows] != list(range(1, len(rows) + 1)) or total is None:
            problem = "missing segments"
        elif len(block) != int(total):
            problem = "total length differs"
        return _table([_page(fields, block, problem)])

    cut = arrow_rows(files, segments, "origin string, number long, fields string, block binary")
    return arrow_rows(files, whole, _PAGE).unionByName(cut.groupBy("origin").applyInArrow(join_up, _PAGE))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives the pages and reads them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, problem."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    back = read(spark, path)
    digest = F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(F.sha1(F.col("payload").cast("binary")))
    return back.select("page_id", F.col("length").alias("payload_bytes"), digest.alias("payload_digest"),
                       "record_type", "refers_to", "problem")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS r FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN r IS NULL OR r = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r <> page_id THEN r END AS refers_to, NULL::VARCHAR AS problem
FROM p LEFT JOIN m ON p.h = m.h
"""
