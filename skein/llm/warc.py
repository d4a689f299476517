"""Web archives: writing WARC records, reading them back, reassembling segments.

Writing. A page becomes a response record, an HTTP message with a chunked body; of
pages with equal payloads of at least MIN_REVISIT_BYTES the one with the smallest
id is the response and the others are revisit records that refer to it. Messages
over SEGMENT_BYTES are split: the first segment keeps the response's headers, the
others are continuation records that name its id, and the last one gives the total
length. Files hold at most RECORDS_PER_FILE records of bounded size.

Reading. Records are cut from the files by their lengths. Segments are grouped by
the id of their origin, ordered by number and checked: numbers without gaps, and
the stated total length. Then the chunked framing is decoded. Whole records are
decoded where they are read, so only segments are shuffled.

Files are written by Spark's text writer (a record is a line that ends in two
CRLFs) and read as binaryFile, so they can lie in any store that Spark reaches.

Edge cases: a null payload is empty; pages with a null id are responses, to which
nothing refers; rows that repeat id and payload each come back; URLs lose line
breaks; an empty table gives an empty result; extra columns are not read. A record
that fails a check comes back with its status and null payload columns.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, new_path

MIN_REVISIT_BYTES = 100
CHUNK_BYTES, SEGMENT_BYTES, RECORDS_PER_FILE = 4096, 16_384, 4000
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
#: Bytes that a reader gathers before it hands on a batch.
BATCH_BYTES = 4 << 20


class BadFraming(ValueError):
    pass


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        own = payload[at : at + size]
        parts += [b"%x\r\n" % len(own), own, b"\r\n"]
    return b"".join([*parts, b"0", END])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line_end = body.find(b"\r\n", at)
        if line_end < 0:
            raise BadFraming("a chunk has no size line")
        try:
            size = int(body[at:line_end].split(b";")[0].strip(), 16)
        except ValueError:
            raise BadFraming("a chunk's size is no number") from None
        at = line_end + 2
        if size == 0:
            if body.find(b"\r\n", at) < 0:
                raise BadFraming("the last chunk has no end")
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise BadFraming("a chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(message: bytes) -> bytes:
    """The decoded body of an HTTP message."""
    head, found, body = message.partition(END)
    if not found:
        raise BadFraming("the message has no header end")
    chunks = any(line.lower().startswith(b"transfer-encoding:") and b"chunked" in line.lower() for line in head.split(b"\r\n"))
    return dechunked(body) if chunks else body


def record_id(page_id, digest: str) -> str:
    """Equal for records of equal page and payload, whichever task writes them."""
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}/{digest}'.encode()).hexdigest())}>"


def _record(kind: str, own_id: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two CRLFs that end it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", DATE), *fields, ("Content-Length", len(block))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block


def records_of(page_id, url: str | None, payload: bytes, refers_to, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response's segments."""
    digest = hashlib.sha256(payload).hexdigest()
    own = record_id(page_id, digest)
    common = [("WARC-Target-URI", " ".join((url or "").split()) or "about:blank"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        common.append(("X-Page-ID", page_id))
    if refers_to is not None:
        more = [("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [_record("revisit", own, common + more + [("Content-Type", "application/http; msgtype=response")], HTTP_HEAD[: -len(END)] + END)]
    message = HTTP_HEAD + chunked(payload)
    common.append(("Content-Type", "application/http; msgtype=response"))
    if len(message) <= segment_bytes:
        return [_record("response", own, common, message)]
    cut = [message[at : at + segment_bytes] for at in range(0, len(message), segment_bytes)]
    out = [_record("response", own, [*common, ("WARC-Segment-Number", 1)], cut[0])]
    for n, block in enumerate(cut[1:], 2):
        last = [("WARC-Segment-Total-Length", len(message))] if n == len(cut) else []
        out.append(_record("continuation", record_id(own, str(n)), [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), *last], block))
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write one record (or its segments) per row to gzipped WARC files under path."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    shared = rows.where((F.octet_length("payload") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c"))
    firsts = durable(shared.where("c > 1").select("digest", "first_id"), "firsts")
    told = rows.join(firsts, "digest", "left")
    refers = F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for record in records_of(page_id, url, payload, refers_to, segment_bytes):
                    out.append(record)
                    size += len(record)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = told.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(run, "record binary")
    # a cast from binary to string leaves the bytes as they are
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Reader:
    """Cuts records from the pieces of a decompressed file."""

    def __init__(self, content: bytes):
        self.content, self.plain = memoryview(content), not content[:2] == b"\x1f\x8b"

    def pieces(self, size: int = 1 << 16):
        if self.plain:
            for at in range(0, len(self.content), size):
                yield bytes(self.content[at : at + size])
            return
        rest = self.content
        while len(rest):  # one gzip member after another
            unzip, at = zlib.decompressobj(31), 0
            while at < len(rest) and not unzip.eof:
                if out := unzip.decompress(rest[at : at + size]):
                    yield out
                at += size
            rest = rest[min(at, len(rest)) - len(unzip.unused_data) :] if unzip.eof else rest[len(rest) :]

    def __iter__(self):
        """(headers by lower-case name, block)"""
        held = b""
        pieces = self.pieces()

        def more() -> bool:
            nonlocal held
            piece = next(pieces, None)
            held += piece or b""
            return piece is not None

        while True:
            while not held.strip(b"\r\n") and more():
                pass
            held = held.lstrip(b"\r\n")
            if not held:
                return
            while END not in held and more():
                pass
            head, found, _ = held.partition(END)
            if not found:
                return
            lines = head.decode("utf-8", "replace").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            start, length = len(head) + len(END), int(headers.get("content-length", 0))
            parts, have = [held[start:]], len(held) - start
            while have < length and (piece := next(pieces, None)) is not None:
                parts.append(piece)
                have += len(piece)
            rest = b"".join(parts)
            held = rest[length:]
            yield headers, rest[:length]


_FIELDS = [
    ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to_id", pa.string()), ("stated_digest", pa.string()),
    ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string()), ("payload", pa.binary()),
]
_DDL = "record_id string, record_type string, page_id long, url string, refers_to_id string, stated_digest string, origin_id string, segment int, total_length long, block binary, payload_bytes long, payload_digest string, status string, payload binary"


def _decoded(message: bytes, stated: str | None, keep: bool) -> tuple:
    """payload_bytes, payload_digest, status, payload"""
    try:
        payload = payload_of(message)
    except BadFraming as e:
        return None, None, str(e), None
    digest = hashlib.sha256(payload).hexdigest()
    if stated not in (None, digest):
        return None, None, "the payload's digest is not the stated one", None
    return len(payload), digest, "ok", payload if keep else None


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """A row per record; whole responses are decoded, segments carry their block."""

    def run(batches):
        schema = pa.schema(_FIELDS)
        out, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                for h, block in _Reader(batch.column(0)[k].as_py()):
                    kind, segment = h.get("warc-type"), h.get("warc-segment-number")
                    digest = (h.get("warc-payload-digest") or "").rpartition(":")[2] or None
                    page_id, total = h.get("x-page-id"), h.get("warc-segment-total-length")
                    told = (None, digest, "ok", None) if kind == "revisit" else (None, None, None, None)
                    if kind == "response" and segment is None:
                        told, block = _decoded(block, digest, keep_payload), None
                    elif segment is None:
                        block = None
                    origin = None if segment is None else h.get("warc-segment-origin-id", h.get("warc-record-id"))
                    out.append((h.get("warc-record-id"), kind, None if page_id is None else int(page_id), h.get("warc-target-uri"), h.get("warc-refers-to"), digest,
                                origin, None if segment is None else int(segment), None if total is None else int(total), block, *told))
                    size += len(block or b"") + len(told[3] or b"") + 500
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, _DDL)


def reassemble(segments: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row per segmented record: its segments by origin, in order, checked and decoded.

    Equal copies of a record (the same row archived twice) have the same origin id;
    each first segment gives a row.
    """
    whole = segments.groupBy("origin_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total_length").alias("total"), F.min("page_id").alias("page_id"), F.min("url").alias("url"), F.min("stated_digest").alias("stated"),
    )

    def run(batches):
        names = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "status", "payload"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                blocks = {p["segment"]: p["block"] for p in r["parts"]}
                copies = max(1, sum(p["segment"] == 1 for p in r["parts"]))
                message = b"".join(blocks[n] for n in sorted(blocks))
                if sorted(blocks) != list(range(1, len(blocks) + 1)):
                    told = (None, None, "a segment is missing", None)
                elif r["total"] is None or len(message) != r["total"]:
                    told = (None, None, "the segments' length is not the stated total", None)
                else:
                    told = _decoded(message, r["stated"], keep_payload)
                row = (r["origin_id"], r["page_id"], r["url"], *told)
                yield pa.RecordBatch.from_arrays([pa.array([x] * copies, t) for x, t in zip(row, types, strict=True)], names=names)

    return whole.mapInArrow(run, "record_id string, page_id long, url string, payload_bytes long, payload_digest string, status string, payload binary")


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per page: page_id, url, payload_bytes, payload_digest, record_type, refers_to, status (and payload)."""
    records = durable(read_records(spark, path, keep_payload), "records")
    columns = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "status", "payload"]
    joined = durable(reassemble(records.where("segment is not null"), keep_payload), "reassembled")
    responses = records.where("record_type = 'response' and segment is null").select(columns).unionByName(joined)
    revisits = records.where("record_type = 'revisit'").select("page_id", "url", "refers_to_id", "stated_digest")
    # the responses that something refers to, once each
    wanted = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()
    origins = durable(responses.join(wanted, "record_id", "left_semi").groupBy("record_id").agg(F.min("page_id").alias("origin"), F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"), F.first("payload").alias("payload")), "origins")
    met = revisits.join(origins, revisits.refers_to_id == origins.record_id, "left")
    status = F.when(F.col("record_id").isNull(), "the record referred to is missing").when(F.col("stated_digest") != F.col("payload_digest"), "the digests differ").otherwise("ok")
    last = ["payload"] if keep_payload else []
    told = met.select("page_id", "url", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("origin").alias("refers_to"), status.alias("status"), *last)
    own = responses.select("page_id", "url", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "status", *last)
    return own.unionByName(told)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    return read_archives(pages.sparkSession, path)


#: The same rows in DuckDB's SQL over ``pages``, but for url and status.
ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= {MIN_REVISIT_BYTES} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= {MIN_REVISIT_BYTES}
"""
