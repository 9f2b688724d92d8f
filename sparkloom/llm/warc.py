"""WARC archives: writing with segmentation and revisits, and reassembly of the segments.

Writing: a payload becomes an HTTP response in chunked transfer framing.  A block longer than `segment_bytes` is cut: the
first part is the `response` record with WARC-Segment-Number 1, the others are `continuation` records that name it in
WARC-Segment-Origin-ID, the last of them with WARC-Segment-Total-Length.  Spark's text writer stores a record a row (its
line end is the last line end of the record), so any file system that Spark writes to will do; an archive ends after
`archive_records` records, so the parts of one payload may lie in several.

Reading: whole archives are parsed by Content-Length, continuation records are grouped by origin, ordered by segment
number, checked against the total length, and the chunked framing is decoded.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import utf8, written

VERSION = b"WARC/1.1"
DATE = "2020-01-01T00:00:00Z"
CHUNK = 16 << 10
RECORD = "kind string, id string, uri string, digest string, page_id long, refers_to long, origin string, segment int, total long, length long, block binary"


def record_id(page_id: int | None, digest: str, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {segment}')}>"


def chunked(payload: bytes) -> bytes:
    parts = (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk's length is wrong")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def http_response(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: dict[str, str | int | None], block: bytes) -> bytes:
    """A whole record but for its last line end."""
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    lines = [VERSION, *(f"{k}: {clean(v)}".encode() for k, v in headers.items() if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n"


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive; raises ValueError where it is broken."""
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = content.index(b"\r\n\r\n", at)
        headers = {}
        for line in content[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            headers[k.strip().lower().decode()] = v.strip().decode("utf-8", "replace")
        n = int(headers["content-length"])
        if content[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has not the length that it states")
        yield headers, content[end + 4 : end + 4 + n]
        at = end + 8 + n


def classified(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of at least `min_bytes` the largest page_id is kept,
    the others refer to it.  The hot payloads are combined before the shuffle."""
    rows = pages.withColumn("payload", F.coalesce(F.col("payload"), F.lit(b""))).withColumn("digest", F.sha1("payload"))
    big = rows.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes)
    kept = big.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # a written table has a known size: the planner sends it to all tasks below its threshold, and else deals out both sides
    out = rows.join(written(kept, "warc-kept"), "digest", "left")
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("keeper"), F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, *, segment_bytes: int = 64 << 10, archive_records: int = 1024, min_revisit_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes every row of `pages` as records of archives in the folder `path`, `archive_records` in each at most; no
    archive is larger than that many segments.

    A null payload is an empty one, a null url gives no target URI, a null id is written as none and refers to nothing.
    Repeated rows give repeated records; of rows that share the largest id each is a response.  No rows: no archives'
    records.
    """
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(payload_col).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[row].as_py() for c in batch.columns)
                own = record_id(page_id, digest)
                common = {"WARC-Target-URI": url, "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Page-ID": page_id}
                if refers_to is not None:
                    head = {"WARC-Type": "revisit", "WARC-Record-ID": own} | common | {"WARC-Refers-To": record_id(refers_to, digest), "WARC-Refers-To-Page-ID": refers_to, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    out.append(record(head, b""))
                else:
                    block = http_response(payload)
                    last = -(-len(block) // segment_bytes)
                    head = {"WARC-Type": "response", "WARC-Record-ID": own} | common | {"Content-Type": "application/http;msgtype=response", "WARC-Segment-Number": 1 if last > 1 else None}
                    out.append(record(head, block[:segment_bytes]))
                    for n in range(2, last + 1):
                        head = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(page_id, digest, n), "WARC-Date": DATE, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": n, "WARC-Segment-Total-Length": len(block) if n == last else None}
                        out.append(record(head, block[(n - 1) * segment_bytes : n * segment_bytes]))
                if len(out) >= 64:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = classified(named, min_revisit_bytes).mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.options(lineSep="\r\n", maxRecordsPerFile=archive_records).text(path)


def checked(block: bytes, stated: str | None) -> bytes:
    """The payload of a whole block."""
    payload = http_payload(block)
    if stated is not None and f"sha1:{hashlib.sha1(payload).hexdigest()}" != stated:
        raise ValueError(f"a payload has not the digest {stated}")
    return payload


def read_records(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of all archives in the folder `path`; see RECORD.  A broken archive raises.

    The block of a part of a segmented payload is that part; of another response it is the payload, decoded and checked, and
    length its size; it is null for a revisit and, without `payloads`, for every record that is no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "uri", "digest", "page_id", "refers_to", "origin", "segment", "total", "length", "block"]
        types = [*[pa.string()] * 4, *[pa.int64()] * 2, pa.string(), pa.int32(), *[pa.int64()] * 2, pa.binary()]
        number = lambda v: None if v is None else int(v)
        rows: list[tuple] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
        for batch in batches:
            for content in batch.column(0):
                for h, block in records(content.as_py()):
                    kind, own, segment = h["warc-type"], h["warc-record-id"], number(h.get("warc-segment-number"))
                    length = None
                    if segment is None:
                        block = None if kind == "revisit" else checked(block, h.get("warc-payload-digest")) if kind == "response" else block
                        length = None if block is None else len(block)
                        block = block if payloads else None
                    rows.append((kind, own, h.get("warc-target-uri"), h.get("warc-payload-digest"), number(h.get("warc-page-id")), number(h.get("warc-refers-to-page-id")), h.get("warc-segment-origin-id", own), segment, number(h.get("warc-segment-total-length")), length, block))
                    if len(rows) == 64:
                        yield out()
                        rows = []
        yield out()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select("content").mapInArrow(run, RECORD)


def read_pages(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload binary, payload_bytes, payload_digest, refers_to): each response reassembled, decoded
    and checked, each revisit with the digest that it states and a null payload.  Without `payloads` their bytes are counted
    and checked, and not kept.

    Records of other kinds give no rows.  Raises where a segment is missing, a total length is wrong, the chunked framing is broken or a payload has not the
    digest that its record states.
    """
    names = ["kind", "uri", "digest", "page_id", "refers_to"]
    schema = "kind string, uri string, digest string, page_id long, refers_to long, length long, payload binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found, stated = batch.column("segments")[at].as_py(), batch.column("digest")[at].as_py()
                block = b"".join(s["block"] for s in found)
                totals = [s["total"] for s in found if s["total"] is not None]
                if [s["segment"] for s in found] != list(range(1, len(found) + 1)) or totals != [len(block)]:
                    raise ValueError(f"segments {[s['segment'] for s in found]} of {len(block)} bytes, stated {totals}")
                payload = checked(block, stated)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 1) for c in batch.columns[:5]), pa.array([len(payload)]), pa.array([payload if payloads else None], pa.binary())], [*names, "length", "payload"])

    read = written(read_records(spark, path, payloads=payloads), "warc-records")  # archives are parsed once
    alone = read.where("segment is null and kind in ('response', 'revisit')").select(*names, "length", F.col("block").alias("payload"))
    # a group holds the parts of one payload
    part, first = F.struct("segment", "total", "block"), F.col("kind") == "response"
    grouped = read.where("segment is not null").groupBy("origin").agg(F.max(F.when(first, F.struct(*names))).alias("f"), F.sort_array(F.collect_list(part)).alias("segments"), F.count_if(first).alias("copies"))
    # k repeated rows leave k equal records of each part: every k-th makes one payload, and the payload comes k times
    grouped = grouped.withColumn("segments", F.expr("filter(segments, (x, i) -> i % greatest(copies, 1) = 0)")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "copies").cast("int"))))
    joined = grouped.select("f.*", "segments").mapInArrow(whole, schema)
    rows = alone.unionByName(joined)
    return rows.select("page_id", F.col("uri").alias("url"), F.col("kind").alias("record_type"), "payload", F.col("length").alias("payload_bytes"), F.substring("digest", 6, 40).alias("payload_digest"), "refers_to")
