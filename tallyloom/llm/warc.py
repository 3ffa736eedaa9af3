"""WARC archives: write captures as records, read archives back, assemble transactions.

A capture is written as three records: a response (or a revisit without payload), the
request, and a metadata record; the latter two name the first in WARC-Concurrent-To.
Reading gives one row for each record; assembling joins request and metadata to the
response or revisit through the concurrent-to identifiers, resolves revisits through
WARC-Refers-To, and gives one nested row for each capture.

Archives are written by Spark's text sink, gzipped: the record separator of the format
(two line ends) is the sink's line separator, so no record is built outside a task, and
any store that Spark can write will do. The size of an archive is that of a shuffle
partition.

Pages are numbered in a written table first, so that a row keeps its record ids whatever plan it comes from.

Null html is an empty payload, a null url an empty target. Repeated page ids give
captures of their own. Where rows that share the largest page_id share the payload too,
all of them are responses. A null page_id counts as the smallest. Very long html is one
record, the only thing beside the compressed archive that a reading task holds. Other columns of the input, whatever their names, have no effect. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

CRLF = "\r\n"
END = CRLF * 2
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
RECORDS_SCHEMA = (
    "record_id string, type string, target string, concurrent_to string, refers_to string, declared_digest string, "
    "payload_bytes long, payload_digest string, page_id long, headers map<string,string>, payload binary"
)


def dedup_plan(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """row, page_id, url, html, n, digest, original, first: original is the page_id that a revisit refers to, else null; first marks the response that it is."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
    rows = rows.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    firsts = rows.where(F.col("n") >= least).groupBy(F.col("digest").alias("d")).agg(F.max(F.struct("page_id", -F.col("row"))).alias("top"))
    joined = rows.join(firsts, rows["digest"] == firsts["d"], "left").withColumn("newest", F.col("top.page_id"))
    original = F.when((F.col("n") >= least) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("newest"))), F.col("newest"))
    return joined.withColumn("original", original).withColumn("first", (F.col("n") >= least) & (F.col("row") == -F.col("top.col2"))).drop("d", "top", "newest")


def _record_id(*cols):
    d = F.sha1(F.concat_ws("|", *cols))
    return F.concat(F.lit("<urn:uuid:"), F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3), F.lit("-a"), F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12), F.lit(">"))


def _record(kind, rid, url, kind_of, body, *more):
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}"),
        F.when(url != "", F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]", " "))), *more,
        F.lit(f"Content-Type: {kind_of}"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    return F.concat(head, F.lit(END), body)


def write_archives(pages: DataFrame, path: str) -> None:
    plan = dedup_plan(pages)
    # The response that revisits refer to is known by digest and page id; all else, rows that repeat it too, by the row as well.
    rid = _record_id(F.lit("capture"), F.col("digest"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.when(~F.coalesce("first", F.lit(False)), F.col("row").cast("string")))
    plan = plan.withColumn("rid", rid).withColumn("revisit", F.col("original").isNotNull())
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(END))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    refers = F.concat(F.lit("WARC-Refers-To: "), _record_id(F.lit("capture"), F.col("digest"), F.col("original").cast("string")))
    capture = _record(
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.col("rid"), F.col("url"), "application/http; msgtype=response",
        F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))), digest,
        F.when(F.col("revisit"), F.concat(refers, F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
    )
    to = F.concat(F.lit("WARC-Concurrent-To: "), F.col("rid"))
    row = F.col("row").cast("string")
    asked = F.concat(F.lit("GET "), F.regexp_replace(F.col("url"), r"[\r\n]", " "), F.lit(f" HTTP/1.1{CRLF}User-Agent: tallyloom{END}"))
    request = _record(F.lit("request"), _record_id(F.lit("request"), F.col("rid"), row), F.col("url"), "application/http; msgtype=request", asked, to)
    known = F.concat(F.lit("row: "), row, F.coalesce(F.concat(F.lit(f"{CRLF}page_id: "), F.col("page_id").cast("string")), F.lit("")), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), _record_id(F.lit("metadata"), F.col("rid"), row), F.col("url"), "application/warc-fields", known, to)
    plan.select(F.explode(F.array(capture, request, metadata)).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def inflated(data: bytes, step: int = 1 << 18):
    """Pieces of an archive, gzipped (any number of members) or not."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    z = zlib.decompressobj(31)
    for at in range(0, len(data), step):
        left = data[at : at + step]
        while left:
            yield z.decompress(left, step)
            left = z.unconsumed_tail
            if z.eof:
                left, z = z.unused_data, zlib.decompressobj(31)
    yield z.flush()


def parse_records(data: bytes):
    """(headers, content) of each record of one archive. Only the compressed archive and one record are held."""
    pieces, held, at = inflated(data), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (head := held.find(b"\r\n\r\n", at)) < 0 and more():
            pass
        if head < 0:
            if held[at:].strip():
                raise ValueError("an archive ends within a record")
            return
        if not held.startswith(b"WARC/", at):
            raise ValueError(f"no record begins with {bytes(held[at : at + 20])!r}")
        fields = {}
        for line in bytes(held[at:head]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().decode().lower()] = value.strip().decode()
        begin, end = head + 4, head + 4 + int(fields["content-length"])
        while len(held) < end and more():
            pass
        if len(held) < end:
            raise ValueError("an archive ends within a record")
        yield fields, bytes(held[begin:end])
        at = end + 4
        if at > 1 << 20:
            while len(held) < at and more():
                pass
            del held[:at]
            at = 0


def _rows(with_payload: bool):
    schema = pa.schema([
        ("record_id", pa.string()), ("type", pa.string()), ("target", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ])

    def parse(batches):
        for batch in batches:
            for data in batch.column("content"):
                out, held = [], 0
                for fields, content in parse_records(data.as_py()):
                    kind, payload = fields.get("warc-type"), content
                    if "application/http" in fields.get("content-type", ""):
                        payload = content.partition(b"\r\n\r\n")[2]
                    known = dict(x.split(": ", 1) for x in content.decode().split("\r\n") if ": " in x) if kind == "metadata" else {}
                    out.append({
                        "record_id": fields.get("warc-record-id"), "type": kind, "target": fields.get("warc-target-uri"), "concurrent_to": fields.get("warc-concurrent-to"),
                        "refers_to": fields.get("warc-refers-to"), "declared_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "page_id": int(known["page_id"]) if "page_id" in known else None,
                        "headers": list(fields.items()), "payload": payload if with_payload else None,
                    })
                    held += len(content) if with_payload else 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    return parse


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record (RECORDS_SCHEMA). A task holds one archive at a time, compressed."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_rows(with_payload), RECORDS_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture, request, metadata, original.

    A capture without request or metadata has null there. Of several requests or
    metadata records that name one capture, each gives a row of its own for metadata,
    and the first request by record id is taken.
    """
    full = F.struct(*[c for c in records.columns])
    captures = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("rid"), "refers_to", full.alias("capture"))
    requests = records.where("type = 'request'").groupBy(F.col("concurrent_to").alias("q")).agg(F.min(F.struct("record_id", "target")).alias("request"))
    metadata = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("m"), F.struct("record_id", "page_id").alias("metadata"))
    whole = captures.join(requests, F.col("rid") == F.col("q"), "left").join(metadata, F.col("rid") == F.col("m"), "left").drop("q", "m")
    return whole


def op2_warc(spark, sf_dir):
    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    # The archives are read and parsed once; the joins take this table.
    records = materialize(read_archives(spark, path, with_payload=False).drop("headers", "payload"), "records")
    whole = assemble(records)
    originals = whole.where(F.col("capture.type") == "response").select(F.col("rid").alias("o"), F.col("metadata.page_id").alias("original_page"), F.col("capture.payload_bytes").alias("original_bytes"), F.col("capture.payload_digest").alias("original_digest"))
    revisit = F.col("capture.type") == "revisit"
    found = whole.join(originals, whole["refers_to"] == originals["o"], "left")
    return found.select(
        F.col("metadata.page_id").alias("page_id"),
        F.when(revisit, F.col("original_bytes")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("original_digest")).otherwise(F.col("capture.payload_digest")).alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.when(revisit, F.col("original_page")).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT page_id, n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS newest FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < newest THEN newest END AS refers_to
FROM q
"""
