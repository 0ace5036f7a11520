"""WARC archives: write request, response and metadata records, read archives back, and assemble
captures through concurrent-to identifiers."""
from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, small, stage, text_of

LEAST_BYTES = 1000             # smaller payloads are stored each time
CAPTURES_PER_ARCHIVE = 4096    # bounds an archive, which one task reads whole
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the archive format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(kind: str, *parts: Column) -> Column:
    """A name-based identifier: the same capture gets the same one however often a task runs."""
    h = F.md5(F.concat_ws("\u0001", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing blank lines; headers whose value is null are left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(name + ": "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Decides response or revisit.  Of equal payloads (SHA-1 and length) of at least ``least`` bytes the
    one with the largest (key, url) is the response.  Only payloads found twice go into the table that
    the pages are joined with, so pages themselves are not shuffled while it is small."""
    page = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), text_of(html).alias("html"))
    page = page.withColumn("digest", F.sha1(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    groups = (page.where(F.col("bytes") >= least).groupBy("digest", "bytes")
              .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    groups = small(stage(groups, "warc-groups"))
    same = F.struct("page_id", "url").eqNullSafe(F.col("first"))
    return page.join(groups, ["digest", "bytes"], "left").withColumn("revisit", F.col("first").isNotNull() & ~same)


def write_archives(pages: DataFrame, path: str, **names) -> None:
    """Per page one response or revisit record, and a request and a metadata record that name it as
    concurrent.  The text writer does the work: it commits each task's files once, wherever the folder
    is, and its line end is the blank lines that close a record."""
    c = captures(pages, **names)
    ident = record_id("capture", F.col("page_id"), F.col("url"), F.col("digest"))
    target = F.regexp_replace("url", "[\\r\\n]", "%0A")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    main = _record(F.when(F.col("revisit"), "revisit").otherwise("response"), [
        ("WARC-Record-ID", ident), ("WARC-Target-URI", target), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        ("WARC-Refers-To", F.when(F.col("revisit"), record_id("capture", F.col("first.page_id"), F.col("first.url"), F.col("digest")))),
        ("Content-Type", F.lit("application/http; msgtype=response"))], F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("html"))))
    rest = F.regexp_extract(F.coalesce(target, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    host = F.regexp_extract(F.coalesce(target, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    request = _record(F.lit("request"), [("WARC-Record-ID", record_id("request", ident)), ("WARC-Concurrent-To", ident), ("WARC-Target-URI", target),
                                         ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), F.when(rest == "", "/").otherwise(rest), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)))
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("page-id-absent: 1\r\n"))
    metadata = _record(F.lit("metadata"), [("WARC-Record-ID", record_id("metadata", ident)), ("WARC-Concurrent-To", ident), ("WARC-Target-URI", target),
                                           ("Content-Type", F.lit("application/warc-fields"))], fields)
    (c.select(F.concat_ws(END, main, request, metadata).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_PER_ARCHIVE).text(path))


def parse(data: bytes):
    """(headers with lower-case names, block) of every record of an archive, compressed or not.
    Lengths rule: whatever a payload contains cannot end its record."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":                 # one member for the file or one per record
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while True:
        while data[at:at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), value.strip())
        at = end + 4
        size = int(headers["content-length"])
        yield headers, data[at:at + size]
        at += size


RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("record_id", T.StringType()), ("warc_type", T.StringType()), ("concurrent_to", T.StringType()), ("refers_to", T.StringType()),
    ("target_uri", T.StringType()), ("warc_date", T.StringType()), ("payload_digest", T.StringType()), ("payload_bytes", T.LongType()),
    ("fields", T.MapType(T.StringType(), T.StringType())), ("payload", T.BinaryType()))])
_ARROW = (pa.string(),) * 7 + (pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record.  Digest and length are those of the payload found; a revisit has none and
    shows the digest it names.  A stored payload that contradicts its named digest raises."""
    schema = T.StructType(RECORD.fields if payloads else RECORD.fields[:-1])

    def rows(content: bytes):
        for h, block in parse(content):
            kind, named = h.get("warc-type"), (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None
            payload, fields = None, []
            if "application/http" in h.get("content-type", "") and b"\r\n\r\n" in block:
                payload = block[block.index(b"\r\n\r\n") + 4:]
            elif h.get("content-type") == "application/warc-fields":
                fields = [(a.strip(), b.strip()) for a, _, b in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)]
            found = size = None
            if kind == "response" and payload is not None:
                found, size = hashlib.sha1(payload).hexdigest(), len(payload)
                if named and named != found:
                    raise ValueError(f"{h.get('warc-record-id')}: payload digest differs")
            row = (h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"),
                   found or named, size, fields)
            yield row + ((payload if kind == "response" else None),) if payloads else row

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                part = []
                for row in rows(content.as_py()):
                    part.append(row)
                    if len(part) == 2000:
                        yield _batch(part, schema.names)
                        part = []
                if part:
                    yield _batch(part, schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _batch(rows, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, copies, response, request, metadata (structs of a record's
    columns).  Records meet on the identifier of the response or revisit that the others call
    concurrent, in one shuffle; a record that names none, or one that is absent, has a row of its own.  If a capture
    has several requests or metadata records the one with the smallest identifier is taken; records
    that repeat an identifier count as ``copies`` of one capture."""
    main = F.col("warc_type").isin("response", "revisit")
    body = F.struct(*records.columns)
    pick = lambda cond: F.min_by(body, F.when(cond, F.col("record_id")))
    return (records.withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
            .groupBy("capture_id").agg(F.count(F.when(main, 1)).alias("copies"), pick(main).alias("response"),
                                       pick(F.col("warc_type") == "request").alias("request"), pick(F.col("warc_type") == "metadata").alias("metadata")))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives of ``pages``, reads them back and returns per page: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    A null html is an empty payload; a null url has no target; a null key stays null.  Pages that agree in key, url
    and payload are copies of one capture and have one row each; rows that repeat the largest (key, url) of
    a payload are responses all.  Other columns are not read.  An empty table gives no rows.
    The length of a revisit's payload is that of the response it refers to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, key=key, url=url, html=html)
    found = stage(assemble(read_records(spark, path)).select(
        "capture_id", "copies", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), F.col("response.warc_type").alias("record_type"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.payload_bytes").alias("bytes"), F.col("response.refers_to").alias("target")), "warc-captures")
    stored = found.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("full"))
    revisits = found.where("record_type = 'revisit'").join(stored, "target", "left")
    plain = found.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "copies")
    both = plain.unionByName(revisits.select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "copies"))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
