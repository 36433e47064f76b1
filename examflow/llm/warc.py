"""WARC archives as a chunked record table.

Writing: every page is one record; of pages with the same payload the one with the
smallest page_id is a ``response`` and the others are ``revisit`` records that
name it. A payload longer than ``segment_bytes`` is cut (between code points) into
WARC segments: the first is the record, the next are ``continuation`` records. One
output row is one segment, cut from the payload's Arrow buffer as it is written; the
page's own cell is whole, as Parquet holds it, but no record is built beside it.
Files are gzip text written by Spark with ``\\n`` between rows, hence byte for
byte WARC (a record ends with CRLF CRLF; its last LF is the row separator).

Reading: gzip files are not splittable, so one task streams a file's lines in order
and parses them by Content-Length into rows (record id, segment, chunk number,
bytes, running SHA-1 and length of the payload so far). The last chunk of a record
carries the digest of the whole payload. Memory: one segment and one chunk.

* A null html is an empty payload. A null page_id is written as ``null``; among
  equal payloads it is never the one referred to if another has an id, and if none
  has, one row is the response and the others revisit ``null``. Repeated rows with
  the same id and payload: all but one are revisits of that id.
* Payloads under ``min_revisit_bytes`` are all responses.
* Many equal payloads: a payload with over 1/2,048 of all rows (so at most 2,048 of
  them), and over ``rows_per_task``, is dealt to as many tasks as it weighs, by page_id
  and url, when its pages meet their first one.
* Empty table: an archive without records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examflow.session import scratch_path

from .frames import python_ready, written

SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 1 << 18
MOST_HOT = 2048  # payloads that are split
ROWS_PER_TASK = 4096
CHUNKS = (
    "record_id string, warc_type string, uri string, refers_to string, header_digest string, "
    "header_length long, chunk_no long, chunk_bytes long, bytes_so_far long, "
    "digest_so_far string, last boolean"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _segments(data: memoryview, limit: int) -> Iterator[bytes]:
    at = 0
    while at < len(data) or at == 0:
        end = min(at + limit, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield bytes(data[at:end])
        at = end
        if at >= len(data):
            return


def record_rows(page_id: str, url: str, payload: memoryview, digest: str, length: int, revisit: bool,
                refers_to: str, segment_bytes: int) -> Iterator[str]:
    """The text of each segment of one record, without its last LF."""
    segmented, written_bytes = not revisit and len(payload) > segment_bytes, 0
    for k, part in enumerate([b""] if revisit else _segments(payload, segment_bytes), 1):
        written_bytes += len(part)
        head = [
            "WARC/1.1",
            f"WARC-Type: {'revisit' if revisit else 'continuation' if k > 1 else 'response'}",
            f"WARC-Record-ID: <urn:page:{page_id}{'' if k == 1 else f':{k}'}>",
            "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {url}",
            f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {length}",
        ]
        if revisit:
            head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                     "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if segmented:
            head += [f"WARC-Segment-Number: {k}"]
            if k > 1:
                head += [f"WARC-Segment-Origin-ID: <urn:page:{page_id}>"]
            if written_bytes == len(payload):
                head += [f"WARC-Segment-Total-Length: {length}"]
        head += ["Content-Type: text/html", f"Content-Length: {len(part)}", "", ""]
        yield "\r\n".join(head) + part.decode("utf-8", "surrogatepass") + "\r\n\r"


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0,
               segment_bytes: int = SEGMENT_BYTES, rows_per_task: int = ROWS_PER_TASK) -> None:
    """``pages(page_id, url, html)`` -> .warc.gz text files under ``path``."""
    python_ready(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
        F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("n"),
    )
    # narrow: equal payloads meet as (digest, length, id) only, summed before the shuffle
    narrow = written(rows.groupBy("sha", "n", "page_id").agg(F.count(F.lit(1)).alias("rows")), "digests")
    firsts = narrow.groupBy("sha", "n").agg(
        F.min("page_id").alias("first_id"), F.sum("rows").alias("copies"),
        F.coalesce(F.min_by("rows", "page_id"), F.sum("rows")).alias("of_first"),  # no id: all are first
    ).filter((F.col("copies") > 1) & (F.col("n") >= min_revisit_bytes))
    first = F.col("page_id").eqNullSafe(F.col("first_id")) | F.col("copies").isNull()
    # the html goes along here, so the pages of a hot payload are salted
    share = max(rows_per_task, (narrow.agg(F.sum("rows")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(firsts.filter(F.col("copies") > share).select(
        "sha", "n", F.ceil(F.col("copies") / share).cast("long").alias("ways")))
    ways = F.coalesce("ways", F.lit(1).cast("long"))
    salted = rows.join(hot, ["sha", "n"], "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), ways))
    named = firsts.join(hot, ["sha", "n"], "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)))
    decided = (
        salted.drop("ways").join(named.drop("ways"), ["sha", "n", "salt"], "left").drop("salt")
        .withColumn("revisit", ~first)
        .withColumn("html", F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    )
    columns = ["page_id", "url", "html", "sha", "n", "revisit", "first_id"]
    tied = firsts.filter("of_first > 1")
    if tied.isEmpty():
        decided = decided.select(columns)
    else:
        # several rows are first: written once, so that their numbers stay, and the
        # smallest number is the response
        alike = F.coalesce(~F.col("revisit") & (F.col("of_first") > 1), F.lit(False))
        ties = written(decided.filter(alike).withColumn("place", F.monotonically_increasing_id()), "ties")
        one = ties.groupBy("sha", "n").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("one"))
        chosen = ties.drop("revisit").join(one, "place", "left").withColumn("revisit", F.col("one").isNull())
        chosen = chosen.withColumn("html", F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
        decided = decided.filter(~alike).select(columns).unionByName(chosen.select(columns))

    def encode(batches):
        rows, size = [], 0
        for batch in batches:
            payloads = batch.column(2).cast(pa.binary())
            for k, r in enumerate(batch.drop_columns(["html"]).to_pylist()):
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                url = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in r["url"] or "")
                name = lambda i: "null" if i is None else str(i)
                for row in record_rows(name(r["page_id"]), url, memoryview(payloads[k].as_buffer()), digest, r["n"],
                                       r["revisit"], name(r["first_id"]), segment_bytes):
                    rows.append(row)
                    size += len(row)
                    if size >= segment_bytes:
                        yield pa.RecordBatch.from_pydict({"value": rows})
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({"value": rows})

    (decided.mapInArrow(encode, "value string")
     .write.option("lineSep", "\n").option("compression", "gzip").text(path))


def read_warc(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows (CHUNKS) of all records under ``path``."""
    python_ready(spark)
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def parse(batches):
        out: list[tuple] = []
        head: dict[str, str] | None = None
        sha, total, number, left, chunk = hashlib.sha1(), 0, 0, -1, 0
        rid = ""
        for batch in batches:
            for line in batch.column(0).to_pylist():
                data = line.encode("utf-8", "surrogatepass") + b"\n"
                if left < 0:  # in a header, or between records
                    text = data.rstrip(b"\r\n")
                    if head is None:
                        if text.startswith(b"WARC/"):
                            head = {}
                        continue
                    if text:
                        key, _, value = text.decode("utf-8", "surrogatepass").partition(": ")
                        head[key] = value
                        continue
                    left, chunk = int(head["Content-Length"]), 0
                    if head["WARC-Type"] != "continuation":
                        sha, total, number = hashlib.sha1(), 0, 0
                        rid = head["WARC-Record-ID"]
                        kind = head["WARC-Type"]
                    if left:
                        continue
                    data = b""
                part = data[:left]
                left -= len(part)
                sha.update(part)
                total += len(part)
                chunk += len(part)
                if left == 0 or chunk >= chunk_bytes:
                    last = left == 0 and ("WARC-Segment-Number" not in head
                                          or "WARC-Segment-Total-Length" in head)
                    out.append((rid, kind, head.get("WARC-Target-URI"), head.get("WARC-Refers-To"),
                                head["WARC-Payload-Digest"].removeprefix("sha1:"),
                                int(head["X-Payload-Length"]), number, chunk, total,
                                base64.b32encode(sha.digest()).decode(), last))
                    number, chunk = number + 1, 0
                    if left == 0:
                        left, head = -1, None
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)), strict=True)), _SCHEMA)
                out = []

    lines = spark.read.option("lineSep", "\n").schema("value string").text(path)
    return lines.mapInArrow(parse, CHUNKS)


_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("warc_type", pa.string()), ("uri", pa.string()),
    ("refers_to", pa.string()), ("header_digest", pa.string()), ("header_length", pa.int64()),
    ("chunk_no", pa.int64()), ("chunk_bytes", pa.int64()), ("bytes_so_far", pa.int64()),
    ("digest_so_far", pa.string()), ("last", pa.bool_()),
])


def page_records(chunks: DataFrame) -> DataFrame:
    """One row per record from the chunk table: page_id, payload_bytes,
    payload_digest, record_type, refers_to. Responses report what was read, and
    fail if it differs from their header; revisits report their header."""
    ident = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1).try_cast("long")
    revisit = F.col("warc_type") == "revisit"
    same = (F.col("digest_so_far") == F.col("header_digest")) & (
        F.col("bytes_so_far") == F.col("header_length"))
    checked = F.when(~revisit & ~same, F.raise_error(F.concat(
        F.lit("payload differs from its header: "), "record_id")))
    return chunks.filter("last").select(
        ident("record_id").alias("page_id"),
        F.coalesce(checked.cast("long"), F.when(revisit, F.col("header_length")).otherwise(
            F.col("bytes_so_far"))).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(revisit, ident("refers_to")).alias("refers_to"),
    )


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC files under the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, min_revisit_bytes)
    return page_records(read_warc(spark, path))
