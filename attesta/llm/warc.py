"""Writing web archives and assembling their records into captures.

Every page becomes three records: the request, the response (or, for a payload already written, a revisit that refers to
the response) and a metadata record. Request and metadata name the response by WARC-Concurrent-To. Reading goes the other
way: records are framed by Content-Length, joined through those identifiers, and one nested row per capture comes out.

Archives are written by Spark's text writer and read by its binary file reader, so they may lie in any store that Spark
reaches. ``file_bytes`` bounds the size of an archive on average, as one task reads it as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.shared import shared_folder, shared_table

END = "\r\n"
_RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target string, content_type string, declared_digest string, head string, payload binary"
_RECORD_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target", pa.string()), ("content_type", pa.string()), ("declared_digest", pa.string()), ("head", pa.string()), ("payload", pa.binary())])


def digest_name(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, parts)).encode()).digest(), version=4)}>"


def with_digests(pages: DataFrame) -> DataFrame:
    """Per page: row (a number for the row), page_id, url, html, digest and size of the payload (html in UTF-8, null: empty).

    The numbers hold for one reading of ``pages`` only, so the rows are written once and everything else starts from that table.
    """
    def digests(batches):
        for b in batches:
            found = [x or b"" for x in b.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest_name(x) for x in found]), pa.array([len(x) for x in found], pa.int64())],
                                             names=["row", "page_id", "url", "html", "digest", "size"])

    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    numbered = rows.mapInArrow(digests, "row long, page_id long, url string, html string, digest string, size long")
    return shared_table(numbered, "pages", "zstd")


def _block(kind: str, record_id: str, fields: list[tuple[str, str]], content_type: str, block: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"{name}: {value}" for name, value in fields if value]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block.encode())}"]
    return END.join(lines) + END + END + block + END  # the writer's line end closes the record


def archive_texts(batches):
    """The three records of each page as text. Line breaks in an address are escaped, as headers are lines."""
    for b in batches:
        out = []
        for row, page, url, html, digest, first_row, first_page in zip(*[c.to_pylist() for c in b.columns]):
            html, url = html or "", (url or "").replace("\r", "%0D").replace("\n", "%0A")
            own, first = _urn("capture", row), _urn("capture", first_row)
            target = [("WARC-Target-URI", url)]
            request = _block("request", _urn("request", row), [*target, ("WARC-Concurrent-To", own)], "application/http;msgtype=request", "GET / HTTP/1.1" + END + END)
            about = _block("metadata", _urn("metadata", row), [*target, ("WARC-Concurrent-To", own)], "application/warc-fields", f"pageId: {'' if page is None else page}" + END)
            status = "HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + END
            fields = [*target, ("WARC-Payload-Digest", f"sha1:{digest}")]
            if first_row == row:
                answer = _block("response", own, fields, "application/http;msgtype=response", status + html)
            else:
                profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                answer = _block("revisit", own, [*fields, profile, ("WARC-Refers-To", first)], "application/http;msgtype=response", status)
            out.append(request + END + answer + END + about)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_archives(pages: DataFrame, min_bytes: int = 0, file_bytes: int = 1 << 25) -> str:
    """Writes gzip archives into the shared folder and returns their place.

    Of pages with equal payloads of at least ``min_bytes`` the one with the largest page_id (null smallest; of equal
    page_ids the last row) is the response, the others revisit it; shorter ones are all responses. A file holds as many pages
    as have about ``file_bytes`` of payload on average.
    """
    spark = pages.sparkSession
    numbered = with_digests(pages)
    digests = numbered.select("row", "page_id", "digest", "size")
    pages_per_file = max(1, int(file_bytes / ((digests.agg(F.avg("size")).first()[0] or 0) + 1024)))
    latest = digests.where(F.col("size") >= min_bytes).groupBy("digest").agg(
        F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # only pages whose payload occurs again need another page's row: a narrow table
    again = shared_table(digests.where(F.col("size") >= min_bytes).join(latest, "digest").select(
        F.col("row").alias("of_row"), F.col("first.row").alias("first_row"), F.col("first.page_id").alias("first_page")), "again")
    rows = numbered.join(again, F.col("row") == F.col("of_row"), "left").select(
        "row", "page_id", "url", "html", "digest", F.coalesce("first_row", "row").alias("first_row"), "first_page")
    path = shared_folder(spark, "archives")
    (rows.mapInArrow(archive_texts, "value string").write.option("lineSep", END).option("compression", "gzip")
        .option("maxRecordsPerFile", pages_per_file).text(path))
    return path


def _unpack(content: bytes) -> bytes:
    """The bytes of an archive, whether plain, gzipped as a whole or gzipped record by record."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        reader = zlib.decompressobj(31)
        parts.append(reader.decompress(content))
        content = reader.unused_data.lstrip(b"\0")
    return b"".join(parts)


def parse(content: bytes):
    """(record id, type, concurrent to, refers to, target, content type, digest, head, payload) of each record."""
    data, at = _unpack(content), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        fields = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
        length = int(fields.get("content-length") or 0)
        block = data[stop + 4: stop + 4 + length]
        at = stop + 4 + length
        head, payload = b"", block
        if fields.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
        yield (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-concurrent-to"), fields.get("warc-refers-to"),
               fields.get("warc-target-uri"), fields.get("content-type"), fields.get("warc-payload-digest"), head.decode("latin-1"), payload)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives in a folder."""
    def records(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for r in parse(content.as_py()):
                    rows.append(r)
                    size += len(r[-1])
                    if size > 1 << 23 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD_ARROW)], schema=_RECORD_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD_ARROW)], schema=_RECORD_ARROW)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(records, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata records.

    Of several requests or metadata records that name the same capture the smallest record id is taken. A capture without
    them has nulls there; records that name no capture of the archives come as no row.
    """
    def partner(kind: str) -> DataFrame:
        fields = F.struct("record_id", "content_type", F.when(F.col("record_type") == "metadata", F.decode("payload", "UTF-8")).otherwise(F.col("head")).alias("body"))
        return records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull()).groupBy("concurrent_to").agg(
            F.min(fields).alias(kind)).withColumnRenamed("concurrent_to", f"{kind}_of")

    answers = records.where(F.col("record_type").isin("response", "revisit"))
    joined = answers.join(partner("request"), F.col("record_id") == F.col("request_of"), "left").join(
        partner("metadata"), F.col("record_id") == F.col("metadata_of"), "left")
    return joined.select(
        "record_id", "target", "record_type", "refers_to", "declared_digest", "request", "metadata",
        F.struct("head", "content_type", "payload").alias("response"))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as archives, reads them back and returns per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to, target.

    payload_bytes and payload_digest are those of the full payload, a revisit's being read from the response it refers to.
    Null html is an empty payload, a null url an empty target. A null page_id stays null; repeated rows are captures of
    their own. No pages give no rows.
    """
    spark = pages.sparkSession
    captures = assemble(read_records(spark, write_archives(pages, min_bytes)))

    def facts(batches):
        for b in batches:
            found = [x or b"" for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([digest_name(x) for x in found]), pa.array([len(x) for x in found], pa.int64())],
                                             names=["record_id", "record_type", "refers_to", "target", "declared", "page_id", "digest", "size"])

    page = F.nullif(F.regexp_extract("metadata.body", r"pageId: (-?\d*)", 1), F.lit("")).cast("long")
    narrow = shared_table(
        captures.select("record_id", "record_type", "refers_to", "target", F.regexp_replace("declared_digest", "^sha1:", "").alias("declared"), page.alias("page_id"), "response.payload")
        .mapInArrow(facts, "record_id string, record_type string, refers_to string, target string, declared string, page_id long, digest string, size long"), "captures")
    responses = narrow.where("record_type = 'response'").select(F.col("record_id").alias("first_id"), F.col("page_id").alias("first_page"), F.col("digest").alias("first_digest"), F.col("size").alias("first_size"))
    own = narrow.where("record_type = 'response'").select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "target")
    again = narrow.where("record_type = 'revisit'").join(responses, F.col("refers_to") == F.col("first_id"), "left").select(
        "page_id", F.col("first_size").alias("payload_bytes"), F.coalesce("first_digest", "declared").alias("payload_digest"), "record_type", F.col("first_page").alias("refers_to"), "target")
    return own.unionByName(again)
