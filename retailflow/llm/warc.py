"""WARC archives of pages: writing with segmentation and revisits, reading back.

Writing. A page becomes a ``response`` record whose block is an HTTP response with
chunked transfer framing; blocks longer than ``segment_bytes`` continue in
``continuation`` records that name the first record as their origin. A page whose
payload another page already holds becomes a ``revisit`` record without a body. The
archive files are written by Spark's text sink (one record a row, the two line breaks
that end a record as separator, gzip), so they land in whatever store the folder is in.

Reading. Files are parsed record by record from Content-Length; records of a segmented
resource are grouped by origin identifier, ordered by segment number, checked against
the total length, and the chunked framing is taken off. The payload digest is computed
again and compared with the header. Revisits take length and digest from the response
they name.

Files stay near ``file_bytes`` because records, none longer than a segment, are dealt
over as many files as the total needs; a reader holds one file at a time. A group of
segments is one page. Payloads are text, archives hold their UTF-8 bytes.

Defined results
* null html: empty payload; null page ids come before all others; repeated rows of the
  page with the largest id are all responses, numbered apart by a copy mark that the
  revisits' reference leaves out; an empty table gives an empty table;
* equal payloads shorter than ``min_revisit`` bytes are all responses;
* extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.llm.common import staged
from retailflow.session import work_dir

CRLF = "\r\n"
BROADCAST_MARKS = 200_000  # rows of about 100 bytes
RECORDS = (
    "record_id string, kind string, segment int, origin string, total long, page_id long, "
    "refers_to string, refers_page long, digest string, block binary"
)


def _base32(hex_digest) -> str:
    import base64

    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _pieces(text: str, size: int) -> list[bytes]:
    """UTF-8 bytes of a text in pieces of at most ``size`` bytes, cut between characters."""
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def http_block(html: str | None, chunk_bytes: int) -> str:
    """HTTP response with chunked framing; without a body for ``None``."""
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}"
    if html is None:
        return head
    chunks = [f"{len(p):x}{CRLF}{p.decode()}{CRLF}" for p in _pieces(html, chunk_bytes)]
    return head + "".join(chunks) + f"0{CRLF}{CRLF}"


def unchunk(block: bytes) -> bytes:
    """Payload of an HTTP response block, transfer framing removed."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk does not end where its size says")
        at = end + 4 + size


def _record(headers: list[tuple[str, object]], block: str) -> str:
    lines = [f"{k}: {v}" for k, v in headers if v is not None]
    lines.append(f"Content-Length: {len(block.encode())}")
    return "WARC/1.1" + CRLF + CRLF.join(lines) + CRLF + CRLF + block


def record_name(page_id, digest: str) -> str:
    return f"<urn:x-page:{page_id}:{digest}>"


def page_records(row, segment_bytes: int, chunk_bytes: int):
    """The WARC records of one page as (text, sequence) pairs."""
    import re

    page_id, url, html, digest, copies, keeper, kept_elsewhere, serial = row
    name = record_name(page_id, digest)
    if copies > 1:
        name = f"{name[:-1]}:copy{serial}>"
    clean_url = re.sub(r"[\r\n]", " ", url) if url is not None else None
    common = [
        ("WARC-Target-URI", clean_url),
        ("WARC-Date", "2020-01-01T00:00:00Z"),
        ("X-Page-Id", page_id),
        ("WARC-Payload-Digest", "sha1:" + _base32(digest)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if kept_elsewhere:
        headers = [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", name),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_name(keeper, digest)),
            ("X-Refers-To-Page", keeper),
        ]
        yield _record(headers + common, http_block(None, chunk_bytes)), 1
        return
    block = http_block(html or "", chunk_bytes)
    segments = _pieces(block, segment_bytes)
    if len(segments) == 1:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name)] + common, block), 1
        return
    total = sum(map(len, segments))
    for k, part in enumerate(segments, 1):
        if k == 1:
            headers = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
        else:
            headers = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"{name[:-1]}:{k}>"),
                ("WARC-Segment-Origin-ID", name),
                ("X-Page-Id", page_id),
                ("WARC-Segment-Total-Length", total if k == len(segments) else None),
            ]
        yield _record([*headers, ("WARC-Segment-Number", k)], part.decode()), k


def write_archives(
    pages: DataFrame,
    folder: str,
    min_revisit: int = 0,
    segment_bytes: int = 256 << 10,
    chunk_bytes: int = 16 << 10,
    file_bytes: int = 16 << 20,
) -> None:
    """Write a record per page (more for segmented ones) below ``folder``."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    spark = pages.sparkSession
    facts = rows.groupBy("page_id", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    facts = staged(spark, facts, "warc-facts")
    keepers = facts.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("keeper"))
    facts = facts.join(keepers, "digest", "left").withColumn(
        "elsewhere", (F.col("bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    )
    total = facts.agg(F.sum((F.col("bytes") + 1024) * F.col("copies"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    f = facts.where("elsewhere or copies > 1").select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "copies", "keeper", "elsewhere"
    )
    # few enough marks go to where the pages are; otherwise both sides are shuffled
    if f.count() <= BROADCAST_MARKS:
        f = F.broadcast(f)
    marked = rows.join(f, rows["page_id"].eqNullSafe(f["_page"]) & (rows["digest"] == f["_digest"]), "left")
    marked = marked.select(
        "page_id",
        "url",
        "html",
        "digest",
        F.coalesce("copies", F.lit(1)).alias("copies"),
        "keeper",
        F.coalesce("elsewhere", F.lit(False)).alias("elsewhere"),
        F.monotonically_increasing_id().alias("serial"),
    )

    def records(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(c) for c in range(batch.num_columns)]
            texts, places = [], []
            for k in range(batch.num_rows):
                for text, n in page_records([c[k].as_py() for c in columns], segment_bytes, chunk_bytes):
                    texts.append(text)
                    places.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(places, pa.int32())], ["value", "n"])

    out = marked.mapInArrow(records, "value string, n int")
    out.repartition(files, F.xxhash64("value")).select("value").write.option("compression", "gzip").option("lineSep", CRLF * 2).text(folder)


def parse_records(data: bytes):
    """(headers with lower-case names, block) of every record of an archive."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict((k.lower(), v.strip()) for k, v in (x.split(":", 1) for x in lines[1:]))
        start = head_end + 4
        end = start + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")
        yield headers, data[start:end]
        at = end + 4


def read_records(spark, folder: str) -> DataFrame:
    """All records below ``folder``, one row each."""

    def parse(batches):
        import gzip

        import pyarrow as pa

        def number(headers, key):
            return int(headers[key]) if key in headers else None

        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, block in parse_records(gzip.decompress(data.as_py())):
                    rows.append(
                        (
                            h["warc-record-id"],
                            h["warc-type"],
                            number(h, "warc-segment-number"),
                            h.get("warc-segment-origin-id"),
                            number(h, "warc-segment-total-length"),
                            number(h, "x-page-id"),
                            h.get("warc-refers-to"),
                            number(h, "x-refers-to-page"),
                            h.get("warc-payload-digest"),
                            block,
                        )
                    )
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                kinds += [pa.int64(), pa.string(), pa.binary()]
                names = [x.split()[0] for x in RECORDS.split(", ")]
                for k in range(0, len(rows), 500):
                    columns = zip(*rows[k : k + 500])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(parse, RECORDS)


def reassemble(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per page: record_id, page_id, kind, refers_to, refers_page, payload facts.

    A group whose segments are not 1..n, or whose bytes differ from the total length, or
    whose payload does not have the recorded digest, fails the job.
    """
    part = F.struct("segment", "block")
    single = records.where(F.col("segment").isNull())
    split = records.where(F.col("segment").isNotNull())
    groups = split.groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        F.max(F.when(F.col("segment") == 1, F.col("kind"))).alias("kind"),
        F.max("total").alias("total"),
        F.max("page_id").alias("page_id"),
        F.max("digest").alias("digest"),
        F.sort_array(F.collect_list(part)).alias("parts"),
    )
    whole = groups.select(
        "record_id",
        "kind",
        "page_id",
        F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("long").alias("refers_page"),
        "digest",
        "total",
        "parts",
    )
    plain = single.select(
        "record_id", "kind", "page_id", "refers_to", "refers_page", "digest", F.octet_length("block").cast("long").alias("total"),
        F.array(F.struct(F.lit(1).alias("segment"), F.col("block").alias("block"))).alias("parts"),
    )

    def join(batches):
        import base64
        import hashlib

        import pyarrow as pa

        for batch in batches:
            sizes, digests, payloads = [], [], []
            for kind, digest, total, parts in zip(*(batch.column(c).to_pylist() for c in ("kind", "digest", "total", "parts"))):
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    raise ValueError("segments are missing")
                block = b"".join(p["block"] for p in parts)
                if len(block) != total:
                    raise ValueError("segments do not add up to the total length")
                if kind == "revisit":
                    sizes.append(None)
                    digests.append(digest)
                    payloads.append(None)
                    continue
                payload = unchunk(block)
                own = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if own != digest:
                    raise ValueError("payload does not have the recorded digest")
                sizes.append(len(payload))
                digests.append(own)
                payloads.append(payload)
            columns = [batch.column(c) for c in keep] + [pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
            names = [*keep, "payload_bytes", "digest"]
            if with_payload:
                columns.append(pa.array(payloads, pa.binary()))
                names.append("payload")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    keep = ["record_id", "kind", "page_id", "refers_to", "refers_page"]
    schema = (
        "record_id string, kind string, page_id long, refers_to string, refers_page long, payload_bytes long, digest string"
        + (", payload binary" if with_payload else "")
    )
    return plain.unionByName(whole).mapInArrow(join, schema)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    write_archives(pages, folder, **options)
    found = staged(spark, reassemble(read_records(spark, folder)), "warc-pages")
    sizes = found.where(F.col("kind") == "response").groupBy("digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = found.where(F.col("kind") == "revisit").drop("payload_bytes").join(sizes, "digest", "left")
    both = found.where(F.col("kind") == "response").unionByName(revisits)
    return both.select(
        "page_id",
        "payload_bytes",
        F.substring_index("digest", ":", -1).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_page").alias("refers_to"),
    )
