"""WARC archives: writing with revisits and segments, and reading back.

A record is its header lines, a block and a blank line; Spark's text writer puts records
out with that blank line as its line separator, so the files go wherever Spark can write.
Blocks beyond a size are cut into a first segment and continuation records. The reader
parses records by their stated lengths, groups continuations by the identifier of their
origin, orders them by segment number, verifies the total length and decodes the chunked
transfer framing of the HTTP response within.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.frames import pick, settle

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_BARE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_END = "\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, sha: str) -> str:
    """The same for a page and payload on every run: a revisit can name a response written elsewhere."""
    return uuid.UUID(hashlib.md5(f"{page_id}|{sha}".encode()).hexdigest()).urn


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at:at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response, chunked or not."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}".encode() for k, v in headers if v is not None]
    return b"\r\n".join([VERSION, *lines, b"Content-Length: %d" % len(block), b"", block])


def page_records(page_id, url: str | None, payload: bytes, kind: str, refers_page, date: str,
                 segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    sha = digest(payload)
    own = record_id(page_id, sha)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    shared = [("WARC-Date", date), ("WARC-Target-URI", uri or None), ("WARC-Payload-Digest", f"sha1:{sha}"),
              ("WARC-Page-ID", page_id), ("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{own}>"), *shared, ("WARC-Profile", PROFILE),
                        ("WARC-Refers-To", f"<{record_id(refers_page, sha)}>")], HTTP_BARE)]
    block = HTTP_HEAD + chunked(payload, chunk_bytes)
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{own}>"), *shared,
                   ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        out.append(record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.UUID(own[9:]), str(n)).urn}>"),
             ("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<{own}>"), ("WARC-Segment-Number", n),
             ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part))
    return out


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", min_revisit_bytes: int = 0, segment_bytes: int = 16_384,
                  chunk_bytes: int = 4_096, records_per_file: int = 2_000,
                  date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for every row of ``pages`` into WARC files at ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` the one with the largest id is a
    response and the others are revisits to it; smaller payloads are all responses. Rows
    that repeat the largest id with the same payload are responses too. Null html is an empty
    payload. Null ids are smaller than all others; if a payload has only these, they are responses.
    A null or empty url is left out. A file holds at most ``records_per_file`` records and so a
    bounded number of bytes, however long the pages are. Files are gzip-compressed as a whole. Columns beyond
    the three named ones are not read. Empty tables give an archive without records.

    Work: a narrow aggregation finds the largest id of each payload, and one join brings it to the
    pages. A payload that many pages share is one row there, and Spark splits the skewed side.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    rows = rows.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary")).drop("html")
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    best = (rows.where(F.col("n") >= min_revisit_bytes).groupBy("sha")
            .agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("alike")))
    joined = rows.join(best, "sha", "left")
    again = (F.col("n") >= min_revisit_bytes) & ~F.col("best").eqNullSafe(F.col("page_id"))
    joined = joined.select("page_id", "url", "payload", "best", F.coalesce(again, F.lit(False)).alias("again"))

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, url, payload, best_id, revisit in zip(
                    *[batch.column(i).to_pylist() for i in range(5)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(page_records(
                    page_id, url, payload, "revisit" if revisit else "response", best_id, date,
                    segment_bytes, chunk_bytes), pa.binary())], names=["record"])

    (joined.mapInArrow(written, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file)
     .option("compression", "gzip").text(path))


def unpacked(data: bytes) -> bytes:
    """All members of a gzip file one after the other; of a damaged file, what comes before the damage."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data if member.eof else b""
    return b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields (names in lower case) and block of each record of a WARC file, compressed by record, by file, or not.

    A block that is cut off is None. Where no record can start, reading goes on at the next one that does."""
    if data[:2] == b"\x1f\x8b":
        data = unpacked(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        fields = {}
        if end >= 0 and data.startswith(b"WARC/", at):
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = whole_number(fields.get("content-length"))
        stop = None if size is None else end + 4 + size
        after = None if stop is None or stop > len(data) else data[stop:stop + 4]
        if "warc-type" not in fields or after not in (b"", b"\r\n", b"\r\n\r\n"):
            if size is not None and "warc-type" in fields:  # cut off, or its length is wrong: the block is not known
                yield fields, None
            at = data.find(b"\r\n\r\nWARC/", at + 1)
            if at < 0:
                return
            at += 4
            continue
        yield fields, data[end + 4:stop]
        at = stop + 4


def whole_number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def payload_of(block: bytes | None) -> tuple[int | None, str | None]:
    """Size and digest of a response's payload; unknown where the block is cut off or its framing is damaged."""
    if block is None:
        return None, None
    try:
        payload = http_payload(block)
    except ValueError:
        return None, None
    return len(payload), digest(payload)


READ = ("kind string, record_id string, origin string, segment int, total long, page_id {id}, digest string, "
        "refers string, payload_bytes long, found_digest string, block binary")
READ_FIELDS = [f.split()[0] for f in READ.split(", ")]


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint", files_like: str = "part-*") -> DataFrame:
    """One row per page record of the WARC files at ``path``, segments put together again.

    Columns ``page_id, payload_bytes, payload_digest, record_type, refers_to, complete``. The
    digest is computed from the payload as reassembled and unchunked, for a revisit that of the
    response it refers to. ``complete`` says that all segments were there, that they add up to the
    stated total length and that the payload has the digest its record states; a record that
    fails (cut off, wrong lengths, broken chunks, a segment lost) has null for what is not known, and the others
    are read. Archives of others are read too; their records have a null ``page_id``. No files give no rows.

    Work: records that are not segmented are decoded where they are read. Segments meet by origin,
    one payload in a group, and revisits meet their responses by record identifier.
    """
    kind = pa.string() if id_type == "string" else pa.int64()
    types = [pa.string()] * 3 + [pa.int32(), pa.int64(), kind, pa.string(), pa.string(), pa.int64(), pa.string(),
                                 pa.binary()]

    def rows_of(fields: dict[str, str], block: bytes) -> tuple:
        number = whole_number(fields.get("warc-segment-number"))
        page = fields.get("warc-page-id")
        if page is not None and id_type != "string":
            page = int(page) if re.fullmatch(r"-?[0-9]{1,18}", page) else None
        row = [fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-segment-origin-id"),
               number, whole_number(fields.get("warc-segment-total-length")), page,
               fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, fields.get("warc-refers-to")]
        if number:
            return *row, None, None, block
        if fields["warc-type"] != "response":
            return *row, None, None, None
        return *row, *payload_of(block), None

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(zip(*[rows_of(f, b) for f, b in parsed(content.as_py())], strict=True))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=READ_FIELDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", files_like).load(path)
    records = settle(files.select("content").mapInArrow(read, READ.format(id=id_type)))
    parts = (records.where("segment is not null")
             .groupBy(F.coalesce("origin", "record_id").alias("record_id"))
             .agg(F.collect_list(F.struct("segment", "total", "block")).alias("parts"),
                  F.max("page_id").alias("page_id"), F.max("digest").alias("digest"),
                  F.count(F.when(F.col("segment") == 1, 1)).alias("times")))

    def join_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces in batch.column("parts"):
                own = {p["segment"]: p for p in pieces.as_py()}
                numbers = sorted(own)
                there = all(own[n]["block"] is not None for n in numbers)
                block = b"".join(own[n]["block"] for n in numbers) if there else b""
                whole = there and numbers == list(range(1, len(numbers) + 1)) and own[numbers[-1]]["total"] == len(block)
                out.append(payload_of(block if whole else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("record_id", "page_id", "digest", "times")]
                + [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())],
                names=["record_id", "page_id", "digest", "times", "payload_bytes", "found_digest"])

    joined = parts.mapInArrow(join_up, f"record_id string, page_id {id_type}, digest string, times long, "
                                       "payload_bytes long, found_digest string")
    joined = joined.withColumn("times", F.explode(F.sequence(F.lit(1), F.greatest("times", F.lit(1)))))
    kept = ["record_id", "page_id", "digest", "payload_bytes", "found_digest"]
    responses = records.where("segment is null and kind = 'response'").select(kept).unionByName(joined.select(kept))
    named = responses.groupBy(F.col("record_id").alias("refers")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"),
        F.max("found_digest").alias("found_digest"))
    revisits = records.where("kind = 'revisit'").select("refers", "page_id", "digest").join(named, "refers", "left")
    whole = F.coalesce(F.col("found_digest") == F.col("digest"), F.lit(False)).alias("complete")
    return (responses.select("page_id", "payload_bytes", F.col("found_digest").alias("payload_digest"),
                             F.lit("response").alias("record_type"), F.lit(None).cast(id_type).alias("refers_to"), whole)
            .unionByName(revisits.select("page_id", "payload_bytes", F.col("found_digest").alias("payload_digest"),
                                         F.lit("revisit").alias("record_type"), "refers_to", whole)))
