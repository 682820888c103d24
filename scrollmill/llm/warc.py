"""WARC archives in zstandard, with revisit records for equal payloads.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds its dictionary, raw or
itself a zstandard frame; every record is one frame compressed with it. The reader loads the dictionary,
decodes frame by frame, and validates versions, header lines, lengths and digests.

Of pages with equal payloads of `min_bytes` or more, that of the smallest page_id is a response, the
others are revisits of it, whose records keep the HTTP header (with the payload's length) and not the payload.

Rows: a null html is an empty payload; a null url is written as an empty target; a null page_id counts as
the largest and is read back as null; rows of equal page_id and payload are alike, so all of the smallest
page_id are responses. An empty table gives no archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollmill.llm.common import id_last, join_hot, keep, new_folder, open_store, put_file, table

DICT_MAGIC = 0x184D2A5D
DICT_BYTES = 64_000
MIN_BYTES = 0
#: A record may hold this many bytes; a frame whose header says more is refused before it is decoded, one that says nothing when it has given more.
MOST_RECORD = 1 << 31
DATE = "2024-01-01T00:00:00Z"
NO_ID = 2**63 - 1


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One response or revisit record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    target = "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(out, records, dictionary: bytes, level: int = 3) -> int:
    """Write the dictionary frame and one frame per record."""
    packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
    out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=level)
    press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_checksum=True)
    n = 0
    for r in records:
        out.write(press.compress(r))
        n += 1
    return n


def read_archive(source):
    """Yield (headers, block) of each record."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICT_MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    size = struct.unpack("<I", head[4:])[0]
    raw = source.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary frame is cut")
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=MOST_RECORD)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    pending = b""
    while True:
        pending = pending or source.read(1 << 20)
        if not pending:
            return
        while len(pending) < 18 and (more := source.read(1 << 20)):  # a frame header has 18 bytes at most
            pending += more
        declared = zstandard.get_frame_parameters(pending).content_size
        if declared != zstandard.CONTENTSIZE_UNKNOWN and declared > MOST_RECORD:
            raise ValueError("a record is too long")
        frame, decoded = unpress.decompressobj(), io.BytesIO()
        while True:
            decoded.write(frame.decompress(pending))
            if decoded.tell() > MOST_RECORD:
                raise ValueError("a record is too long")
            if frame.eof:
                pending = frame.unused_data
                break
            pending = source.read(1 << 20)
            if not pending:
                raise ValueError("the last frame is cut")
        yield parse_record(decoded.getvalue())


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Validate one record: version, header lines, Content-Length, ending and block digest."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record has no end of headers")
    lines = data[:end].decode().split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"a record lacks {name}")
    if not headers["content-length"].isdigit() or len(data) != end + 4 + int(headers["content-length"]) + 4 or data[-4:] != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    block = data[end + 4 : -4]
    if headers.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise ValueError("a record fails its block digest")
    return headers, block


def parse_page(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), checked against the payload."""
    page = lambda v: int(v[10:-1]) if v[10:-1] else None
    end = block.find(b"\r\n\r\n")
    if end < 0 or not block.startswith(b"HTTP/1."):
        raise ValueError("a record's block is not an HTTP response")
    length = next(int(x.split(b":")[1]) for x in block[:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response":
        payload = block[end + 4 :]
        if len(payload) != length or base32_sha1(payload) != digest:
            raise ValueError("a payload differs from its length or digest")
        return page(headers["warc-record-id"]), length, digest, "response", None
    if len(block) != end + 4 or "warc-refers-to" not in headers:
        raise ValueError("a revisit record holds a payload or refers to nothing")
    return page(headers["warc-record-id"]), length, digest, "revisit", page(headers["warc-refers-to"])


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html), one archive per partition; returns (file, records).

    Only ids and digests are grouped to find equal payloads; digests that many pages share are joined where
    the pages lie. The pages meet their revisit target by page_id and digest, which only rows alike share.
    """
    bare = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    marks = bare.select(id_last("page_id").alias("page"), F.sha1("payload").alias("sha1"), F.length("payload").alias("n"))
    firsts = marks.filter(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("n")).filter("first < last").select("sha1", "first", "n")
    revisits = join_hot(marks.drop("n"), keep(firsts, "firsts"), "sha1", "n").filter("page <> first").select(F.col("page").alias("_page"), F.col("sha1").alias("_sha1"), "first").distinct()
    whole = bare.withColumn("_page", id_last("page_id")).withColumn("_sha1", F.sha1("payload")).join(revisits, ["_page", "_sha1"], "left")
    rows = whole.select("page_id", "url", "payload", F.col("first").alias("refers"))

    def archive(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        # The dictionary is a bounded sample of this archive's own payloads.
        sample = [p for p in first.column(2).slice(0, 200).to_pylist() if p]
        share = max(256, DICT_BYTES // max(1, len(sample)))
        dictionary = (b"".join(p[:share] for p in sample) or b"WARC/1.1\r\n")[-DICT_BYTES:]

        def records():
            batch = first
            while batch is not None:
                for page, url, payload, refers in zip(*[c.to_pylist() for c in batch.columns]):
                    yield record(page, url, payload, base32_sha1(payload), refers)
                batch = next(batches, None)

        name, n = f"pages-{TaskContext.get().partitionId():06d}.warc.zst", []
        put_file(folder, name, lambda out: n.append(write_archive(out, records(), dictionary)))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array(n, pa.int64())], names=["file", "records"])

    spark = pages.sparkSession
    path = folder + "-files"
    rows.mapInArrow(archive, "file string, records long").write.parquet(path)
    return spark.read.schema("file string, records long").parquet(path)


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for name, n in zip(*[c.to_pylist() for c in batch.columns]):
                store, path = open_store(f"{folder}/{name}")
                with store.open_input_stream(path, compression=None) as source:
                    rows = [parse_page(*r) for r in read_archive(source)]
                if len(rows) != n:
                    raise ValueError(f"{name} has {len(rows)} records, {n} were written")
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    n = max(1, min(files.count(), 4 * files.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(n, "file").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
bits AS (
  SELECT DISTINCT d, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST('0b' || substr(b, 5 * CAST(i AS INT) + 1, 5) AS INT), 1)), '') AS b32
  FROM (SELECT d, array_to_string(list_transform(string_split(d, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * CAST(instr('0123456789abcdef', c) - 1 AS INT) + 1, 4)), '') AS b FROM h)
), f AS (SELECT d, min(page_id) AS first FROM h GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN f USING (d) JOIN bits USING (d)
"""
