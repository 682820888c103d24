import base64
import hashlib
import io

import pytest
import zstandard

from scrollmill.llm import warc
from scrollmill.llm.common import new_folder


def brute(rows, least=0):
    big = lambda p: 2**63 - 1 if p is None else p
    first = {}
    for p, _, h in rows:
        data = (h or "").encode()
        first[data] = min(first.get(data, 2**63 - 1), big(p))
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        own = len(data) < least or first[data] == big(p)
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first[data]))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark):
    rows = [(5, "http://a/ b\r\nX: y", "same"), (3, "http://ü", "same"), (9, None, "same"), (None, "n", "same"), (None, "n", "alone"), (4, "u", None), (2, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "é" * 200_000), (5, "z", "same"), (3, "http://ü", "same"), (10, "x", "tiny"), (11, "x", "tiny")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(4)
    for least in (0, 5):
        folder = new_folder(spark, "w")
        got = warc.read_archives(warc.write_archives(pages, folder, least), folder).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, least)
    folder = new_folder(spark, "w")
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def archive(records, dictionary=b"HTTP/1.1 200 OK\r\nContent-Type: text/html"):
    out = io.BytesIO()
    warc.write_archive(out, records, dictionary)
    return out.getvalue()


def test_reader_validates():
    good = warc.record(1, "http://a", b"payload", warc.base32_sha1(b"payload"), None)
    assert warc.parse_page(*next(warc.read_archive(io.BytesIO(archive([good])))))[0] == 1
    for bad in (good.replace(b"Content-Length: 7", b"Content-Length: 8"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9", 1), good.replace(b"WARC-Date", b"WARC Date;", 1).replace(b":", b"", 1), good.replace(b"payload", b"PAYLOAD")):
        with pytest.raises(ValueError):
            [warc.parse_page(*r) for r in warc.read_archive(io.BytesIO(archive([bad])))]
    data = archive([good, good])
    for broken in (data[4:], data[:-3], b"", data[:20]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(io.BytesIO(broken)))


def test_raw_dictionary_frame_and_split_reads():
    good = warc.record(1, "http://a", b"payload" * 50, warc.base32_sha1(b"payload" * 50), None)
    raw = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; payloadpayload"
    shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frames = b"".join(zstandard.ZstdCompressor(dict_data=shared).compress(good) for _ in range(3))

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(n if n <= 100 else 17)

    data = warc.struct.pack("<II", warc.DICT_MAGIC, len(raw)) + raw + frames
    assert len(list(warc.read_archive(Slow(data)))) == 3
