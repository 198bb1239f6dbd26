import base64
import hashlib
import struct

import pytest
import zstandard

from packetsieve.llm import warc


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/?q=1\r\nX: y", "<p>é</p>", "x"), (5, None, "<p>é</p>", "x"), (3, "u", None, "x"), (2, "u", "", "x")]
    rows += [(7, "u", "a\r\n\r\nWARC/1.1\r\n" * 5, "x"), (None, "u", "<p>é</p>", "x"), (9, "u", "z" * 3_000_000, "x"), (9, "u", "z" * 3_000_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = [tuple(r) for r in warc.round_trip(pages).drop("url").collect()]
    largest = {}
    for i, _, html, _ in rows:
        key = html or ""
        largest[key] = max(largest.get(key, -1), -1 if i is None else i)
    expected = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        head = largest[html or ""]
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if i == head else ("revisit", head))))
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def records(n=300):
    return [warc.record(i, f"http://site/{i}", f"<html>page {i} of many</html>".encode() * 20, "", None) for i in range(n)]


def good(i, payload):
    return warc.record(i, "u", payload, warc.digest_of(payload), None)


def test_archive_starts_with_its_dictionary_and_has_a_frame_per_record():
    content = warc.pack_archive(records())
    magic, size = struct.unpack_from("<II", content)
    assert magic == warc.DICTIONARY_FRAME
    assert zstandard.ZstdDecompressor().decompress(content[8 : 8 + size])[:4] == b"\x37\xa4\x30\xec"
    assert list(warc.unpack_archive(content)) == records()
    assert list(warc.unpack_archive(warc.pack_archive(records(2)))) == records(2)
    for broken in (content[:-3], content[: 8 + size - 1], content + b"junk", content[: 8 + size] + b"\0" + content[8 + size :]):
        with pytest.raises(ValueError):
            list(warc.unpack_archive(broken))


@pytest.mark.parametrize(
    ("old", "new"),
    [
        (b"WARC/1.1", b"WARC/0.9"),
        (b"WARC-Date: ", b"X-Date: "),
        (b"Content-Length: 3\r\n", b"Content-Length: 4\r\n"),
        (b"Content-Length: ", b"Content-Size: "),
        (b"WARC-Type: response", b"WARC-Type: other"),
        (b"abc", b"abd"),
        (b"WARC-Target-URI: u", b"no colon"),
        (b"\r\n\r\n", b"\r\n"),
    ],
)
def test_bad_records_raise(old, new):
    raw = good(1, b"abc")
    assert warc.parse(raw)["page_id"] == 1
    with pytest.raises(ValueError):
        warc.parse(raw.replace(old, new))
    with pytest.raises(ValueError):
        warc.parse(raw + raw)
