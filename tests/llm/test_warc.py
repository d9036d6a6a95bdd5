import hashlib
import struct

import pytest
import zstandard

from notegrid.llm import warc

PAGES = "page_id long, url string, html string, digest string, first long"


def test_round_trip(spark):
    same, small = "<p>" + "same " * 50, "tiny"
    rows = [(3, "http://a/", same), (1, "http://a/\r\nX: y", same), (2, None, same), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""),
            (None, "u", same), (8, "u", "ü" * 60_000), (9, "u", "line\r\n\r\nbreak" * 30), (1, "again", same), (None, "v", "none has an id " * 9),
            (None, "w", "none has an id " * 9)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)
    got = sorted(warc.round_trip(df).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes))
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        lead = first.get(data)
        revisit = lead is not None and lead != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [tuple(r) for r in got] == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_small_archives_hold_a_dictionary_and_one_frame_per_record(spark):
    df = spark.createDataFrame([(i, "u", f"<p>{i} " * 400, None, None) for i in range(40)], PAGES)
    archives = warc.write_archives(df.repartition(1), archive_bytes=4_000).collect()
    assert len(archives) > 1
    for a in archives:
        spans = list(warc.frames(bytes(a.content)))
        assert spans[0][2] == warc.DICTIONARY_MAGIC and all(m == warc.FRAME_MAGIC for *_, m in spans[1:])
        assert len(list(warc.records(bytes(a.content)))) == len(spans) - 1


def archive(record: bytes, packed=False) -> bytes:
    words = zstandard.ZstdCompressionDict(b"WARC/1.1 some words that serve as a dictionary " * 20)
    held = zstandard.ZstdCompressor().compress(words.as_bytes()) if packed else words.as_bytes()
    return struct.pack("<II", warc.DICTIONARY_MAGIC, len(held)) + held + zstandard.ZstdCompressor(dict_data=words).compress(record)


def test_faults_are_named():
    good = warc.record_bytes("response", "urn:page:1:x", "u", b"abc", 3, hashlib.sha256(b"abc").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert [r["payload"] for r in warc.records(archive(good))] == [b"abc"]
    assert [r["payload"] for r in warc.records(archive(good, packed=True))] == [b"abc"]
    for bad, fault in ((good.replace(b"abc", b"abd"), "digest"), (good[:-1], "length"), (good.replace(b"WARC/1.1", b"HTTP/1.1", 1), "header"),
                       (good.replace(b"WARC-Date", b"X-Date"), "missing"), (good.replace(b"Content-Length: 3", b"Content-Length: 9"), "length")):
        with pytest.raises(ValueError, match=fault):
            list(warc.records(archive(bad)))
    whole = archive(good)
    for data, fault in ((whole[:-3], "cut off"), (whole[8 + struct.unpack_from("<II", whole)[1]:], "dictionary"), (b"junkjunk" + whole, "no frame")):
        with pytest.raises(ValueError, match=fault):
            list(warc.records(data))
