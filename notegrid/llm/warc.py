"""WARC archives of Zstandard frames: written with a trained dictionary, read back and checked.

An archive starts with a skippable frame that holds the dictionary; every record after it is one
frame of its own. The reader loads the dictionary from there, decodes frame by frame, and checks
version, header fields, lengths, record ends and payload digests.

Records with equal payloads of at least ``least`` bytes are stored once: the one with the smallest
page_id is a response, the others revisit it. Rows that share that smallest page_id are all
responses. Rows without a page_id are a response only if no row with that payload has one. Null html
is an empty payload, a null url leaves its header out.

Archives are rows (path, content) of bounded size, the columns of Spark's binaryFile source, so they
are written by Spark to any store it reaches, and files read by that source go to the same reader.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import stored
from notegrid.session import broadcast_if_small

# Frame magics, the record version and header names of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

RECORD = ("archive string, at long, record_type string, record_id string, url string, payload binary, payload_bytes long, "
          "payload_digest string, refers_to string")


def train(pages: DataFrame, samples: int = 300, size: int = 16_384) -> bytes:
    """A dictionary from at most ``samples`` pages of under 64 KB, chosen by a hash over all rows."""
    import zstandard
    known = pages.filter("octet_length(html) BETWEEN 1 AND 65536")
    count = known.count()
    share = min(1.0, 2 * samples / max(count, 1))
    held = (known.filter(F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 30)) < int(share * (1 << 30)))
            .select("html").limit(samples).collect())
    texts = sorted(r.html.encode() for r in held)
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too little to train on: plain content serves as a dictionary too
        return (b"".join(texts)[-size:] or b"WARC/1.1 Content-Length: Content-Type: text/html")


def _header(fields: list[tuple[str, str]]) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields)]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def record_bytes(kind: str, record_id: str, url: str | None, payload: bytes, length: int, digest: str,
                 refers_to: str | None, date: str) -> bytes:
    block = HTTP_HEAD % length + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(start, end, magic) of each frame, found from frame and block headers without decoding."""
    at = 0
    while at < len(data):
        start = at
        if len(data) < at + 8:
            raise ValueError(f"frame at {start} is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
        elif magic == FRAME_MAGIC:
            flags = data[at + 4]
            single = flags >> 5 & 1
            at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = False
            while not last:
                if len(data) < at + 3:
                    raise ValueError(f"frame at {start} is cut off")
                head = int.from_bytes(data[at:at + 3], "little")
                last, kind, length = head & 1, head >> 1 & 3, head >> 3
                if kind == 3:
                    raise ValueError(f"frame at {start} has a block of a reserved kind")
                at += 3 + (1 if kind == 1 else length)
            at += 4 * (flags >> 2 & 1)
        else:
            raise ValueError(f"no frame at {start}")
        if at > len(data):
            raise ValueError(f"frame at {start} is cut off")
        yield start, at, magic


def parse_record(data: bytes) -> dict:
    """Fields and payload of one record; ValueError on anything that does not fit."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no record header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:60]!r}")
        fields[name.strip().lower().decode()] = value.strip().decode()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"missing header fields: {sorted(missing)}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content length {size} does not fit a block of {len(rest) - 4}")
    block = rest[:size]
    payload, length = block, size
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise ValueError("no HTTP header")
        named = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        length = int(named[0]) if named else len(payload)
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
    if fields["warc-type"] == "response":
        if length != len(payload):
            raise ValueError(f"HTTP length {length} does not fit a payload of {len(payload)}")
        if digest and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload digest does not fit")
    strip = lambda x: None if x is None else x.strip("<>")
    return {"record_type": fields["warc-type"], "record_id": strip(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
            "payload": payload if fields["warc-type"] != "revisit" else None, "payload_bytes": length,
            "payload_digest": digest, "refers_to": strip(fields.get("warc-refers-to"))}


def records(data: bytes) -> Iterator[dict]:
    """All records of an archive, in order, each with its frame's place ``at``."""
    import zstandard
    reader = None
    for start, end, magic in frames(data):
        if start == 0:
            if magic != DICTIONARY_MAGIC:
                raise ValueError("no dictionary in the leading frame")
            content = data[8:end]
            if content[:4] == struct.pack("<I", FRAME_MAGIC):  # it may itself be compressed
                content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        elif magic == FRAME_MAGIC:
            whole = reader.decompressobj().decompress(data[start:end])
            yield {"at": start, **parse_record(whole)}


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of (path, content) rows. A broken archive stops the read, naming archive and fault."""
    names = [f.split()[0] for f in RECORD.split(", ")]

    def work(batches):
        schema = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                            ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                held, size = [], 0
                try:
                    for record in records(content.as_py()):
                        held.append({"archive": path.as_py(), **record})
                        size += len(record["payload"] or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                except ValueError as error:
                    raise ValueError(f"{path.as_py()}: {error}") from error
                yield pa.RecordBatch.from_pylist(held, schema)
    assert names[0] == "archive"
    return archives.select("path", "content").mapInArrow(work, RECORD)


def record_name(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.substring(digest, 1, 16))


def write_archives(pages: DataFrame, least: int = 100, archive_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z",
                   level: int = 3) -> DataFrame:
    """Archives of all pages as a written table (path, content)."""
    dictionary = train(pages)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
                        F.octet_length(payload).cast("long").alias("length"))
    # Only digests met more than once are looked up; their first page is counted before anything is shuffled.
    first = (rows.filter(F.col("length") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    rows = rows.join(broadcast_if_small(first), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("length") >= least)
    rows = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("kind"), record_name(F.col("page_id"), F.col("digest")).alias("record_id"),
        "url", F.when(~revisit, F.col("payload")).alias("payload"), "length", "digest",
        F.when(revisit, record_name(F.col("first"), F.col("digest"))).alias("refers_to"))

    def work(batches):
        import uuid

        import zstandard
        writer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True,
                                          write_content_size=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        held, size = [lead], len(lead)

        def archive():
            return pa.RecordBatch.from_pydict({"path": pa.array([f"{uuid.uuid4().hex}.warc.zst"]), "content": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for row in batch.to_pylist():
                frame = writer.compress(record_bytes(row["kind"], row["record_id"], row["url"], row["payload"] or b"",
                                                     row["length"], row["digest"], row["refers_to"], date))
                held.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield archive()
                    held, size = [lead], len(lead)
        if len(held) > 1:
            yield archive()
    return stored(rows.mapInArrow(work, "path string, content binary"))


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, all read back from the archives.

    The digest is computed anew from every response's payload; the reader has checked it against the
    header that a revisit record carries alone.
    """
    read = read_archives(write_archives(pages, least))
    number = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as {pages.schema['page_id'].dataType.simpleString()})")
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return read.select(number("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type",
                       number("refers_to").alias("refers_to"))
