"""WARC archives compressed with an embedded Zstandard dictionary, and their reader.

A dictionary is trained on a bounded sample of the records; every archive starts with a skippable frame that holds it,
and each record follows as a frame of its own, so records stay addressable. Archives are written by Spark's text writer
to any store it knows: a row is a frame, and the "line separator" is an empty skippable frame, which decoders pass over.
An archive ends at ARCHIVE_ROWS rows or ARCHIVE_BYTES of records, whichever comes first (short ones are filled up with
separators), so an archive and the memory of the task that reads it are bounded by those or by the longest record.

Equal payloads of at least `least` bytes are stored once: the record of the largest id is the response, the others are
revisits that refer to it. Defined cases: a null payload is empty; a null id ranks below all others and reads back as
null; of repeated rows one is the response; a null or odd URL becomes a urn or is percent-encoded; an empty table writes
no archive and reads back as no record. Only id, url and payload columns are read. Files carry the writer's names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import lookup_groups, scratch_path

#: Payloads shorter than this are always stored.
LEAST_BYTES = 1000
ARCHIVE_ROWS = 1024
ARCHIVE_BYTES = 24 << 20
#: Records that the dictionary is trained on, at most, and the bytes of each.
SAMPLE_ROWS = 600
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 96 << 10
LEVEL = 6
#: Magic of the dictionary's skippable frame, and an empty skippable frame as text.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\0\0\0\0"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, tag: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{tag}')}>"


def record(page_id: int | None, tag: int, url: str | None, payload: bytes, first: tuple[int | None, int] | None) -> bytes:
    """One WARC/1.1 record; first: id and tag of the response that a revisit refers to."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, tag)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if first:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(*first)}"]
        if first[0] is not None:
            head.append(f"X-Refers-To-Page-ID: {first[0]}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not first:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream):
    """(headers, block) of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        left, parts = int(headers["content-length"]), []
        while left:
            part = stream.read(left)
            if not part:
                raise ValueError("a record ends early")
            parts.append(part)
            left -= len(part)
        yield headers, b"".join(parts)


def train(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of the samples; empty where they are too few for one."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def _decisions(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """tag, id, url, body, first_id, first_tag of every row; the last two are null for responses."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("tag"),
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("body"),
    ).withColumn("digest", F.sha1("body"))
    rank = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("rank"), "tag")
    large = F.octet_length("body") >= least
    whole = rows.agg(F.count("*").alias("n")).first()["n"]
    groups = rows.filter(large).groupBy("digest").agg(F.count("*").alias("n"), F.max(rank).alias("best"), F.max("id").alias("first_id"))
    groups = groups.filter("n > 1").select("digest", "n", "first_id", F.col("best.tag").alias("first_tag"))
    found = lookup_groups(rows, groups, "digest", "n", whole)
    other = F.col("first_tag") != F.col("tag")
    return found.select(
        "tag", "id", "url", "body", F.when(other, F.col("first_id")).alias("first_id"), F.when(other, F.col("first_tag")).alias("first_tag")
    )


def _frames(dictionary: bytes):
    """Kernel: rows of archives, frame by frame; every ARCHIVE_ROWS rows make one archive."""

    def run(batches):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data:
            data.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True)
        rows, size = 0, 0
        for batch in batches:
            ids, tags, urls, bodies, firsts, first_tags = (batch.column(k) for k in ("id", "tag", "url", "body", "first_id", "first_tag"))
            out = []
            for i in range(batch.num_rows):
                first_tag = first_tags[i].as_py()
                first = None if first_tag is None else (firsts[i].as_py(), first_tag)
                raw = record(ids[i].as_py(), tags[i].as_py(), urls[i].as_py(), bodies[i].as_py(), first)
                if rows and size + len(raw) > ARCHIVE_BYTES:
                    out += [b""] * (ARCHIVE_ROWS - rows)
                    rows = 0
                if rows == 0:
                    out.append(dictionary_frame(dictionary))
                    rows, size = 1, 0
                out.append(press.compress(raw))
                rows, size = (rows + 1) % ARCHIVE_ROWS, size + len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES) -> None:
    """Write a record for every row of `pages` into archives below `path`."""
    rows = _decisions(pages, id_col, url_col, payload_col, least)
    total = pages.count()
    every = max(1, total // SAMPLE_ROWS)
    picked = F.pmod(F.xxhash64(id_col, F.lit("dictionary")), F.lit(every)) == 0
    body = F.substring(F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8"), 1, SAMPLE_BYTES)
    sample = pages.filter(picked).select(id_col, url_col, body).limit(2 * SAMPLE_ROWS).collect()
    samples = sorted(record(r[0], 0, r[1], bytes(r[2] or b""), None) for r in sample)
    frames = rows.mapInArrow(_frames(train(samples)), "frame binary")
    text = frames.select(F.col("frame").cast("string").alias("value"))
    text.write.option("maxRecordsPerFile", ARCHIVE_ROWS).option("lineSep", EMPTY_FRAME).text(path)


def open_archive(content: bytes):
    """The uncompressed stream of an archive, its dictionary taken from the leading skippable frame."""
    dictionary, at = None, 0
    if len(content) >= 8:
        magic, size = struct.unpack_from("<II", content)
        if magic == DICTIONARY_MAGIC:
            at = 8 + size
            raw = content[8:at]
            if raw[:4] == b"\x28\xb5\x2f\xfd":
                raw = zstandard.ZstdDecompressor().decompress(raw)
            dictionary = zstandard.ZstdCompressionDict(raw)
    press = zstandard.ZstdDecompressor(dict_data=dictionary)
    return io.BufferedReader(press.stream_reader(io.BytesIO(memoryview(content)[at:]), read_across_frames=True), 1 << 16)


def _read(batches):
    for batch in batches:
        contents = batch.column(0)
        rows = []
        for i in range(batch.num_rows):
            for headers, block in read_records(open_archive(contents[i].as_py())):
                head, _, payload = block.partition(b"\r\n\r\n")
                kind = headers["warc-type"]
                digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"record {headers['warc-record-id']} has another payload than it says")
                size = len(payload) if kind == "response" else int(re.search(rb"Content-Length: (\d+)", head)[1])
                page_id, first = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                rows.append((None if page_id is None else int(page_id), size, digest, kind, None if first is None else int(first)))
                if len(rows) >= 2048:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows):
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below `path`; payloads of responses are checked against their digests."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, _SCHEMA)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` to archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
