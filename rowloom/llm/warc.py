"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each archive starts with a skippable frame that holds the dictionary, followed by one frame for each record, so any
record can be read by itself and a file needs nothing beside it. Records with a payload that an earlier record holds
(by SHA-1) are revisits and carry no payload.

Every record is numbered, hashed and compressed once, and only its compressed frame travels from there on. Archives
are rows of one binary column that Spark's own text writer puts into files, one row each: so they go to whatever file
system the folder is on, and a repeated or speculative task commits its files once. The writer ends each row with a
separator, which is set to an empty skippable frame, and names files part-*.txt whatever they hold.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.session import drop_table, materialise, scratch_path

#: Magic numbers of the skippable frame with a dictionary, of other skippable frames but for four bits, and of ordinary frames.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = 0x184D2A50
FRAME = b"\x28\xb5\x2f\xfd"
#: A skippable frame of no bytes: its eight bytes are ASCII, so it can separate the rows of a text file.
EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0)
#: An archive is closed once its compressed size passes this; a task holds one archive at a time.
ARCHIVE_BYTES = 16 << 20
#: Bytes that a reader hands to the decompressor at once: what lies behind a record's end is looked at again.
SLICE = 16 << 10
#: The dictionary is trained on about this many records, more where they are short, and on this many characters of each.
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 16 << 10
#: Size of the dictionary at most; a small sample gives a smaller trained one, of one byte for each SAMPLE_SHARE sampled.
DICTIONARY_BYTES = 64 << 10
SAMPLE_SHARE = 8
#: Fixed value: the least size of a dictionary that the library trains.
LEAST_DICTIONARY = 256
LEVEL = 3
SEED = 3
#: Repeated payloads or revisits up to so many are broadcast (about 64 MB); more are joined by shuffle, the most frequent payloads still by broadcast.
BROADCAST_ROWS, HOT_PAYLOADS = 1_000_000, 1000
#: Fixed value: the profile of revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records carry one date, so that equal pages make equal archives.
DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes | int, payload_digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record with an HTTP response block; a revisit's block stops after the HTTP header, so its payload's size is enough."""
    size = payload if revisit else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields, HTTP header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def read_archive(content) -> Iterator[dict]:
    """The records of one archive (bytes or a buffer), in order; time and memory beside the records do not depend on its size."""
    import zstandard

    view = memoryview(content)
    magic, size = struct.unpack_from("<II", view)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary frame")
    words = bytes(view[8 : 8 + size])
    reader, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None), 8 + size
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0]
        if magic & ~0xF == SKIPPABLE:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(view[at : at + SLICE]))
            at += SLICE
        at = min(at, len(view)) - len(frame.unused_data) if frame.unused_data else min(at, len(view))
        yield parse(b"".join(parts))


def train(samples: list[bytes]) -> bytes:
    """A dictionary of archived records. Records too few or too uniform to train on become the dictionary themselves, as raw content."""
    import zstandard

    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // SAMPLE_SHARE)
    if size >= LEAST_DICTIONARY:
        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def _sampled(pages: DataFrame) -> list[bytes]:
    """About SAMPLE_RECORDS records, or more if these are short: as many as a full dictionary is trained on."""
    n = pages.count()
    wanted, samples = SAMPLE_RECORDS, []
    for _ in range(2):
        rows = pages.select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html"))
        some = rows.sample(False, min(1.0, 1.5 * wanted / max(1, n)), SEED).limit(wanted).collect() or rows.limit(wanted).collect()  # bounded sample
        samples = [record(r.page_id, r.url, p := (r.html or "").encode(), digest(p)) for r in some]
        if not samples or wanted >= n or sum(map(len, samples)) >= SAMPLE_SHARE * DICTIONARY_BYTES:
            break
        each = sum(map(len, samples)) // len(samples)  # a header has some 300 bytes, so under 2,000 records
        wanted = -(-SAMPLE_SHARE * DICTIONARY_BYTES // each)
    return samples


def _compressor(words: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(words)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data)


def _frames(pages: DataFrame, words: bytes) -> DataFrame:
    """(row, page_id, url, digest, size, frame): each page numbered, hashed and compressed as a response."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor(words)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                hashes, sizes, frames = [], [], []
                for page_id, url, html in zip(part.column(1), part.column(2), part.column(3), strict=True):
                    payload = (html.as_py() or "").encode("utf-8")
                    sha = hashlib.sha1(payload).digest()
                    hashes.append(sha)
                    sizes.append(len(payload))
                    frames.append(compressor.compress(record(page_id.as_py(), url.as_py(), payload, base64.b32encode(sha).decode())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(hashes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], names=["row", "page_id", "url", "digest", "size", "frame"])

    numbered = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html")
    return materialise(numbered.mapInArrow(press, "row long, page_id long, url string, digest binary, size long, frame binary"), "frames")


def _revisits(frames: DataFrame, minimum: int) -> DataFrame:
    """(row, first_id) of each record whose payload another one answers: the one with the smallest (page_id, row)."""
    hashed = frames.where(F.col("size") >= minimum).select("row", "page_id", "digest")
    # nulls last: a null page_id is a response only where no other record has the payload
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "row"))
    firsts = materialise(hashed.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    if firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marked = hashed.join(F.broadcast(firsts), "digest")
    else:  # a payload that a large part of the records have stays where it is; none of the others has many
        hot = materialise(firsts.orderBy(F.desc("n"), "digest").limit(HOT_PAYLOADS), "hot")
        rest = hashed.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(firsts, "digest")
        marked = hashed.join(F.broadcast(hot), "digest").unionByName(rest)
    return marked.where(F.col("row") != F.col("first.row")).select("row", F.col("first.page_id").alias("first_id"), F.lit(True).alias("revisit"))


def write(pages: DataFrame, folder: str, minimum: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record for each row of pages(page_id, url, html) to archives in a new folder, of any file system that
    Spark writes to; returns (archive, size) of the files.

    Payload: html in UTF-8, null as empty. Of records with equal payloads of at least `minimum` bytes the one with the
    smallest page_id (null counts as largest, repeated ids go by row) is the response and others revisit it. Null urls
    are about:blank. Other columns are ignored, whatever their names. An empty table writes no archive. A page of any
    length is one record; a task holds one archive, which has archive_bytes and at most one more record.
    The dictionary is trained on a sample of about SAMPLE_RECORDS records, of SAMPLE_BYTES characters of payload each.
    """
    spark = pages.sparkSession
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))
    words = train(_sampled(narrow))
    frames = _frames(narrow, words)
    marks = materialise(_revisits(frames, minimum), "revisits")
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ready = frames.join(F.broadcast(marks) if few else marks, "row", "left").sortWithinPartitions("row")  # a repeated task meets its rows in the same order

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor(words)
        head = struct.pack("<II", DICTIONARY_FRAME, len(words)) + words
        parts, size = [], 0
        for batch in batches:
            ids, urls, hashes, sizes, held, firsts, revisits = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "digest", "size", "frame", "first_id", "revisit"))
            for k in range(batch.num_rows):
                frame = held[k].as_py()
                if revisits[k].as_py():
                    frame = compressor.compress(record(ids[k].as_py(), urls[k].as_py(), sizes[k].as_py(), base64.b32encode(hashes[k].as_py()).decode(), firsts[k].as_py(), True))
                parts.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([head + b"".join(parts)], pa.binary())], names=["archive"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([head + b"".join(parts)], pa.binary())], names=["archive"])

    rows = ready.mapInArrow(archive, "archive binary").select(F.col("archive").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME.decode("ascii")).option("compression", "none").text(folder)
    drop_table(frames)
    drop_table(marks)
    return archives(spark, folder)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, size) of the folder's archives that hold records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.where("length > 0").select(F.col("path").alias("archive"), F.col("length").alias("size"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record in folder's archives.

    payload_bytes and payload_digest are those of the full payload, also for revisits, whose payload is null.
    A response's digest is computed from what was read back and has to equal the recorded one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("path", "content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def number(urn: str | None):
            digits = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
            return int(digits) if digits else None

        for batch in batches:
            for content in batch.column(1):
                rows, size = [], 0
                for r in read_archive(content.as_buffer()):
                    f, payload = r["fields"], r["payload"]
                    kind, known = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != known:
                        raise ValueError(f"{f['WARC-Record-ID']}: the payload does not have the recorded digest")
                    rows.append((number(f["WARC-Record-ID"]), f["WARC-Target-URI"], kind, int(r["http"]["Content-Length"]), known, number(f.get("WARC-Refers-To")), payload if kind == "response" else None))
                    size += len(payload) + 256
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(records, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """Write pages to archives in a fresh folder of the shared folder and read them back, without the payloads."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write(pages, folder, minimum)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
