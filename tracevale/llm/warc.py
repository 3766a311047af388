"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

Pages with equal payloads are one group: the one with the largest page_id is written as a response with its payload, the
others as revisits that refer to it. Archives go to the shared folder; a table lists those whose task was committed, so
what a lost or repeated task has written is never read. Reading takes one frame at a time and validates headers, lengths
and digests.

Defined cases: a null html is an empty payload; a null url has no target header; a null page_id is smaller than any other
and a group of only such pages has no revisits; rows that repeat the response's page_id are responses too. Control
characters in a url are percent-encoded. An empty table gives an empty list of archives. Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import hash_sample, materialize, shared_dir, small

#: Fixed values of the format: magic number of the dictionary's skippable frame, version line, profile of a revisit.
MAGIC, VERSION = 0x184D2A5D, b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 64 << 20
#: Groups of more equal payloads than this, of which there are few, are joined without a shuffle of their pages.
LARGE_GROUP = 1_000
NEEDED = {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[bytes, bytes]:
    pairs = [line.partition(b":") for line in lines]
    if any(not colon for _, colon, _ in pairs):
        raise ValueError("a header line has no colon")
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse_record(raw: bytes) -> dict:
    """Fields of a record; raises ValueError where headers, lengths or the digest are wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version != VERSION:
        raise ValueError("not a WARC record")
    h = _headers(lines)
    if missing := NEEDED - h.keys():
        raise ValueError(f"headers are missing: {sorted(missing)}")
    length = int(h[b"content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block's length is not the one stated")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(_headers(http.split(b"\r\n")[1:])[b"content-length"])
    kind, digest = h[b"warc-type"].decode(), h[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("the payload is not the one stated")
    if kind not in ("response", "revisit") or (kind == "revisit") != (b"warc-refers-to" in h) or kind == "revisit" and payload:
        raise ValueError("not a response or a revisit")
    number = lambda k: int(x) if (x := h[k][len(b"<urn:page:") : -1]) else None
    return {
        "page_id": number(b"warc-record-id"), "url": h[b"warc-target-uri"].decode() if b"warc-target-uri" in h else None, "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number(b"warc-refers-to") if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def read_archive(stream) -> Iterator[bytes]:
    """The records of an open archive, one frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary in the leading frame")
    decode = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    left = b""
    while True:
        frame, out = decode.decompressobj(), []
        while not frame.eof:
            left = left or stream.read(1 << 20)
            if not left:
                if out:
                    raise ValueError("the last frame is cut off")
                return
            out.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def train_dictionary(pages: DataFrame, sample: int = 256, size: int = 16_384) -> bytes:
    """A dictionary from the starts of at most `sample` pages."""
    starts = hash_sample(pages.where(F.octet_length("html") > 0).select("page_id", "html"), sample, "page_id").select("page_id", F.substring("html", 1, 20_000).alias("html"))
    rows = starts.limit(sample).collect()
    texts = [_record(r.page_id, None, r.html.encode(), None, "1970-01-01T00:00:00Z") for r in rows]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too few samples: their beginning serves as it is
        return (b"".join(texts) or VERSION + b"\r\nWARC-Type: response\r\n\r\n")[:size]


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all pages and return (file, records), the list of archives. Payloads of under `least_bytes` have no revisits."""
    dictionary, folder = train_dictionary(pages), shared_dir(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.sha1(F.col("html").cast("binary")))
    groups = p.where(F.octet_length("html") >= least_bytes).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last")).where("n > 1")
    groups = materialize(groups)
    large = groups.where(F.col("n") > LARGE_GROUP).select("key", "last")
    large = small(large, 100_000)
    rest = p.join(large, "key", "left_anti").join(groups.where(F.col("n") <= LARGE_GROUP).select("key", "last"), "key", "left")
    p = rest.unionByName(p.join(large, "key"))
    p = p.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        data = zstandard.ZstdCompressionDict(dictionary)
        encode = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True)
        out, files, counts = None, [], []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                if out is None or out.tell() > ARCHIVE_BYTES:
                    if out:
                        out.close()
                    files.append(f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(files)}.warc.zst")
                    counts.append(0)
                    out = fs.open_output_stream(f"{path}/{files[-1]}")
                    out.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
                out.write(encode.compress(_record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py(), date)))
                counts[-1] += 1
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{f}" for f in files], pa.string()), pa.array(counts, pa.int64())], ["file", "records"])

    return materialize(p.mapInArrow(write, "file string, records long"))


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the listed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload."""
    names = [n for n in FIELDS if payloads or n != "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, records in zip(*batch.columns, strict=True):
                fs, path = pyarrow.fs.FileSystem.from_uri(file.as_py())
                rows, size, n = [], 0, 0
                with fs.open_input_stream(path) as stream:
                    for raw in read_archive(stream):
                        rows.append(parse_record(raw))
                        n, size = n + 1, size + len(raw) * payloads
                        if len(rows) == 5_000 or size > 16 << 20:
                            yield table(rows)
                            rows, size = [], 0
                if n != records.as_py():
                    raise ValueError(f"{file}: {n} records, {records} were written")
                yield table(rows)

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], FIELDS[n]) for n in names], names)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    # a stated number of partitions, as a few rows stand for much reading
    tasks = min(max(1, archives.count()), 10_000)
    return archives.select("file", "records").repartition(tasks, "file").mapInArrow(read, ", ".join(f"{n} {kinds[FIELDS[n]]}" for n in names))


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    return read_archives(write_archives(pages, least_bytes), payloads=False)
