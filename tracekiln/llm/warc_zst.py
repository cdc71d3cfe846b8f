"""WARC archives of Zstandard frames: writer and validating reader.

An archive is one skippable frame (magic ``0x184D2A5D``) that holds a Zstandard
dictionary, then one Zstandard frame per WARC record.  The dictionary is trained
on the archive's own first records, so each archive can be read alone; where
training is impossible (too few or too uniform records) there is no such frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files

DICT_MAGIC, FRAME_MAGIC, ZDICT_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
DICT_BYTES, SAMPLE_BYTES, CHUNK = 16 << 10, 1 << 20, 1 << 16
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
READ_SCHEMA = ("page_id bigint, uri string, record_type string, payload_bytes bigint, payload_digest string, "
               "refers_to bigint, payload binary, archive string")


class WarcError(ValueError):
    """An archive breaks the format; the message names file and record."""


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str | None) -> str:
    """A URI as one header line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record.  A revisit has the HTTP header block alone and
    names the full payload's digest and length."""
    block = HTTP.format(n=len(payload)).encode() + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _header_value(uri)),
            ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block))]
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        return None


def write_archive(uri: str, records: Iterator[bytes], level: int = 3) -> int:
    """Write records as one archive; returns their number.  At most
    ``SAMPLE_BYTES`` of records are held, until the dictionary is trained."""
    held, size, n = [], 0, 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    dictionary = train(held)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
    with files.writing(uri) as out:
        if dictionary:
            raw = dictionary.as_bytes()
            out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        for part in (held, records):
            for r in part:
                out.write(compressor.compress(r))
                n += 1
    return n


def frames(stream, name: str) -> Iterator[bytes]:
    """The archive's records, one decoded frame at a time; memory holds one record."""
    buffer = stream.read(CHUNK)
    if not buffer:
        return
    dictionary = None
    magic = struct.unpack_from("<I", buffer)[0] if len(buffer) >= 4 else 0
    if magic == DICT_MAGIC:
        if len(buffer) < 8:
            raise WarcError(f"{name}: cut in its dictionary")
        size = struct.unpack_from("<I", buffer, 4)[0]
        while len(buffer) < 8 + size and (more := stream.read(CHUNK)):
            buffer += more
        raw = buffer[8:8 + size]
        if len(raw) < size:
            raise WarcError(f"{name}: cut in its dictionary")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):       # the format allows a compressed dictionary
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw[:4] != struct.pack("<I", ZDICT_MAGIC):
            raise WarcError(f"{name}: its leading frame holds no dictionary")
        dictionary, buffer = zstandard.ZstdCompressionDict(raw), buffer[8 + size:]
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    n = 0
    while buffer or (buffer := stream.read(CHUNK)):
        n += 1
        if len(buffer) < 4:
            buffer += stream.read(CHUNK)
        if buffer[:4] != struct.pack("<I", FRAME_MAGIC):
            raise WarcError(f"{name}, record {n}: no Zstandard frame")
        frame, out = decompressor.decompressobj(), []
        try:
            out.append(frame.decompress(buffer))
            while not frame.eof:
                if not (buffer := stream.read(CHUNK)):
                    raise WarcError(f"{name}, record {n}: the frame is cut")
                out.append(frame.decompress(buffer))
        except zstandard.ZstdError as e:
            raise WarcError(f"{name}, record {n}: {e}") from e
        buffer = frame.unused_data
        yield b"".join(out)


def parse(data: bytes, where: str) -> dict:
    """Validate one record (version, required headers, lengths, digests)."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"{where}: no WARC header")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            raise WarcError(f"{where}: bad header line {line[:80]!r}")
        fields[key.strip().lower()] = value.strip()
    for key in REQUIRED:
        if key.lower() not in fields:
            raise WarcError(f"{where}: {key} is missing")
    length = fields["content-length"]
    if not length.isascii() or not length.isdigit():
        raise WarcError(f"{where}: Content-Length is {length!r}")
    block, end = rest[:int(length)], rest[int(length):]
    if len(block) != int(length) or end != b"\r\n\r\n":
        raise WarcError(f"{where}: Content-Length {length} does not fit the record")
    if fields.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise WarcError(f"{where}: block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"\r\nContent-Length: (\d+)", http)
    kind, payload_digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not sep or not size:
        raise WarcError(f"{where}: no HTTP header")
    if kind == "response" and (len(payload) != int(size[1]) or digest(payload) != payload_digest):
        raise WarcError(f"{where}: the payload does not fit its length or digest")
    if kind == "revisit" and (payload or not payload_digest or "warc-refers-to" not in fields):
        raise WarcError(f"{where}: bad revisit")
    return {"page_id": _page_of(fields["warc-record-id"]), "uri": fields.get("warc-target-uri"), "record_type": kind,
            "payload_bytes": int(size[1]), "payload_digest": payload_digest,
            "refers_to": _page_of(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads of at least
    ``min_bytes`` the smallest page_id is kept whole (every row that has it), the
    others refer to it.  Only digests and ids are grouped; a payload that a
    third of all pages share is one group row and a skew-split join.  A row with a null
    page_id refers to the smallest id like any other."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    first = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return (rows.join(first, "sha", "left")
            .withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
            .select("page_id", "url", "payload", "refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, max_bytes: int = 64 << 20) -> DataFrame:
    """Write one WARC record per row of ``pages`` (``page_id, url, html``; a null html is
    empty) into archives below ``path`` and return ``archive, n_records``.

    Each task writes its partition, a new archive after ``max_bytes`` of records.
    Repeated rows give repeated records; no rows, no archives; other columns are ignored.
    """
    common.python_workers(pages.sparkSession, 256)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for page, url, payload, refers in zip(*(batch.column(k) for k in range(4))):
                    yield record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py(), refers.as_py() is not None)

        rest, k = records(), 0
        while (first := next(rest, None)) is not None:
            def part(first=first):
                size = len(first)
                yield first
                while size < max_bytes and (r := next(rest, None)) is not None:
                    size += len(r)
                    yield r

            uri = f"{path}/part-{TaskContext.get().partitionId():06d}-{k:04d}.warc.zst"
            n, k = write_archive(uri, part()), k + 1
            yield pa.RecordBatch.from_pydict({"archive": [uri], "n_records": pa.array([n], pa.int64())})

    return common.stored(mark_revisits(pages, min_bytes).mapInArrow(write, "archive string, n_records bigint"),
                         "warc-archives")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the named archives, validated (``WarcError`` otherwise)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                            ("payload", pa.binary()), ("archive", pa.string())])
        for uri in (u for b in batches for u in b.column(0).to_pylist()):
            rows, size = [], 0
            with files.streamed(uri) as stream:
                for n, data in enumerate(frames(stream, uri), 1):
                    row = parse(data, f"{uri}, record {n}") | {"archive": uri}
                    if not with_payload:
                        row["payload"] = None
                    size += len(row["payload"] or b"") + 200
                    rows.append(row)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("archive").repartition(max(1, archives.count()), "archive").mapInArrow(read, READ_SCHEMA)


def roundtrip(spark: SparkSession, pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    return read_archives(write_archives(pages, path, min_bytes), with_payload=False)
