"""WARC archives compressed with Zstandard: one frame per record, and a dictionary in a leading skippable frame.

Writing: every archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record
follows as a frame of its own.  Spark's text writer writes the frames, one row each, and its line separator is an
empty skippable frame, so the files are valid Zstandard streams of any length and live in any store Spark writes to.
A dictionary is trained on the first rows of its own task (SAMPLE records at most; it only affects the size).

Reading: the archive is walked frame by frame; the dictionary is taken from the leading skippable frame (which may be
compressed itself), other skippable frames are passed over, one frame is decoded per record, and the header lines,
their lengths and the payload digest are validated.  A bad record raises an error that names the file and the offset.

Equal payloads of at least LEAST bytes are stored once: the one with the smallest page_id is the response, the
others are revisit records without payload that refer to it.

Defined cases: null html is an empty payload; null page_id counts as larger than any other; rows with equal page_id
and payload are responses each when theirs is the smallest; null url is written as an empty header; an empty table
gives no records; other columns are not written.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import scratch_path

LEAST = 100
SAMPLE, DICTIONARY = 200, 32 << 10
MAGIC_DICTIONARY = 0x184D2A5D  # fixed value: skippable frame of a WARC dictionary
MAGIC_FRAME = 0xFD2FB528  # fixed value: Zstandard frame
MAGIC_TRAINED = 0xEC30A437  # fixed value: Zstandard dictionary
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)  # all bytes are ASCII, so it can be a line separator
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.md5(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; first is the page_id of the response a revisit refers to."""
    body = payload if first is None else b""
    head = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "text/html; charset=utf-8",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if first is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first, digest), "X-Refers-To-Page": str(first)}
    head["Content-Length"] = str(len(body))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header and body of a record; raises ValueError when a header, a length or the digest is wrong."""
    top, gap, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line[:60]!r}")
        head[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise ValueError(f"header {name} is missing")
    n = int(head["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"content length {n} doesn't fit {len(rest)} bytes")
    body = rest[:n]
    if head["warc-type"] == "response" and "warc-payload-digest" in head:
        if head["warc-payload-digest"] != f"sha256:{hashlib.sha256(body).hexdigest()}":
            raise ValueError("payload digest differs")
    return head, body


def frames(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of every Zstandard frame of an archive."""
    import zstandard

    view, at, dictionary = memoryview(archive), 0, None
    if len(archive) >= 8:
        magic, size = struct.unpack_from("<II", archive)
        if magic == MAGIC_DICTIONARY:
            if 8 + size > len(archive):
                raise ValueError("the dictionary frame is cut off")
            raw, at = bytes(view[8 : 8 + size]), 8 + size
            if raw[:4] == struct.pack("<I", MAGIC_FRAME):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            dictionary = zstandard.ZstdCompressionDict(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(archive):
        if at + 8 > len(archive):
            raise ValueError(f"{len(archive) - at} bytes are left at offset {at}")
        magic, size = struct.unpack_from("<II", archive, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + size > len(archive):
                raise ValueError(f"the frame at offset {at} is cut off")
            at += 8 + size
            continue
        if magic != MAGIC_FRAME:
            raise ValueError(f"no frame at offset {at}")
        size = frame_size(view, at)
        one = decoder.decompressobj()
        raw = one.decompress(view[at : at + size])
        if not one.eof:
            raise ValueError(f"the frame at offset {at} is cut off")
        yield at, raw
        at += size


def frame_size(view: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame at an offset, from its header and block headers (format of RFC 8878)."""
    flags = view[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    size = 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + size + 3 > len(view):
            raise ValueError(f"the frame at offset {at} is cut off")
        block = int.from_bytes(view[at + size : at + size + 3], "little")
        size += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    size += 4 * checksum
    if at + size > len(view):
        raise ValueError(f"the frame at offset {at} is cut off")
    return size


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the pages as archives below folder."""
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    # the smallest page_id per payload: an aggregate with map-side combine, so a hot payload is a row per task
    firsts = rows.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    joined = rows.join(firsts.select("digest", "first"), "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1)) > F.col("first"), F.col("first")).alias("first"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder, head = None, b""
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, 500).to_pylist()
                at += len(part)
                raw = [record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["first"]) for r in part]
                out = []
                if coder is None:
                    try:
                        trained = zstandard.train_dictionary(DICTIONARY, raw[:SAMPLE])
                    except zstandard.ZstdError:  # too few or too short records to learn from
                        trained = zstandard.ZstdCompressionDict(b"".join(raw[:SAMPLE])[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    coder = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
                    head = struct.pack("<II", MAGIC_DICTIONARY, len(trained.as_bytes())) + trained.as_bytes()
                    out.append(head)
                out += [coder.compress(r) for r in raw]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    frames_ = joined.mapInArrow(compress, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames_.write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("compression", "none").text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record; a task holds one archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows: list[tuple] = []
                try:
                    for _, raw in frames(content.as_py()):
                        head, body = parse_record(raw)
                        page, other = head.get("x-page-id"), head.get("x-refers-to-page")
                        rows.append((
                            int(page) if page else None, head.get("warc-target-uri"), int(head.get("x-payload-length", len(body))),
                            head.get("warc-payload-digest", "").removeprefix("sha256:"), head["warc-type"], int(other) if other else None,
                            body if head["warc-type"] == "response" else None))
                        if len(rows) == 500:
                            yield _records(rows)
                            rows = []
                except Exception as e:
                    raise ValueError(f"{path}: {e}") from e
                yield _records(rows)

    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
