"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are renumbered by falling frequency in the corpus, so the 256 commonest take one byte.  A block of documents
holds two streams: control bytes with four two-bit lengths each, and the data bytes of all values.  A control byte
is decoded by looking up its four lengths in a table of 256 rows; the values then come from four masked gathers of
numpy, without a loop over ids.

A folder of files has `blocks` (part, before, doc_ids, sizes, control, data), `ranks` (id by rank) and `starts` (ids of
all documents before each part).  The files of `blocks`, read by name, hold the documents in ascending doc_id order, a
part in each; `before` counts the ids before the block in its part, so a block can be read alone.

Texts are encoded where they are scanned, with their ids counted on the way; what is exchanged are the ids.

Defined cases: null text is empty and has the end id only; null doc_id comes first; rows of equal doc_id are in the
order of a hash of their text; repeated rows are written each; an empty table gives empty files; other columns are not
written.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.bpe import PLAIN, Bpe, default_path
from llm.bytescan import texts_of
from llm.common import scratch_path, small_batches, stored

END = 1
BLOCK_DOCS = 2048
ASKED = 2000  # texts in one call of the library, which bounds the memory of its answers
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


class LibraryBpe(Bpe):
    """Runs and pieces are encoded by the tokenizers library itself.

    A piece is asked for without the normaliser and the pre-tokeniser, which have nothing left to do there.
    """

    KEEP = 700_000

    def __init__(self, path: str):
        super().__init__(path)
        self.ranks = {}  # merging is the library's work here
        self.whole = self.library  # for runs that are not plain words
        self.whole.no_truncation()
        self.whole.no_padding()
        self.library = Tokenizer(self.whole.model)

    def letters_of(self, piece: str) -> str:
        """The piece as the pre-tokeniser hands it to the model: a printable character for each byte."""
        if piece.isascii() and piece.isprintable():
            return piece
        return "".join([self.letters[b] for b in piece.encode()])

    def piece(self, piece: str) -> bytes:
        return np.array(self.library.encode(self.letters_of(piece), add_special_tokens=False).ids, "<u4").tobytes()

    def prepare(self, runs: list[str]) -> None:
        """Encode all new words, and all new runs that are not plain words, in few calls of the library; longer ones are not kept."""
        words, made, others = {}, [], []
        for r in self.runs.missing(runs):
            if len(r) <= 64:
                if plain := PLAIN.fullmatch(r):
                    word, signs = plain[1].lower(), plain[2]
                    if word == r:
                        words[r] = None
                    else:
                        made.append((r, word, signs))
                elif r:
                    others.append(r)
        words.update(dict.fromkeys(self.runs.missing([word for _, word, _ in made])))
        for asked, library in ((list(words), self.library), (others, self.whole)):
            for at in range(0, len(asked), ASKED):
                part = asked[at : at + ASKED]
                texts = part if library is self.whole else list(map(self.letters_of, part))
                for run, e in zip(part, library.encode_batch_fast(texts, add_special_tokens=False)):
                    ids = e.ids
                    self.runs.add(run, struct.pack(f"<{len(ids)}I", *ids))
        for r, word, signs in made:
            self.runs.add(r, self.runs[word] + (self.pieces[signs] if signs else b""))


@functools.lru_cache(2)
def load(path: str) -> LibraryBpe:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library would start a thread for each of the machine
    return LibraryBpe(path)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = code
    control = four[0::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6
    end = np.cumsum(code.astype(np.int64) + 1)
    at = end - code - 1
    data = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(4):
        some = code >= k
        data[at[some] + k] = (v[some] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(size)
    at = end - size
    raw = np.frombuffer(data, np.uint8)
    if int(end[-1] if n else 0) != len(raw) or len(control) != -(-n // 4):
        raise ValueError("the streams of a block don't fit its number of ids")
    out = raw[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        some = np.flatnonzero(size > k)
        out[some] |= raw[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenised(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(doc_id, h, n, ids, tally): a row per document where the scan has it, and per task a row of its counts by id."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    names = ["doc_id", "h", "n", "ids", "tally"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        kind = np.dtype("<u2" if len(bpe.spelled) <= 0xFFFF else "<u4")  # two bytes an id where they suffice
        count = np.zeros(max(len(bpe.spelled), END + 1), np.int64)
        for batch in batches:
            at = 0
            for ids, ends in bpe.encode(batch.column(2)):
                n, size = len(ends) - 1, np.diff(ends) + 1
                off = np.concatenate([[0], np.cumsum(size)])
                inner = np.ones(off[-1], bool)
                inner[off[1:] - 1] = False
                whole = np.full(off[-1], END, kind)
                whole[inner] = ids
                count += np.bincount(whole, minlength=len(count))
                blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((off * kind.itemsize).astype(np.int32)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(size), blobs, pa.nulls(n, pa.binary())], names)
                at += n
        if count.any():
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1, pa.binary()), pa.array([count.tobytes()], pa.binary())], names)

    return rows.mapInArrow(work, "doc_id long, h long, n long, ids binary, tally binary")


def counted(tokens: DataFrame) -> list[tuple[int, int]]:
    """(id, occurrences) of the ids that occur: as many rows as the vocabulary has at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                more = np.frombuffer(blob, np.int64)
                count = more + count if len(count) else more
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["id", "n"])

    sums = tokens.filter("tally is not null").select("tally").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [(r["id"], r["n"]) for r in sums.collect()]


def write_tokens(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None) -> None:
    """Encode docs and write the folder of token files."""
    spark = docs.sparkSession
    small_batches(spark)
    tokens = stored(tokenised(docs, key, text, path or default_path()), "tokens")
    ids = [i for i, _ in sorted(counted(tokens), key=lambda x: (-x[1], x[0]))]
    spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, before = shared.value, 0
        for batch in batches:
            raw, offsets = texts_of(batch.column(2))
            size = batch.column(1).to_numpy()
            for at in range(0, len(batch), BLOCK_DOCS):
                n = size[at : at + BLOCK_DOCS]
                mine = raw[offsets[at] : offsets[at + len(n)]]
                total = int(n.sum())
                control, data = pack(rank[mine.view("<u2" if len(mine) == 2 * total else "<u4")])
                yield pa.RecordBatch.from_arrays([
                    batch.column(3).slice(at, 1), pa.array([before], pa.int64()), pa.array([batch.column(0).slice(at, len(n)).to_pylist()], pa.list_(pa.int64())),
                    pa.array([n], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary()),
                ], ["part", "before", "doc_ids", "sizes", "control", "data"])
                before += total

    # the ids are exchanged, not the texts; each task then writes its part, as it lies, into the file of its number
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = tokens.filter("n is not null").select("doc_id", "h", "n", "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows.select("doc_id", "n", "ids", F.spark_partition_id().alias("part")).mapInArrow(
        encode, "part int, before long, doc_ids array<long>, sizes array<long>, control binary, data binary").write.parquet(f"{folder}/blocks")
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    starts, total = [], 0
    for r in sorted(sizes.collect(), key=lambda r: r["part"]):  # one row per part
        starts.append((r["part"], total))
        total += r["n"]
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{folder}/starts")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files; ids as little-endian unsigned 32-bit integers."""
    table = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], "<u4")  # a vocabulary
    starts = {r["part"]: r["start"] for r in spark.read.parquet(f"{folder}/starts").collect()}  # one row per part
    shared = spark.sparkContext.broadcast((table, starts))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, starts = shared.value
        for batch in batches:
            for k in range(len(batch)):
                part, before, docs, sizes, control, data = (c[k].as_py() for c in batch.columns)
                ids, first = table[unpack(control, data, sum(sizes))], starts[part] + before
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64()), pa.array(first + ends[:-1]), pa.array(np.array(sizes, np.int64)),
                    pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.parquet(f"{folder}/blocks").select("part", "before", "doc_ids", "sizes", "control", "data").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids binary")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
