"""Lines repeated over documents, by a sharded minimal perfect hash over the distinct line hashes.

1. Scan: a line's key (blanks at both ends stripped, A-Z lower-cased) of at least SHORTEST code points becomes a 128-bit
   hash; each Arrow batch sends one row per distinct hash (least doc_id, documents), Spark adds these up and the
   distinct hashes are written.
2. Index: hashes are dealt into shards of about SHARD_LINES lines.  A shard is one row of compact arrays: the bitmaps of
   its perfect hash and, by its numbers, a 32-bit fingerprint, the count of documents and the least doc_id.
3. Probe: documents ask with (hash, doc_id), 24 bytes a line and never the line, at the hash's shard; the shard answers with
   the hashes that the document loses.  A document loses a line when the shard names another document as the first.
4. The hashes lost are joined with the documents by doc_id, and the lines are cut.

Skew: lines held by more than 1/HOT_LINES of all (document, line) cases would make their shard hot.  There are fewer
than HOT_LINES of them by that rule; they form a small index of the same kind that goes to every task and is probed in
place, so nothing is sent for them.  All other hashes are spread evenly.

Defined cases: null and empty text have one empty line, nothing is dropped and null stays null.  A null doc_id is the
least and never loses a line.  Rows of equal doc_id are one document: they lose nothing to each other.  An empty table
gives no rows; extra columns pass through, whatever their names.  Two keys with the same 128-bit hash would count as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches, stored, table
from llm.perfect_hash import PerfectHash, build

SHORTEST = 10
SHARD_LINES = 250_000
HOT_LINES = 20_000
BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
INNER = bytes(range(0x80, 0xC0))  # bytes that begin no code point
NONE = -(1 << 63)  # stands for a null doc_id
INDEX = "shard int, sizes array<long>, words binary, prints binary, counts binary, firsts binary"


def line_hashes(text: bytes, shortest: int = SHORTEST) -> list[bytes | None]:
    """128-bit hash of the key of each line, None for a shorter key."""
    out = []
    for line in text.translate(LOWER).split(b"\n"):
        key = line.strip(BLANKS)
        long = len(key) >= shortest and (len(key) >= 4 * shortest or len(key.translate(None, INNER)) >= shortest)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def batch_keys(batch: pa.RecordBatch, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, row of the batch): the distinct hashes of each document of a batch, sorted by hash."""
    found, rows = [], []
    for row, text in enumerate(batch.column("text")):
        mine = {h for h in line_hashes(text.as_py() or b"", shortest) if h}
        found.extend(mine)
        rows.extend([row] * len(mine))
    high, low = halves(found)
    order = np.lexsort((low, high))
    return high[order], low[order], np.array(rows, np.int64)[order]


def counter(shortest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, rows = batch_keys(batch, shortest)
            if not len(high):
                continue
            ids = batch.column("id").to_numpy()[rows]
            starts = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            yield pa.RecordBatch.from_arrays([
                pa.array(high[starts]), pa.array(low[starts]), pa.array(np.minimum.reduceat(ids, starts)),
                pa.array(np.diff(np.r_[starts, len(high)]))], ["high", "low", "first", "n"])

    return count


def shard_arrays(high: np.ndarray, low: np.ndarray, first: np.ndarray, n: np.ndarray, shard: int) -> pa.Table:
    """The one row of a shard."""
    index = build(high, low)
    at = index.slots(high, low)
    prints, counts, firsts = (np.empty(len(at), t) for t in (np.uint32, np.uint32, np.int64))
    prints[at], counts[at], firsts[at] = low.astype(np.uint32), np.minimum(n, 0xFFFFFFFF), first
    return pa.table({
        "shard": pa.array([shard], pa.int32()), "sizes": pa.array([index.sizes.tolist()], pa.list_(pa.int64())),
        "words": pa.array([index.words.tobytes()], pa.binary()), "prints": pa.array([prints.tobytes()], pa.binary()),
        "counts": pa.array([counts.tobytes()], pa.binary()), "firsts": pa.array([firsts.tobytes()], pa.binary())})


def index_shard(group: pa.Table) -> pa.Table:
    return shard_arrays(*(group[c].to_numpy() for c in ("high", "low", "first", "n")), group["shard"][0].as_py())


class Shard:
    """Arrays of a shard, probed by hash."""

    def __init__(self, row: dict):
        self.index = PerfectHash.of(row["sizes"], row["words"])
        self.prints, self.counts = (np.frombuffer(row[c], np.uint32) for c in ("prints", "counts"))
        self.firsts = np.frombuffer(row["firsts"], np.int64)

    def probe(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, lost): whether the hash is in the shard, and whether the document loses its lines."""
        at = self.index.slots(high, low)
        known = at >= 0
        if len(self.prints):
            known &= self.prints[at] == low.astype(np.uint32)
        lost = known.copy()
        lost[known] = (self.counts[at[known]] > 1) & (self.firsts[at[known]] != ids[known])
        return known, lost


class Hot:
    """The frequent lines: their hashes in full beside the shard, since any hash may ask here."""

    def __init__(self, row: dict, high: np.ndarray, low: np.ndarray):
        self.shard, at = Shard(row), PerfectHash.of(row["sizes"], row["words"]).slots(high, low)
        self.high, self.low = np.empty_like(high), np.empty_like(low)
        self.high[at], self.low[at] = high, low

    def probe(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, lost = self.shard.probe(high, low, ids)
        if len(self.high):
            at = self.shard.index.slots(high, low)
            known &= (self.high[at] == high) & (self.low[at] == low)
        return known, lost & known


def asker(hot: Hot, shards: int, shortest: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, rows = batch_keys(batch, shortest)
            ids = batch.column("id").to_numpy()[rows]
            cold = ~hot.probe(high, low, ids)[0] & (ids != NONE)
            high, low, ids = high[cold], low[cold], ids[cold]
            yield pa.RecordBatch.from_arrays(
                [pa.array((high % shards).astype(np.int32)), pa.array(high), pa.array(low), pa.array(ids)], ["shard", "high", "low", "id"])

    return ask


def answer(asked: pa.Table, index: pa.Table) -> pa.Table:
    """(id, hash) of the lines that documents lose, of one shard."""
    high, low, ids = (asked[c].to_numpy() for c in ("high", "low", "id"))
    if len(ids):
        lost = Shard(index.to_pylist()[0]).probe(high, low, ids)[1]
        high, low, ids = high[lost], low[lost], ids[lost]
    pairs = np.column_stack([high, low]).tobytes()
    return pa.table({"id": pa.array(ids, pa.int64()), "hash": pa.array([pairs[i : i + 16] for i in range(0, len(pairs), 16)], pa.binary())})


def cutter(hot: Hot, shortest: int):
    """Arrow function: (text, id, lost hashes) to the lines that stay, their number before, and how many go."""
    kind = pa.struct([("text", pa.binary()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def cut(text: pa.Array, id: pa.Array, lost: pa.Array) -> pa.Array:
        out = []
        for raw, doc, gone in zip(text, id, lost):
            raw, doc = raw.as_py() or b"", doc.as_py()
            hashes = line_hashes(raw, shortest)
            gone = set(gone.as_py() or ())
            asked = [h for h in hashes if h] if doc != NONE else []
            if asked:
                high, low = halves(asked)
                mask = hot.probe(high, low, np.full(len(high), doc))[1]
                gone.update(h for h, m in zip(asked, mask) if m)
            if gone:
                lines = raw.split(b"\n")
                stay = [line for line, h in zip(lines, hashes) if h not in gone]
                out.append({"text": b"\n".join(stay), "n_lines": len(lines), "n_dropped": len(lines) - len(stay)})
            else:
                out.append({"text": raw, "n_lines": len(hashes), "n_dropped": 0})
        return pa.array(out, kind)

    cut.__annotations__ = {"text": pa.Array, "id": pa.Array, "lost": pa.Array, "return": pa.Array}
    return F.arrow_udf(cut, "struct<text binary, n_lines long, n_dropped long>")


def line_index(docs: DataFrame, shortest: int, shard_lines: int, hot_lines: int) -> tuple[DataFrame, Hot, int]:
    """The shards, the index of the frequent lines and the number of shards.  docs: (id, text as binary)."""
    lines = stored(docs.mapInArrow(counter(shortest), "high long, low long, first long, n long").groupBy("high", "low").agg(
        F.min("first").alias("first"), F.sum("n").alias("n")), "lines")
    total = lines.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_lines))
    frequent = lines.filter(F.col("n") > max(1, total // hot_lines)).toArrow()  # fewer than hot_lines rows
    high, low, first, n = (frequent[c].to_numpy() for c in ("high", "low", "first", "n"))
    hot = Hot(shard_arrays(high, low, first, n, -1).to_pylist()[0], high, low)
    index = lines.withColumn("shard", F.pmod("high", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(index_shard, INDEX)
    return stored(index, "line_index"), hot, shards


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, shard_lines: int = SHARD_LINES, hot_lines: int = HOT_LINES,
) -> DataFrame:
    """(row: struct of the columns of docs, kept: binary, n_lines, n_dropped), one row per row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]).alias("row"),
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NONE)).alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    slim = rows.select("id", "text")
    index, hot, shards = line_index(slim, shortest, shard_lines, hot_lines)
    asked = slim.mapInArrow(asker(hot, shards, shortest), "shard int, high long, low long, id long")
    lost = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(answer, "id long, hash binary")
    lost = lost.groupBy("id").agg(F.collect_list("hash").alias("lost"))  # the lines of one document
    joined = rows.join(lost, "id", "left")
    done = joined.select("row", F.col("text").isNull().alias("none"), F.explode(F.array(cutter(hot, shortest)("text", "id", "lost"))).alias("cut"))
    return done.select("row", "none", F.col("cut.text").alias("kept"), F.col("cut.n_lines").alias("n_lines"), F.col("cut.n_dropped").alias("n_dropped"))


def remove_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the repeated lines cut from its text."""
    cut = dedup_lines(docs, key, text, **options)
    return cut.select(*[
        F.when(~F.col("none"), F.col("kept").cast("string")).alias(c) if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(F.col("row.c0").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
