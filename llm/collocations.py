"""Phrase collocation mining by SON partitioning.

1. Mine: the scan's partitions are dealt into SHARDS shards.  A shard counts all its phrases of 1 to 3 words, by 64-bit
   hashes, and keeps those found at least LEAST / SHARDS times (rounded up): a phrase with LEAST occurrences in all has
   that many in some shard.  A task packs the hashes of 8 MB of text, sorted, by key range; Spark groups the packs by
   (shard, range), and ranges are as many as hold a bounded number of phrases each.
2. Union: the hashes that some shard found frequent, as one bitmap of at most FILTER_BITS bits (its size follows their
   number), built range by range.
3. Count: the second scan counts the words of every phrase whose bit is set, exactly and by its text; Spark adds up
   the counts of a task and keeps phrases found LEAST times or more.  Hashes that collide or a crowded bitmap only make
   this step count more phrases, never fewer.
4. Score: the counts of both parts of each cut are joined to the candidates, salted where the part is a single word.
   Products are decimals of 38 digits (a < 10**16), divided as whole numbers.

All is per lang; a null lang is `und`.  The first TOP of a lang are found in salted groups first, so that no task ranks
all candidates of a lang.

Defined cases: null and empty texts have no words; a lang without candidates gives no rows; repeated rows count each; an
empty table gives no rows; only the columns of text and lang are read.  A text is cut into slices at piece ends, so
memory is that of the longest piece.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import join_small, small_batches, stored, table
from llm.perfect_hash import mixed

LEAST, LONGEST, COVER, TOP = 10, 3, 50, 2000
SHARDS = 4
FILTER_BITS = 28  # log2 of the largest bitmap: 32 MB
SLICE, FLUSH = 1 << 20, 8 << 20  # bytes of text split at once, and counted together
RANGE_PHRASES = 8 << 20  # phrase occurrences of a key range, over all shards
SALTS = 8
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 9)


class Phrases:
    """The words of up to FLUSH bytes of one lang as numbers; 0 stands between pieces."""

    def __init__(self, lang: str):
        self.lang = lang
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.numbers[b"\n"], self.numbers[b""]
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, text: bytes) -> None:
        text = text.translate(PLAIN)
        at = 0
        while at < len(text):
            end = text.find(b"\n", at + SLICE)
            end = len(text) if end < 0 else end
            tokens = text[at:end].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
            self.parts += [ids[ids != 1], np.zeros(1, np.int32)]
            at = end
        self.bytes += len(text)

    def words(self) -> list[bytes]:
        return list(self.numbers)

    def ids(self) -> np.ndarray:
        return np.concatenate([*self.parts, np.zeros(0, np.int32)])

    def hashes(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, hash) of the phrases of 1, 2 and 3 words.  The lang is part of the hash."""
        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        word = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.numbers], np.uint64)
        starts = np.flatnonzero(ids)
        code = word[ids[starts]]
        for size in range(1, LONGEST + 1):
            yield starts, mixed(code)
            inside = starts + size < len(ids)
            inside[inside] = ids[starts[inside] + size] != 0
            starts, code = starts[inside], code[inside]
            code = mixed(code + np.uint64(size)) + word[ids[starts + size]]


def flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[Phrases]:
    """The phrases of a task, FLUSH bytes of a lang at a time (of all langs together at most 2 * FLUSH)."""
    held: dict[str, Phrases] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            one = held.get(lang)
            if one is None:
                one = held[lang] = Phrases(lang)
            one.add(text.as_py())
            if one.bytes >= FLUSH or sum(p.bytes for p in held.values()) >= 2 * FLUSH:
                full = max(held, key=lambda k: held[k].bytes)
                yield held.pop(full)
    yield from held.values()


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit keys as steps, byte plane by byte plane, then counts up to 255: compresses well in a shuffle."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype(np.uint32)
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(raw[:4].T).view(np.uint32).ravel(), dtype=np.uint32), raw[4]


def miner(range_bits: int, shards: int):
    """Rows (shard, range, pack): a range holds the hashes with equal leading range_bits, told apart by 32 bits more."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        for phrases in flushes(batches):
            ids = phrases.ids()
            keys, counts = np.unique(np.concatenate([h for _, h in phrases.hashes(ids)]) >> np.uint64(32 - range_bits), return_counts=True)
            part = (keys >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part)) + 1
            for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                if high > low:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard], pa.int32()), pa.array([part[low]], pa.int32()),
                        pa.array([pack(keys[low:high].astype(np.uint32), counts[low:high])], pa.binary())], ["shard", "range", "pack"])

    return mine


def local(support: int):
    """The phrases of one range that a shard finds at least support times."""

    def mined(group: pa.Table) -> pa.Table:
        packs = [unpack(p) for p in group["pack"].to_pylist()]
        keys, where = np.unique(np.concatenate([k for k, _ in packs]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([c for _, c in packs]).astype(float))
        keys = keys[counts >= support]
        return pa.table({"range": group["range"].slice(0, 1), "n": pa.array([len(keys)], pa.int64()),
                         "pack": pa.array([pack(keys, np.ones(len(keys)))], pa.binary())})

    return mined


def union(bits: int, range_bits: int):
    """The segment of the bitmap that belongs to a range: frequent in any shard."""
    width = bits - range_bits  # log2 of the bits of a segment

    def segment(group: pa.Table) -> pa.Table:
        marks = np.zeros(1 << width, bool)
        for p in group["pack"].to_pylist():
            marks[unpack(p)[0] >> np.uint32(32 - width)] = True
        return pa.table({"range": group["range"].slice(0, 1), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    return segment


def candidate_filter(texts: DataFrame, least: int, shards: int) -> tuple[np.ndarray, int]:
    """(bitmap, log2 of its bits) of the phrases that may occur least times."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-LONGEST * size // (5 * RANGE_PHRASES)))  # five bytes a word, at the least
    range_bits = min((ranges - 1).bit_length(), 20)
    mined = texts.mapInArrow(miner(range_bits, shards), "shard int, range int, pack binary")
    frequent = stored(mined.groupBy("shard", "range").applyInArrow(local(-(-least // shards)), "range int, n long, pack binary"), "frequent")
    n = frequent.agg(F.sum("n")).first()[0] or 0
    bits = max(min((16 * n).bit_length(), FILTER_BITS), range_bits + 3)
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    step = len(bitmap) >> range_bits
    for r in frequent.groupBy("range").applyInArrow(union(bits, range_bits), "range int, bits binary").toLocalIterator():
        bitmap[r["range"] * step : (r["range"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return bitmap, bits


def counter(bitmap, bits: int):
    """Rows (lang, phrase, n) of the phrases whose bit is set; the empty phrase has the number of all words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bitmap.value
        for phrases in flushes(batches):
            ids = phrases.ids().astype(np.int64)
            words = pa.array(phrases.words(), pa.binary())
            texts, counts = [pa.array([b""], pa.binary())], [np.array([np.count_nonzero(ids)])]
            for size, (starts, code) in enumerate(phrases.hashes(ids), 1):
                at = code >> np.uint64(64 - bits)
                starts = starts[(marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                group, first = ids[starts], np.zeros(0, np.int64)
                for k in range(1, size + 1):
                    _, first, group, n = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
                    if k < size:
                        group = group * len(words) + ids[starts + k]
                starts = starts[first]
                texts.append(pc.binary_join_element_wise(*[words.take(pa.array(ids[starts + k])) for k in range(size)], pa.scalar(b" ", pa.binary())))
                counts.append(n)
            texts, counts = pa.concat_arrays(texts), np.concatenate(counts)
            for low in range(0, len(texts), 50_000):
                part = texts.slice(low, 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([phrases.lang] * len(part)), part.cast(pa.string()), pa.array(counts[low : low + 50_000])], ["lang", "phrase", "n"])

    return counted


def phrase_counts(texts: DataFrame, least: int, shards: int) -> DataFrame:
    """(lang, phrase, n): the phrases with n >= least, and the number of words of each lang as the empty phrase."""
    bitmap, bits = candidate_filter(texts, least, shards)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    counts = texts.mapInArrow(counter(shared, bits), "lang string, phrase string, n long")
    return stored(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("phrase") == "")), "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score) of the candidates, by the lowest-scoring cut."""
    candidates = counts.filter(F.instr("phrase", " ") > 0).withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    cuts = candidates.select("*", words.alias("words")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    join = lambda low, n: F.array_join(F.slice("words", low, n), " ")
    cuts = cuts.select("*", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    # a frequent word is part of many candidates: single words are salted, their counts repeated under each salt
    single = F.instr("phrase", " ") == 0
    parts = counts.filter("phrase <> ''").withColumn("salt", F.explode(F.when(single, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    for side, name in (("left", "l"), ("right", "r")):
        salt = F.when(F.instr(side, " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).cast("int")
        told = parts.select("lang", F.col("phrase").alias(side), "salt", F.col("n").alias(name))
        cuts = cuts.withColumn("salt", salt).join(told, ["lang", side, "salt"]).drop("salt")
    whole = lambda c: F.col(c).cast("decimal(16,0)")
    value = (whole("a") * whole("a")).cast("decimal(32,0)") * F.lit(1000000).cast("decimal(7,0)")
    cuts = cuts.withColumn("up", value.cast("decimal(38,0)")).withColumn("down", (whole("l") * whole("r")).cast("decimal(38,0)"))
    least = F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a").agg(least, F.first("words").alias("words")).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, shards: int = SHARDS, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each lang."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text")).filter("octet_length(text) > 0")
    counts = phrase_counts(texts, least, shards)
    found = stored(scored(counts), "scored")
    inner = F.array(*[F.array_join(F.slice("words", k, LONGEST - 1), " ") for k in (1, 2)])
    longer = found.filter(F.size("words") == LONGEST).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = found.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(100 * F.col("longer") >= cover * F.col("a"), F.lit(False)))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = open_.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counts.filter("phrase = ''").select("lang", "n")
    return join_small(best, totals, ["lang"], "inner").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))
