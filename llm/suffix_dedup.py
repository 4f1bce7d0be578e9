"""Removal of repeated 200-byte strings by blockwise suffix sorting with a difference cover.

Two equal strings of LENGTH bytes at i and j have a shift d < PERIOD at which both i + d and j + d are positions of
the cover sample (position modulo PERIOD in COVER), and the blocks of BLOCK = LENGTH - PERIOD + 1 bytes there are
equal.  So the work is:

1. Cover sample.  The sampled blocks of all texts are sorted one bucket at a time and get a rank: 0 when the block
   occurs once in the corpus.  Only suffixes with a sample of non-zero rank within PERIOD bytes can have a tie of
   LENGTH bytes; all others are settled here and never sorted.
2. Runs.  Consecutive open suffixes are cut into runs before every suffix whose fingerprint ends in zero bits, so equal
   texts are cut alike.  Runs are sorted by their whole bytes; a run that ties is settled, and one holder of each
   (the one of the least block) stands for all of them in the next step.
3. Suffix buckets.  The suffixes of unsettled runs and of the holders are sorted one bucket at a time, and those whose
   first LENGTH bytes tie with a neighbour are marked.
4. Each text drops the union of the marked strings and of the settled runs.

Runs and prefixes are compared by 64-bit fingerprints (sampled blocks by 40 bits, where an
error only leaves one suffix more to sort), so suffixes are sorted in fingerprint order rather than byte order: ties
are all that matters here.  Keys travel packed, one array per block of texts and bucket; the answer of a bucket is a
bit per key, and returns to the block.  A string that a third of the texts hold is one key per block of texts.  A task
holds one bucket or one block, both of bounded size; buckets grow in number with the input.  The texts are shuffled
once, and every step reads that one exchange again.  A task has one worker at a time.

Defined cases: null text is empty; a text shorter than LENGTH loses nothing; texts that are equal throughout lose all
of their bytes if they have LENGTH of them; an empty table gives no rows; offsets may cut a UTF-8 character, in which
case the remaining bytes of the cut character go from the text column of the operator (the digest columns keep bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bytescan import Rolling, mix, pack_keys, texts_of, trim, unpack_keys
from llm.common import small_batches

LENGTH = 200
PERIOD = 133
#: A perfect difference set modulo 133: every shift is a difference of two of these (fixed values).
COVER = np.array([0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109])
BLOCK = LENGTH - PERIOD + 1
PIECE = 4 << 20  # bytes of text in a block
RANK_BYTES, KEY_BYTES = 5, 8  # of the keys of sampled blocks, and of runs and prefixes
CUTS = np.uint64(15)
IN_COVER = np.isin(np.arange(PERIOD), COVER)


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(block, rows, data, ends): texts packed into blocks of about PIECE bytes; rows holds the other columns as one array.

    A text is never cut; one longer than PIECE is a block of its own.
    """
    others = [c for c in docs.columns if c != text]
    inner = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), F.col(f"`{text}`").alias("text")) if others else docs.select(F.struct(F.lit(0).alias("c0")).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = inner.schema["row"].dataType.simpleString()
    schema = f"block long, rows array<{kind}>, data binary, ends binary, blank array<boolean>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() << 33)
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            rows, empty = batch.column(0), batch.column(1).is_null()
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
                to = min(to, len(batch))
                part = rows.slice(at, to - at)
                one = pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), part)
                ends = (offsets[at : to + 1] - offsets[at]).astype("<i8")
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), one, pa.array([data[offsets[at] : offsets[to]].tobytes()], pa.binary()),
                    pa.array([ends.tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), empty.slice(at, to - at)),
                ], ["block", "rows", "data", "ends", "blank"])
                number += 1
                at = to

    return inner.mapInArrow(pack, schema)


def sample(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, Rolling, np.ndarray]:
    """Positions of the cover sample with a whole block in their text; the fingerprints; text starts."""
    starts, sizes = ends[:-1], np.diff(ends)
    whole = [s + p for s, n in zip(starts, sizes) if n >= LENGTH for p in (_sampled(int(n) - BLOCK + 1),)]
    at = np.concatenate(whole) if whole else np.zeros(0, np.int64)
    return at, Rolling(data), starts


_positions = np.flatnonzero(IN_COVER[np.arange(1 << 20) % PERIOD]).astype(np.int64)


def _sampled(n: int) -> np.ndarray:
    """Cover positions below n."""
    global _positions
    if n > (1 << 20) and (not len(_positions) or n > _positions[-1]):
        _positions = np.flatnonzero(IN_COVER[np.arange(2 * n) % PERIOD]).astype(np.int64)
    return _positions[: np.searchsorted(_positions, n)]


def open_suffixes(data: np.ndarray, ends: np.ndarray, at: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Starts of LENGTH bytes within one text that have a tied sample block inside, as the difference cover requires."""
    n = len(data)
    step = np.zeros(n + 1, np.int32)
    hot = at[tied]
    low = np.maximum(hot - PERIOD + 1, 0)
    step += np.bincount(low, minlength=n + 1).astype(np.int32)
    step -= np.bincount(hot + 1, minlength=n + 1).astype(np.int32)[: n + 1]
    maybe = np.cumsum(step)[:n] > 0
    for s, e in zip(ends[:-1], ends[1:]):  # a start needs LENGTH bytes in its own text
        maybe[max(s, e - LENGTH + 1) : e] = False
    return np.flatnonzero(maybe)


def bucket_bounds(order: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys; the bucket of a key is its place in the key range."""
    width = (1 << 64) // buckets + 1
    inner = np.searchsorted(order, np.array([min(b * width, (1 << 64) - 1) for b in range(1, buckets)], dtype=np.uint64))
    return np.concatenate([[0], inner, [len(order)]])


def settle(keys: DataFrame, size: int) -> DataFrame:
    """Sort one bucket of (block, bucket, keys, many) at a time; per block, bits of its keys: tied, then leading."""

    def one(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("block")))  # the least block leads, in any order of arrival
        many = [np.unpackbits(np.frombuffer(m, np.uint8)).astype(bool) for m in table.column("many").to_pylist()]
        parts = [unpack_keys(b, size) for b in table.column("keys").to_pylist()]
        whole = np.concatenate(parts)
        twice = np.concatenate([m[: len(p)] for m, p in zip(many, parts)])
        order = np.argsort(whole, kind="stable")
        ranked = whole[order]
        same = ranked[1:] == ranked[:-1]
        tied, lead = np.zeros(len(ranked), bool), np.ones(len(ranked), bool)
        tied[order[1:]] = same
        tied[order[:-1]] |= same
        lead[order[1:]] = ~same
        tied |= twice
        ends = np.cumsum([0] + [len(p) for p in parts])
        bits = [np.packbits(np.concatenate([tied[x:y], lead[x:y]])).tobytes() for x, y in zip(ends[:-1], ends[1:])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return keys.groupBy("bucket").applyInArrow(one, "block long, bucket int, bits binary")


def _send(block: int, keys: np.ndarray, buckets: int, size: int) -> pa.RecordBatch:
    order, count = np.unique(keys >> np.uint64(8 * (8 - size)) << np.uint64(8 * (8 - size)), return_counts=True)
    bounds = bucket_bounds(order, buckets)
    used = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
    return pa.RecordBatch.from_arrays([
        pa.array([block] * len(used), pa.int64()), pa.array(used, pa.int32()),
        pa.array([pack_keys(order[bounds[b] : bounds[b + 1]], size) for b in used], pa.binary()),
        pa.array([np.packbits(count[bounds[b] : bounds[b + 1]] > 1).tobytes() for b in used], pa.binary()),
    ], ["block", "bucket", "keys", "many"])


def _receive(keys: np.ndarray, buckets: int, size: int, answer: list | None) -> tuple[np.ndarray, np.ndarray]:
    """The answer for every key: whether it is tied, and whether this place is the first of the block that leads."""
    cut = keys >> np.uint64(8 * (8 - size)) << np.uint64(8 * (8 - size))
    order, first, back = np.unique(cut, return_index=True, return_inverse=True)
    bounds = bucket_bounds(order, buckets)
    tied, lead = np.zeros(len(order), bool), np.zeros(len(order), bool)
    for a in answer or ():
        x, y = bounds[a["bucket"]], bounds[a["bucket"] + 1]
        bits = np.unpackbits(np.frombuffer(a["bits"], np.uint8)).astype(bool)
        tied[x:y], lead[x:y] = bits[: y - x], bits[y - x : 2 * (y - x)]
    leads = np.zeros(len(keys), bool)
    leads[first[lead]] = True
    return tied[back], leads


def runs_of(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of consecutive starts, cut before keys that end in zero bits."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) > 1) | (keys[1:] & CUTS == 0)
    first = np.flatnonzero(new)
    return first, np.concatenate([first[1:], [len(starts)]]) - 1


def _first_keys(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, Rolling]:
    at, rolling, _ = sample(data, ends)
    return at, mix(rolling.of(at, at + BLOCK)), rolling


def repeated_spans(docs: DataFrame, told: str, then: Callable, text: str = "text", buckets: int | None = None) -> DataFrame:
    """What then makes, with the schema told, of the blocks of docs with the removed spans: (rows, data, ends, blank, spans),
    spans as pairs of byte offsets in the block.

    then runs in the worker that finds the spans: a second one would hold the block and a model of its own.  {row} in
    told stands for the type of an element of rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 2 * parts
    packed = blocks(docs, text).repartition(parts, "block")

    def arrays(row) -> tuple[int, np.ndarray, np.ndarray]:
        return row["block"], np.frombuffer(row["data"], np.uint8), np.frombuffer(row["ends"], "<i8")

    def each(batches):
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                yield one, one.select([c for c in one.schema.names if c not in ("rows", "blank")]).to_pylist()[0]
                trim()

    def rank(batches):
        for _, row in each(batches):
            block, data, ends = arrays(row)
            yield _send(block, _first_keys(data, ends)[1], buckets, RANK_BYTES)

    def suffixes(row):
        block, data, ends = arrays(row)
        at, keys, rolling = _first_keys(data, ends)
        tied, _ = _receive(keys, buckets, RANK_BYTES, row["ranks"])
        starts = open_suffixes(data, ends, at, tied)
        keys = mix(rolling.of(starts, starts + LENGTH))
        first, last = runs_of(starts, keys)
        length = starts[last] - starts[first]
        run_keys = mix(rolling.of(starts[first], starts[last] + LENGTH) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return block, ends, starts, keys, last - first + 1, run_keys

    def runs(batches):
        for _, row in each(batches):
            block, _, _, _, _, run_keys = suffixes(row)
            yield _send(block, run_keys, buckets, KEY_BYTES)

    def unsettled(row):
        block, ends, starts, keys, size, run_keys = suffixes(row)
        tied, lead = _receive(run_keys, buckets, KEY_BYTES, row["runs"])
        return block, ends, starts, keys, np.repeat(tied, size), np.repeat(~tied | lead, size)

    def prefix(batches):
        for _, row in each(batches):
            block, _, _, keys, _, show = unsettled(row)
            yield _send(block, keys[show], buckets, KEY_BYTES)

    def spans(row) -> bytes:
        _, ends, starts, keys, hit, show = unsettled(row)
        hit[show] |= _receive(keys[show], buckets, KEY_BYTES, row["prefixes"])[0]
        return merged(starts[hit], ends).astype("<i8").tobytes()

    def drop(batches):
        for one, row in each(batches):
            found = pa.array([spans(row)], pa.binary())
            del row  # then reads the block again
            yield pa.RecordBatch.from_arrays(
                [*(one.column(c) for c in ("rows", "data", "ends", "blank")), found], ["rows", "data", "ends", "blank", "spans"])

    def answers(sent: DataFrame, size: int, name: str) -> DataFrame:
        # as many rows per block as there are buckets: bounded by the size of the block
        return settle(sent, size).groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    schema = "block long, bucket int, keys binary, many binary"
    kind = packed.schema["rows"].dataType.elementType.simpleString()
    ranked = packed.join(answers(packed.mapInArrow(rank, schema), RANK_BYTES, "ranks"), "block", "left")
    run = ranked.join(answers(ranked.mapInArrow(runs, schema), KEY_BYTES, "runs"), "block", "left")
    full = run.join(answers(run.mapInArrow(prefix, schema), KEY_BYTES, "prefixes"), "block", "left")
    return full.mapInArrow(lambda batches: then(drop(batches)), told.replace("{row}", kind))


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes (start, end) that the strings at these sorted starts cover; texts are kept apart."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    text = np.searchsorted(ends, starts, side="right")
    cut = np.flatnonzero((np.diff(starts) > LENGTH) | (np.diff(text) > 0)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(starts)]]) - 1
    return np.stack([starts[first], starts[last] + LENGTH], axis=1)


def _each(row) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(index, bytes of the text, its spans relative to it) of every text of a block."""
    ends = np.frombuffer(row["ends"], "<i8")
    spans = np.frombuffer(row["spans"], "<i8").reshape(-1, 2)
    by = np.searchsorted(spans[:, 0], ends)
    for k in range(len(ends) - 1):
        yield k, row["data"][ends[k] : ends[k + 1]], spans[by[k] : by[k + 1]] - ends[k]


def keep(text: bytes, spans: np.ndarray) -> bytes:
    """The bytes outside the spans."""
    if not len(spans):
        return text
    edges = [0, *spans.reshape(-1).tolist(), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and SHA-256 of the kept bytes."""

    def work(batches):
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                row = one.select(["data", "ends", "spans"]).to_pylist()[0]
                size, gone, count, sha = [], [], [], []
                for _, text, spans in _each(row):
                    size.append(len(text))
                    gone.append(int((spans[:, 1] - spans[:, 0]).sum()))
                    count.append(len(spans))
                    sha.append(hashlib.sha256(keep(text, spans)).hexdigest())
                yield pa.RecordBatch.from_arrays([
                    one.column("rows").flatten().field(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(count, pa.int64()), pa.array(sha, pa.string()),
                ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_spans(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", work)


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the repeated strings taken out of the text; null stays null, and all rows remain."""
    names = docs.columns
    others = [c for c in names if c != text]

    def work(batches):
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                row = one.select(["data", "ends", "spans"]).to_pylist()[0]
                kept = [keep(t, s).decode("utf-8", "ignore") for _, t, s in _each(row)]
                blank = one.column("blank").flatten().to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [one.column("rows").flatten(), pa.array([None if b else t for b, t in zip(blank, kept)], pa.string())], ["row", "text"])

    out = repeated_spans(docs, "row {row}, text string", work, text)
    at = {c: F.col(f"row.c{i}") for i, c in enumerate(others)}
    return out.select(*[F.col("text").alias(text) if c == text else at[c].alias(c) for c in names])


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
