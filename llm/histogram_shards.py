"""Sharding by histogram sort (native expressions only): shards of nearly equal bytes.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours.  Shard k of n begins where the bytes
below reach k/n of all.  The boundaries are found by counting: each round counts the exact bytes in the cells of the
next DIGIT bits of the key, only inside the cells that hold a boundary, and so refines all probes at once, until the
cell of a boundary weighs no more than TOLERANCE of a shard (or is a single key).  A small group of equal texts is
thus never split; a group heavier than that is split by doc_id, so a hot text can't fill one shard.  Then the rows
are exchanged once and written; slots come from one small count per written partition.

Per round the driver gets 2**DIGIT rows a boundary at most, whatever the size of the input.

Defined cases: null text has size 1 (nothing plus 1); null doc_id comes first; rows equal in text and doc_id stay
together; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import join_small, stored

SHARDS = 8
DIGIT = 11
TOLERANCE = 1 / 2000
LEVELS = -(-64 // DIGIT)  # digits of the hash, then as many of doc_id


def _digits(key: str, level: int) -> Column:
    """The key without the bits below the digits 0 .. level; keeps the order of signed numbers."""
    low = max(64 - DIGIT * (level + 1), 0)
    return F.shiftright(F.col(key), low) if low < 64 else F.lit(0)


def boundaries(sizes: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The least keys (hash, id) of shards 1 .. shards - 1.  sizes: (h, d, size), read once a round."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    # state of a boundary: digits fixed so far, value of the cell, bytes below the cell; found: (h, d)
    open_ = {k: (0, None, None, 0) for k in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    lowest = -(1 << 63)
    while open_:
        cells = sorted({(lv, h, d) for lv, h, d, _ in open_.values()}, key=str)
        levels = sorted({c[0] for c in cells})
        got: dict[tuple, list[tuple[int, int, int]]] = {}
        for lv in levels:  # the boundaries move together, so there is mostly one level
            key, deep = ("h", lv) if lv < LEVELS else ("d", lv - LEVELS)
            inside = F.lit(False)
            for _, h, d in (c for c in cells if c[0] == lv):
                one = F.lit(True)
                if lv and lv <= LEVELS:
                    one = _digits("h", lv - 1) == h
                elif lv > LEVELS:
                    one = (F.col("h") == h) & (_digits("d", deep - 1) == d)
                inside = inside | one
            rows = sizes.filter(inside).groupBy(
                (_digits("h", lv - 1) if 0 < lv <= LEVELS else F.col("h") if lv else F.lit(0)).alias("ph"),
                (_digits("d", deep - 1) if lv > LEVELS else F.lit(0)).alias("pd"),
                _digits(key, deep).alias("cell"),
            ).agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
            for r in rows:
                got.setdefault((lv, r["ph"] if lv else None, r["pd"] if lv > LEVELS else None), []).append((r["cell"], r["n"], r["rows"]))
        nxt = {}
        for k, (lv, h, d, below) in open_.items():
            want = total * k / shards
            key_level = lv if lv < LEVELS else lv - LEVELS
            low = max(64 - DIGIT * (key_level + 1), 0)
            cells_here = sorted(got.get((lv, h, d), []))
            if not cells_here:
                found[k] = (lowest, lowest)
                continue
            for i, (cell, n, rows) in enumerate(cells_here):
                if below + n >= want or i == len(cells_here) - 1:
                    break
                below += n
            last = lv == 2 * LEVELS - 1
            if n <= slack or rows == 1 or last:  # the nearer edge of the cell
                upper = abs(below + n - want) < abs(below - want)
                edge = (cell + 1 if upper else cell) << low
                if lv < LEVELS:
                    found[k] = (min(edge, (1 << 63) - 1), lowest) if edge < (1 << 63) else ((1 << 63) - 1, (1 << 63) - 1)
                else:
                    found[k] = (h, min(edge, (1 << 63) - 1))
            elif lv < LEVELS:
                nxt[k] = (lv + 1, cell, None, below)
            else:
                nxt[k] = (lv + 1, h, cell, below)
        open_ = nxt
    return [found[k] for k in sorted(found)]


def shard_of(edges: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or below the key (h, d)."""
    out = F.lit(0)
    for h, d in edges:
        out = out + ((F.col("h") > h) | ((F.col("h") == h) & (F.col("d") >= d))).cast("int")
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """docs with _size, _shard and _slot (gapless from 0 within the shard, in the order of the sort)."""
    docs = docs.drop("_size", "_shard", "_slot")
    names = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(
        F.struct(*names).alias("row"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h"),
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("d"),
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("long").alias("size"))
    edges = boundaries(stored(rows.select("h", "d", "size"), "sizes"), shards, tolerance)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.withColumn("shard", shard_of(edges)).repartitionByRange(parts, "shard", "h", "d").sortWithinPartitions("shard", "h", "d")
    # the written rows keep their partition and place, so both passes below see one numbering
    laid = stored(laid.withColumn("part", F.spark_partition_id()).withColumn("seat", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "shards")
    from pyspark.sql import Window

    ends = laid.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("seat").alias("low"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    ends = ends.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    out = join_small(laid, stored(ends, "ends"), ["shard", "part"])
    return out.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)],
        F.col("size").alias("_size"), F.col("shard").alias("_shard"), (F.col("seat") + F.col("shift")).alias("_slot"))


def op7_histogram_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select(
        "doc_id", F.col("_size").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
