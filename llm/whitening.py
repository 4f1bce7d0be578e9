"""Embedding whitening by a bit-sliced scatter.

Vectors become whole numbers x = floor(64 c) + 1000000.  The fit list is each distinct x vector once.  A task takes
blocks of it, subtracts each dimension's least value, packs every bit of every dimension across the rows of the block
into 64-bit words, and gets sum(u_i u_j) as the popcounts of the ANDs of two planes, weighted by two to the sum of
their bits.  The shift is undone in whole numbers, so sums and cross-products are exact however the rows are dealt.
Per task there is one row per pair of dimensions; Spark adds these up.  The scatter n * P - S S' is centred as whole
numbers on the driver (its size is that of the model) and goes to eigh; the rows are then projected in Arrow batches.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are dropped.  64 c beyond 2**62 stays at
2**62.  Vectors of different length are spaces of their own: each length has its own n, components and covariance.
A component without variance has no whitened value and is left out, so there are fewer than 16 where the fit list has
fewer (none for a single distinct vector, and none for an empty vector).  Repeated rows count once in the fit and are
all returned.  A deviation beyond 38 digits (64 bits in the query) is null.  An empty table gives no rows.  Columns of
the input stay; those named like a column of the result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import join_small, small_batches, table

SCALE, OFFSET, EDGE = 64, 1_000_000, 1 << 62
COMPONENTS = 16
BLOCK = 8192  # rows whose planes are packed together
LIMB = 60  # sums travel as high * 2**LIMB + low, so Spark's decimals can't overflow
RESULT = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def whole_numbers(vector: Column) -> Column:
    """x of each entry; entries are known to be finite."""
    edge = F.lit(float(EDGE))
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, -edge), edge)) + OFFSET)


def usable(vector: Column) -> Column:
    inf = F.lit(float("inf"))  # NaN is greater than infinity here
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (c.cast("double") < inf) & (c.cast("double") > -inf))


def planes_of(shifted: np.ndarray, width: np.ndarray) -> np.ndarray:
    """One row of 64-bit words per (dimension, bit): the bit of all rows of the block."""
    rows = len(shifted)
    dim = np.repeat(np.arange(len(width)), width)
    bit = np.concatenate([np.arange(w) for w in width]).astype(np.uint64)
    bits = np.zeros((-(-rows // 64) * 64, len(dim)), np.uint8)
    bits[:rows] = (shifted[:, dim] >> bit) & np.uint64(1)
    return np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)


def cross_products(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums per dimension and sums of products per pair of dimensions, as Python whole numbers."""
    rows, dims = block.shape
    low = block.min(axis=0)
    shifted = block.view(np.uint64) - low.view(np.uint64)
    width = np.array([int(m).bit_length() for m in shifted.max(axis=0)])
    sums = np.zeros(dims, object)
    products = np.zeros((dims, dims), object)
    used = np.flatnonzero(width)
    if len(used):
        width = width[used]
        planes = planes_of(shifted[:, used], width)
        counts = np.empty((len(planes), len(planes)), np.int64)
        for p, plane in enumerate(planes):
            counts[p, p:] = np.bitwise_count(plane & planes[p:]).sum(axis=1, dtype=np.int64)
            counts[p:, p] = counts[p, p:]
        kind = np.int64 if 2 * int(width.max()) + rows.bit_length() < 63 else object
        weight = np.array([1 << int(b) for w in width for b in range(w)], kind)
        starts = np.concatenate([[0], np.cumsum(width)[:-1]])
        weighted = counts.astype(kind) * weight[:, None] * weight[None, :]
        products[np.ix_(used, used)] = np.add.reduceat(np.add.reduceat(weighted, starts, axis=0), starts, axis=1).astype(object)
        sums[used] = np.add.reduceat(counts.diagonal().astype(kind) * weight, starts).astype(object)
    base = low.astype(object)
    products = products + np.outer(base, sums) + np.outer(sums, base) + rows * np.outer(base, base)
    return sums + rows * base, products


def matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in a batch."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    for dims in np.unique(lengths):
        rows = np.flatnonzero(lengths == dims)
        yield rows, values[starts[rows][:, None] + np.arange(dims)]


def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, i, j, high, low) of a task: sums of products for j >= i, sums at j = -1, the row count at i = j = -1."""
    found: dict[int, list] = {}
    for batch in batches:
        for _, matrix in matrices(batch.column(0)):
            for at in range(0, len(matrix), BLOCK):
                block = np.ascontiguousarray(matrix[at : at + BLOCK])
                sums, products = cross_products(block) if block.shape[1] else (np.zeros(0, object), np.zeros((0, 0), object))
                old = found.get(block.shape[1])
                new = [len(block), sums, products]
                found[block.shape[1]] = new if old is None else [a + b for a, b in zip(old, new)]
    for dims, (n, sums, products) in found.items():
        for i in range(-1, dims):
            values = [n] if i < 0 else [sums[i], *products[i, i:]]
            parts = [divmod(int(v), 1 << LIMB) for v in values]
            yield pa.RecordBatch.from_arrays([
                pa.array([dims] * len(values), pa.int32()), pa.array([i] * len(values), pa.int32()),
                pa.array([-1, *range(max(i, 0), dims)][: len(values)], pa.int32()),
                pa.array([Decimal(h) for h, _ in parts], pa.decimal128(38, 0)), pa.array([Decimal(v) for _, v in parts], pa.decimal128(38, 0)),
            ], ["dims", "i", "j", "high", "low"])


@dataclass
class Model:
    """Whitening of vectors of one length: exact n and sums, the components by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def solve(n: int, sums: list[int], products: np.ndarray, components: int = COMPONENTS) -> Model:
    """Components of the covariance; products is exact (objects)."""
    dims = len(sums)
    s = np.array(sums, object)
    square = n * n
    # true division of whole numbers rounds once
    cov = np.array([[int(v) / square for v in row] for row in n * products - np.outer(s, s)], float).reshape(dims, dims)
    if not dims or not cov.diagonal().sum() > 0:
        return Model(n, sums, np.zeros((0, dims)), np.zeros(0), np.zeros(0), 0.0)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > values.max() * dims * np.finfo(float).eps]
    values, vectors = values[order], vectors[:, order].T
    white = vectors / np.sqrt(values)[:, None]
    error = np.abs(white @ cov @ white.T - np.eye(len(values))).max()
    return Model(n, sums, vectors, values, values / cov.diagonal().sum(), float(error))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """vectors: one column x of whole-number arrays, in any number of copies.  One model per length.

    The driver gets dims * (dims + 3) / 2 + 1 rows per length, whatever the number of rows.
    """
    partial = vectors.distinct().mapInArrow(scatter, "dims int, i int, j int, high decimal(38,0), low decimal(38,0)")
    total = partial.groupBy("dims", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found: dict[int, dict] = {}
    for r in total.collect():
        found.setdefault(r.dims, {})[r.i, r.j] = (int(r.high) << LIMB) + int(r.low)
    models = {}
    for dims, cells in found.items():
        products = np.zeros((dims, dims), object)
        for (i, j), v in cells.items():
            if i >= 0 and j >= 0:
                products[i, j] = products[j, i] = v
        models[dims] = solve(cells[-1, -1], [cells[i, -1] for i in range(dims)], products, components)
    return models


def projector(models: dict[int, Model]):
    """Arrow function: x arrays to (exact deviation, whitened values by component)."""
    kind = pa.struct([("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    def project(x: pa.Array) -> pa.Array:
        deviation = np.zeros(len(x), object)
        whitened: list = [[]] * len(x)
        for rows, matrix in matrices(x):
            model = models[matrix.shape[1]]
            base = np.array([s // model.n for s in model.sums], np.int64)
            rest = [s - model.n * int(b) for s, b in zip(model.sums, base)]
            # 64 bits where they hold it, Python's whole numbers beyond
            near = matrix.size == 0 or np.abs(matrix).max() < EDGE
            off = matrix - base if near else matrix.astype(object) - base.astype(object)
            widest = (int(np.abs(off).max()) + 1) * model.n if off.size else 0
            exact = off * model.n - np.array(rest, np.int64) if widest < EDGE else off.astype(object) * model.n - np.array(rest, object)
            wide = exact if widest * widest * max(len(rest), 1) < EDGE else exact.astype(object)
            deviation[rows] = (wide * wide).sum(axis=1)
            out = (exact / model.n).astype(float) @ model.components.T / np.sqrt(model.values)
            for r, values in zip(rows, out):
                whitened[r] = values
        return pa.StructArray.from_arrays([
            pa.array([Decimal(int(v)) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)),
            pa.array(whitened, pa.list_(pa.float64())),
        ], fields=list(kind))

    project.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(project, "struct<deviation decimal(38,0), whitened array<double>>")


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: the columns of rows, and those of RESULT (deviation as decimal(38,0))."""
    spark = rows.sparkSession
    small_batches(spark)
    keep = [c for c in rows.columns if c not in RESULT]
    good = rows.filter(usable(F.col(f"`{vector}`"))).select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"),
        whole_numbers(F.col(f"`{vector}`")).alias("x"))
    models = fit(good.select("x"), components)
    facts = [(d, k, m.n, float(m.explained[k]), m.identity_error) for d, m in models.items() for k in range(len(m.values))]
    told = spark.createDataFrame(facts, "dims int, component int, n long, explained double, identity_error double")
    # the projection runs once: explode keeps Spark from merging it into the columns that read it
    done = good.select("row", F.size("x").alias("dims"), F.explode(F.array(projector(models)("x"))).alias("out"))
    long = done.select("row", "dims", F.col("out.deviation").alias("deviation"), F.posexplode("out.whitened").alias("component", "whitened"))
    return join_small(long, told, ["dims", "component"], "inner", rows=len(facts)).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)],
        (F.col("component") + 1).alias("component"), "n", "deviation", "whitened", "explained", "identity_error")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    done = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return done.select("vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error")
