"""Local outlier factor (Breunig et al., 2000) with exact neighbours.

Equal rows are first collapsed into one point with a weight, so frequent values cannot make a group hot.
A point set up to ``broadcast_points`` is sent to the tasks.  Beyond that, points are assigned to the
nearest of a set of sampled pivots; a point is compared with the other cells only where the triangle
inequality leaves a chance of a nearer neighbour, which is exact and avoids comparing all pairs.  At row level, with
millions of distinct points, ask for ``trees``: beyond ``broadcast_points`` a forest finds the neighbours, nearly all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ...scratch import materialize
from ..ordering import POS, PART, lay_out, number_rows
from . import neighbour_forest

BROADCAST_POINTS = 20_000
CELL_POINTS = 2_000
MAX_PIVOTS = 4_096
VISIT_ROWS = 20_000
NEAR_SCHEMA = "point long, neighbour long, dist double, weight long"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences: equal points are at distance 0 exactly."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += np.square(a[:, j, None] - b[None, :, j])
    return np.sqrt(out)


def _nearest(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, weights: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest other points of each row (each stands for ``weight`` copies), ties by id."""
    parts = []
    step = max(1, 2_000_000 // max(len(y), 1))
    for at in range(0, len(x), step):
        d = _distances(x[at:at + step], y)
        d[ids[at:at + step, None] == other_ids[None, :]] = np.inf
        keep = min(k, len(y))
        order = np.lexsort((np.broadcast_to(other_ids, d.shape), d), axis=1)[:, :keep]
        rows = np.repeat(np.arange(len(d)), order.shape[1])
        cols = order.ravel()
        dist = d[rows, cols]
        ok = np.isfinite(dist)
        parts.append(pd.DataFrame({
            "point": ids[at:at + step][rows][ok], "neighbour": other_ids[cols][ok],
            "dist": dist[ok], "weight": weights[cols][ok],
        }))
    return pd.concat(parts) if parts else pd.DataFrame(columns=["point", "neighbour", "dist", "weight"])


def points(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows as (point, x, weight); written once, because later steps refer to the numbering."""
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    distinct = df.select(vec.alias("x")).groupBy("x").agg(F.count("*").alias("weight"))
    return number_rows(lay_out(distinct, ["x"], "points"), "point").drop(PART, POS)


def _neighbours_small(pts: DataFrame, k: int, asking: DataFrame) -> DataFrame:
    everyone = pts.select("point", "x", "weight").toPandas()
    shared = pts.sparkSession.sparkContext.broadcast(
        (everyone["point"].to_numpy(), _matrix(everyone["x"]), everyone["weight"].to_numpy())
    )

    def search(batches):
        ids, y, weights = shared.value
        for pdf in batches:
            yield _nearest(pdf["point"].to_numpy(), _matrix(pdf["x"]), ids, y, weights, k)

    return asking.select("point", "x").repartition("point").mapInPandas(search, NEAR_SCHEMA)


def _neighbours_large(pts: DataFrame, k: int, n: int, cell_points: int, asking: DataFrame) -> DataFrame:
    spark = pts.sparkSession
    count = int(min(MAX_PIVOTS, max(2, -(-n // cell_points))))
    sampled = pts.orderBy(F.xxhash64("point"), "point").limit(count).toPandas()
    pivots = spark.sparkContext.broadcast(_matrix(sampled["x"]))

    def assign(batches):
        for pdf in batches:
            d = _distances(_matrix(pdf["x"]), pivots.value)
            yield pdf.assign(cell=d.argmin(axis=1), reach=d.min(axis=1))

    schema = "point long, x array<double>, weight long, cell long, reach double"
    celled = materialize(pts.mapInPandas(assign, schema), "cells")
    askers = celled if asking is pts else materialize(asking.mapInPandas(assign, schema), "askers")
    cells = celled.groupBy("cell").agg(F.max("reach").alias("radius")).toPandas()
    radius = np.full(count, -np.inf)
    radius[cells["cell"].to_numpy()] = cells["radius"].to_numpy()
    radii = spark.sparkContext.broadcast(radius)

    # The points of a cell among themselves: an upper bound of the distance to the k-th neighbour.
    own = _search_cells(askers.select("point", "x", "cell"), celled, k)
    bound = own.groupBy("point").agg(F.when(F.count("*") >= k, F.max("dist")).alias("bound"))

    def visits(batches):
        for pdf in batches:
            d = _distances(_matrix(pdf["x"]), pivots.value)
            limit = pdf["bound"].fillna(np.inf).to_numpy()
            # a hair of slack, so that rounding never drops a cell
            reachable = d - radii.value[None, :] <= limit[:, None] * (1 + 1e-9) + 1e-12
            reachable &= np.isfinite(radii.value)[None, :]
            reachable[np.arange(len(pdf)), pdf["cell"].to_numpy()] = False
            rows, cells_hit = np.nonzero(reachable)
            yield pd.DataFrame({
                "point": pdf["point"].to_numpy()[rows], "x": pdf["x"].to_numpy()[rows], "cell": cells_hit,
            })

    travelling = askers.join(bound, "point", "left").select("point", "x", "cell", "bound").mapInPandas(
        visits, "point long, x array<double>, cell long"
    )
    return own.unionByName(_search_cells(materialize(travelling, "visits"), celled, k))


def _search_cells(visitors: DataFrame, celled: DataFrame, k: int, search=None) -> DataFrame:
    """Nearest members of a cell for its visitors (by ``search``, if not all are to be compared); a cell with many visitors
    is served by several tasks."""
    load = visitors.groupBy("cell").agg(F.ceil(F.count("*") / VISIT_ROWS).cast("int").alias("_tasks"))
    asked = visitors.join(F.broadcast(load), "cell").withColumn("_task", F.pmod(F.xxhash64("point"), "_tasks").cast("int"))
    served = (
        celled.join(F.broadcast(load), "cell")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)))
        .select(
            F.col("cell").alias("home"), "_copy", F.col("point").alias("member"), F.col("x").alias("y"),
            F.col("weight").alias("copies"),
        )
    )

    def meet(who: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if who.empty or there.empty:
            return pd.DataFrame({"point": [], "neighbour": [], "dist": [], "weight": []})
        both = (
            who["point"].to_numpy(), _matrix(who["x"]), there["member"].to_numpy(), _matrix(there["y"]),
            there["copies"].to_numpy(), k,
        )
        return search(int(who["cell"].iloc[0]), *both) if search else _nearest(*both)

    return asked.drop("_tasks").groupBy("cell", "_task").cogroup(
        served.groupBy("home", "_copy")
    ).applyInPandas(meet, NEAR_SCHEMA)


def neighbours(
    pts: DataFrame, k: int, broadcast_points: int = BROADCAST_POINTS, cell_points: int = CELL_POINTS, trees: int = 0
) -> DataFrame:
    """(point, neighbour, dist, used): the neighbours of one copy of each point, ``used`` copies each.

    The other copies of the point itself come first, at distance 0.
    """
    found = _found(pts, k, broadcast_points, cell_points, pts, trees)
    copies = pts.filter(F.col("weight") > 1).select(
        "point", F.col("point").alias("neighbour"), F.lit(0.0).alias("dist"), (F.col("weight") - 1).alias("weight")
    )
    return _pick(found.unionByName(copies), k)


def _found(pts: DataFrame, k: int, broadcast_points: int, cell_points: int, asking: DataFrame, trees: int = 0) -> DataFrame:
    n = pts.count()
    if n <= broadcast_points:
        return _neighbours_small(pts, k, asking)
    if trees:
        return neighbour_forest.neighbours(pts, k, n, asking, trees)
    return _neighbours_large(pts, k, n, cell_points, asking)


def _pick(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` copies of neighbours of each point, by distance."""
    nearest = W.partitionBy("point").orderBy("dist", F.col("neighbour") != F.col("point"), "neighbour")
    before = F.coalesce(F.sum("weight").over(nearest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        found
        .withColumn("_rn", F.row_number().over(nearest))
        .filter(F.col("_rn") <= k)
        .withColumn("_before", before)
        .filter(F.col("_before") < k)
        .select("point", "neighbour", "dist", F.least(F.col("weight"), k - F.col("_before")).alias("used"))
    )


def score(df: DataFrame, cols: list[str], k: int = 20, **limits) -> DataFrame:
    """Adds ``anomaly_score``, the local outlier factor of each row among all rows; ``limits`` are those of ``neighbours``."""
    pts = points(df, cols)
    near = materialize(neighbours(pts, k, **limits), "neighbours")
    reach, density = _densities(near)
    return _with_factors(df, cols, pts, _factors(near, density, density))


def score_new(df: DataFrame, train: DataFrame, cols: list[str], k: int = 20, **limits) -> DataFrame:
    """Adds ``anomaly_score`` of new rows: neighbours, distances and densities are those of the training rows alone."""
    known = points(train, cols)
    reach, density = _densities(materialize(neighbours(known, k, **limits), "neighbours"))
    pts = points(df, cols)
    # numbers below zero, so that a new point is never taken for a training point of the same number
    asking = pts.withColumn("point", -1 - F.col("point"))
    found = _found(known, k, limits.get("broadcast_points", BROADCAST_POINTS), limits.get("cell_points", CELL_POINTS), asking, limits.get("trees", 0))
    near = materialize(_pick(found, k), "neighbours")
    own = _density(near, reach)
    return _with_factors(df, cols, asking, _factors(near, density, own))


def _densities(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    reach = near.groupBy("point").agg(F.max("dist").alias("k_dist"))
    return reach, _density(near, reach)


def _density(near: DataFrame, reach: DataFrame) -> DataFrame:
    """(point, lrd): local reachability density; ``reach`` is (point, k_dist) of the neighbours."""
    return (
        near.join(reach.withColumnRenamed("point", "neighbour"), "neighbour")
        .groupBy("point")
        .agg((F.sum(F.greatest("dist", "k_dist") * F.col("used")) / F.sum("used")).alias("_mean"))
        .select("point", (1 / (F.col("_mean") + 1e-10)).alias("lrd"))
    )


def _factors(near: DataFrame, density: DataFrame, own: DataFrame) -> DataFrame:
    around = (
        near.join(density.select(F.col("point").alias("neighbour"), F.col("lrd").alias("_other")), "neighbour")
        .groupBy("point")
        .agg((F.sum(F.col("_other") * F.col("used")) / F.sum("used")).alias("_around"))
    )
    return around.join(own, "point").select("point", (F.col("_around") / F.col("lrd")).alias("anomaly_score"))


def _with_factors(df: DataFrame, cols: list[str], pts: DataFrame, factors: DataFrame) -> DataFrame:
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    per_value = pts.join(factors, "point").select(F.col("x").alias("_x"), "anomaly_score")
    return df.withColumn("_x", vec).join(per_value, "_x", "left").drop("_x")
