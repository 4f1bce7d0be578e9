"""Nearest neighbours by a forest of random splits, for point sets too large for the exact cell search.

Each tree splits the space by hyperplanes, at the median of a bounded sample of the points, into groups of about
``GROUP_POINTS``.  A task gets one group of one tree, splits it further by the medians of the group itself down to
``LEAF_POINTS``, and compares the points of a leaf with each other: distances by a matrix product choose a short list,
whose distances are then computed by differences.  The nearest over all trees are a point's neighbours, so every distance
is exact and only a neighbour that shares no leaf with its point in any tree is missed (``recall`` measures how many).

The driver holds the sample (at most ``SAMPLE_POINTS``) and the splits (at most 2 ** MOST_DEPTH a tree).  Points are
distinct, so a group can't be made of copies; many askers of one group are served by several tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ...scratch import materialize

TREES = 6
GROUP_POINTS = 16_000
LEAF_POINTS = 500
MOST_DEPTH = 13
SAMPLE_POINTS = 1 << 18
SPARE = 8  # of the short list, beyond k: what rounding in the matrix product may displace


def _grow(rng: np.random.Generator, x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and limits of a full binary tree: node i has the children 2i + 1 and 2i + 2."""
    many = (1 << depth) - 1
    directions, limits = np.zeros((many, x.shape[1])), np.zeros(many)
    node = np.zeros(len(x), np.int64)
    for level in range(depth):
        order = np.argsort(node, kind="stable")
        low = (1 << level) - 1
        cuts = np.searchsorted(node[order], np.arange(low, 2 * low + 2))
        for i in range(low, 2 * low + 1):
            rows = order[cuts[i - low]:cuts[i - low + 1]]
            if len(rows) > 1:  # towards the difference of two points of the node
                a, b = rng.choice(rows, 2, replace=False)
                directions[i] = x[a] - x[b]
                limits[i] = np.median(x[rows] @ directions[i])
        node = _down(x, node, directions, limits)
    return directions, limits


def _down(x: np.ndarray, node: np.ndarray, directions: np.ndarray, limits: np.ndarray) -> np.ndarray:
    return 2 * node + 1 + (np.einsum("ij,ij->i", x, directions[node]) > limits[node])


def _leaf(x: np.ndarray, directions: np.ndarray, limits: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range(depth):
        node = _down(x, node, directions, limits)
    return node - len(limits)


def _halves(rng: np.random.Generator, x: np.ndarray, y: np.ndarray, most: int):
    """Leaves of a group as pairs (rows of x, rows of y): the y of a leaf are ``most`` at most, unless they can't be told apart."""
    open_ = [(np.arange(len(x)), np.arange(len(y)))]
    while open_:
        mine, theirs = open_.pop()
        if len(mine) == 0:
            continue
        if len(theirs) > most:
            for _ in range(8):
                a, b = rng.choice(theirs, 2, replace=False)
                direction = y[a] - y[b]
                at = y[theirs] @ direction
                limit = np.median(at)
                right = at > limit
                if right.any() and not right.all():
                    break
            else:
                yield mine, theirs
                continue
            side = x[mine] @ direction > limit
            open_ += [(mine[side], theirs[right]), (mine[~side], theirs[~right])]
            continue
        yield mine, theirs


def nearest_in_leaves(cell: int, ids, x, other_ids, y, weights, k: int) -> pd.DataFrame:
    """The ``k`` nearest others of each row among those of its leaf; the same in whatever order the group arrives."""
    rng = np.random.default_rng(cell)
    order = np.argsort(other_ids)
    other_ids, y, weights = other_ids[order], y[order], weights[order]
    parts = [pd.DataFrame({"point": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "dist": np.zeros(0), "weight": np.zeros(0, np.int64)})]
    for mine, theirs in _halves(rng, x, y, max(LEAF_POINTS, 4 * k)):
        centre = y[theirs].mean(axis=0)  # far from the origin a product would lose the digits
        there = y[theirs] - centre
        keep = min(k, len(theirs))
        short = min(k + 1 + SPARE, len(theirs))
        step = max(1, 4_000_000 // len(theirs))
        for at in range(0, len(mine), step):
            rows = mine[at:at + step]
            here = x[rows] - centre
            rough = (there * there).sum(1)[None, :] - 2 * (here @ there.T)
            some = np.argpartition(rough, short - 1, axis=1)[:, :short] if short < len(theirs) else np.broadcast_to(np.arange(short), (len(rows), short))
            chosen = theirs[some]
            dist = np.sqrt(np.square(y[chosen] - x[rows][:, None, :]).sum(axis=2))
            dist[other_ids[chosen] == ids[rows][:, None]] = np.inf
            order = np.lexsort((other_ids[chosen], dist), axis=1)[:, :keep]
            dist, chosen = np.take_along_axis(dist, order, 1), np.take_along_axis(chosen, order, 1)
            ok = np.isfinite(dist)
            parts.append(pd.DataFrame({
                "point": np.repeat(ids[rows], keep).reshape(ok.shape)[ok], "neighbour": other_ids[chosen][ok],
                "dist": dist[ok], "weight": weights[chosen][ok],
            }))
    return pd.concat(parts)


def neighbours(pts: DataFrame, k: int, n: int, asking: DataFrame, trees: int = TREES, group_points: int = GROUP_POINTS, seed: int = 5) -> DataFrame:
    """(point, neighbour, dist, weight): up to ``k`` of ``pts`` (point, x, weight; n rows) for each of ``asking`` (point, x)."""
    from .lof import _matrix, _search_cells

    depth = min(MOST_DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / group_points)))))
    models = []
    if depth:
        # 32 points a group, by a hash of their numbers
        share = min(1.0, min(SAMPLE_POINTS, 32 << depth) / n)
        sample = _matrix(pts.filter(F.pmod(F.xxhash64("point", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("point", "x").toPandas().sort_values("point")["x"])
        if len(sample) > 1:
            models = [_grow(np.random.default_rng(seed + t), sample, depth) for t in range(trees)]
    models = models or [(np.zeros((0, 0)), np.zeros(0))] * trees
    deep = int(np.log2(len(models[0][1]) + 1))
    shared = pts.sparkSession.sparkContext.broadcast(models)

    def place(batches):
        for pdf in batches:
            x = _matrix(pdf["x"])
            for t, (directions, limits) in enumerate(shared.value):
                yield pdf.assign(cell=(t << deep) + _leaf(x, directions, limits, deep))

    celled = materialize(pts.select("point", "x", "weight").mapInPandas(place, "point long, x array<double>, weight long, cell long"), "groups")
    if asking is pts:
        askers = celled.select("point", "x", "cell")
    else:
        askers = materialize(asking.select("point", "x").mapInPandas(place, "point long, x array<double>, cell long"), "askers")
    found = materialize(_search_cells(askers, celled, k, nearest_in_leaves), "near")
    # one exchange: the trees' rows of a point meet, a neighbour counts once
    nearest = W.partitionBy("point").orderBy("dist", "neighbour")
    return (
        found.repartition("point").groupBy("point", "neighbour").agg(F.min("dist").alias("dist"), F.min("weight").alias("weight"))
        .withColumn("_rn", F.row_number().over(nearest)).filter(F.col("_rn") <= k).drop("_rn")
    )


def recall(pts: DataFrame, found: DataFrame, k: int, every: int = 100) -> DataFrame:
    """(points, true_neighbours, recall): ``found`` against the exact search for every point whose number is divisible by ``every``."""
    from . import lof

    asked = materialize(pts.filter(F.col("point") % every == 0), "asked")
    true = lof._found(pts, k, lof.BROADCAST_POINTS, lof.CELL_POINTS, asked)
    nearest = W.partitionBy("point").orderBy("dist", "neighbour")
    true = true.withColumn("_rn", F.row_number().over(nearest)).filter(F.col("_rn") <= k)
    reach = true.groupBy("point").agg(F.max("dist").alias("reach"), F.count("*").alias("wanted"))
    # of neighbours at the same distance any is right
    hit = reach.join(found.select("point", "dist"), "point", "left").groupBy("point", "wanted").agg(
        F.least(F.sum(F.coalesce((F.col("dist") <= F.col("reach")).cast("long"), F.lit(0))), F.col("wanted")).alias("hits"))
    return hit.agg(F.count("*").alias("points"), F.sum("wanted").alias("true_neighbours"), (F.sum("hits") / F.sum("wanted")).alias("recall"))
