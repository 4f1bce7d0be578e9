"""Total order over a distributed table: dense row numbers and running sums without a single task.

``lay_out`` range-partitions and sorts the rows once and writes the result, together with the partition
number and the position inside the partition.  Row numbers are then ``start of partition + position``,
where the starts come from one row per partition.  Ties never pile up in one task, because the keys
given by the callers end in a unique column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scratch import materialize

PART, POS = "_part", "_pos"
LOG_ORDER = ("timestamp", "file_path", "line_number")


def lay_out(df: DataFrame, keys: list[Column | str], name: str = "ordered") -> DataFrame:
    """Range-partitioned, sorted, written copy with partition number and position columns."""
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    laid = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumns({
            PART: F.spark_partition_id(),
            # the low 33 bits count the rows of a partition
            POS: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        })
    )
    return materialize(laid, name)


def lay_out_logs(logs: DataFrame) -> DataFrame:
    """Logs in time order; lines without a valid time come last, by file and line.

    The lines are written as they come first: choosing the ranges reads them once more, which would parse the text twice.
    """
    first, *rest = LOG_ORDER
    return lay_out(materialize(logs, "lines"), [F.col(first).asc_nulls_last(), *rest], "logs")


def _starts(sizes: DataFrame, within: list[str], col: str) -> DataFrame:
    """Exclusive running total of ``col`` over partitions; one row per partition and group."""
    before = W.partitionBy(*within).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn(col, F.coalesce(F.sum(col).over(before), F.lit(0)))


def number_rows(laid: DataFrame, name: str = "idx") -> DataFrame:
    """Dense 0-based row number of a complete layout; no shuffle of the rows."""
    sizes = laid.groupBy(PART).agg(F.count("*").alias("_start"))
    # one row per partition: small by construction
    return (
        laid.join(F.broadcast(_starts(sizes, [], "_start")), PART)
        .withColumn(name, F.col("_start") + F.col(POS))
        .drop("_start")
    )


def number_rows_within(laid: DataFrame, groups: list[str], name: str = "idx") -> DataFrame:
    """Dense 0-based row number per group, or of a filtered layout when ``groups`` is empty.

    Also for a few huge groups: a group is numbered piecewise in the partitions it spans.  Rows are
    gathered by partition number alone, so several numberings in a row share one shuffle.
    """
    sizes = laid.groupBy(PART, *groups).agg(F.count("*").alias("_start"))
    local = W.partitionBy(PART, *groups).orderBy(POS)
    laid = laid.repartition(PART)
    return (
        laid.withColumn("_rn", F.row_number().over(local) - 1)
        .join(_starts(sizes, groups, "_start"), [PART, *groups])
        .withColumn(name, F.col("_start") + F.col("_rn"))
        .drop("_start", "_rn")
    )


def running_sums(laid: DataFrame, sums: dict[str, str], groups: list[str] | None = None) -> DataFrame:
    """Inclusive running sums ``{output: input}`` along a layout, per group if asked."""
    groups = groups or []
    outs = list(sums)
    totals = laid.groupBy(PART, *groups).agg(*[F.sum(sums[o]).alias(f"_s_{o}") for o in outs])
    for o in outs:
        totals = _starts(totals, groups, f"_s_{o}")
    local = W.partitionBy(PART, *groups).orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    result = laid.withColumns({f"_l_{o}": F.sum(sums[o]).over(local) for o in outs})
    return (
        result.join(totals, [PART, *groups])
        .withColumns({o: F.col(f"_s_{o}") + F.col(f"_l_{o}") for o in outs})
        .drop(*[f"_s_{o}" for o in outs], *[f"_l_{o}" for o in outs])
    )


def index_logs(logs: DataFrame) -> DataFrame:
    """Logs with ``idx``, their dense position in time order."""
    return number_rows(lay_out_logs(logs)).drop(PART, POS)


def rank_rows(df: DataFrame, keys: list[Column | str], name: str = "priority") -> DataFrame:
    """1-based global rank; ``keys`` must end in something unique."""
    ranked = number_rows(lay_out(df, keys, "ranked"), name)
    return ranked.withColumn(name, F.col(name) + 1).drop(PART, POS)


def row_count(df: DataFrame) -> Column:
    """Number of rows, as a scalar that is computed with the query that uses it."""
    return df.select(F.count("*").alias("n")).scalar()


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per (feature, prob).

    Values are counted first and then ranked along a layout, so neither many rows nor one frequent
    value collects in a task.  Nulls are left out.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols
    ]))).filter(F.col("value").isNotNull())
    counted = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    laid = lay_out(counted, ["feature", "value"], "quantiles")
    ranks = running_sums(laid, {"upto": "n"}, ["feature"])
    sizes = laid.groupBy("feature").agg(F.sum("n").alias("total"))
    wanted = sizes.select("feature", "total", F.explode(F.array(*map(F.lit, probs))).alias("prob")).withColumn(
        "at", F.col("prob") * (F.col("total") - 1)
    )
    # each wanted rank falls on one value (or two neighbours): bounded by features x probs
    pairs = ranks.join(F.broadcast(wanted), "feature").filter(
        ((F.floor("at") >= F.col("upto") - F.col("n")) & (F.floor("at") < F.col("upto")))
        | ((F.ceil("at") >= F.col("upto") - F.col("n")) & (F.ceil("at") < F.col("upto")))
    )
    low, high = F.min("value"), F.max("value")
    part = F.first("at") - F.floor(F.first("at"))
    return pairs.groupBy("feature", "prob").agg((low + (high - low) * part).alias("value"))
