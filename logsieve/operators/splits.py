"""Filters, splits and samples by class, by time order and by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import PART, POS, lay_out_logs, number_rows, number_rows_within, row_count

# Levels of the strict split; rows of any other level belong to neither side.
NORMAL_LEVELS = ["INFO", "DEBUG", "TRACE"]
PROBLEM_LEVELS = ["WARN", "ERROR", "FATAL"]


def is_problem(split_rule: str = "is_error") -> Column:
    """True for an error row, false for a normal row, null for a row of neither side."""
    if split_rule == "is_error":
        return F.col("is_error")
    if split_rule == "strict":
        return F.when(F.col("is_error") | F.col("level").isin(PROBLEM_LEVELS), True).when(
            F.col("level").isin(NORMAL_LEVELS), False
        )
    raise ValueError(f"split_rule must be 'is_error' or 'strict', not {split_rule!r}")


def normal_rows(logs: DataFrame, split_rule: str = "is_error") -> DataFrame:
    return logs.filter(~is_problem(split_rule))


def error_rows(logs: DataFrame, split_rule: str = "is_error") -> DataFrame:
    return logs.filter(is_problem(split_rule))


def with_sides(logs: DataFrame) -> DataFrame:
    """One row per line and side it belongs to: normal or error, and strict_normal or strict_error."""
    def side(split_rule: str, prefix: str) -> Column:
        problem = is_problem(split_rule)
        return F.when(problem, f"{prefix}error").when(~problem, f"{prefix}normal")

    return logs.withColumn("side", F.explode(F.array(side("is_error", ""), side("strict", "strict_")))).filter(
        F.col("side").isNotNull()
    )


def part_of(n: Column, share: float) -> Column:
    """Truncated share of a count, in double arithmetic."""
    return F.floor(n * F.lit(float(share)))


def split_by_time(
    indexed: DataFrame, shares: tuple[float, float] = (0.8, 0.1), idx: str = "idx"
) -> DataFrame:
    """train / valid / test in time order by truncated row counts."""
    n = row_count(indexed)
    train_end = part_of(n, shares[0])
    valid_end = train_end + part_of(n, shares[1])
    return indexed.withColumn(
        "split",
        F.when(F.col(idx) < train_end, "train").when(F.col(idx) < valid_end, "valid").otherwise("test"),
    )


def split_nested(
    logs: DataFrame, train: float = 0.8, valid: float = 0.2, split_rule: str = "is_error", layout: bool = False
) -> DataFrame:
    """First ``train`` share against the test rest; then the last ``valid`` share of each class of train.

    Rows of neither class are dropped before the order is taken.  ``layout=True`` keeps the layout
    columns and the class ``_problem``, for further numbering.
    """
    laid = lay_out_logs(logs.withColumn("_problem", is_problem(split_rule)).filter(F.col("_problem").isNotNull()))
    indexed = number_rows(laid)
    train_end = part_of(row_count(laid), train)
    sided = indexed.withColumn("_test", F.col("idx") >= train_end)
    ranked = number_rows_within(sided, ["_test", "_problem"], "_rank")
    sizes = sided.groupBy("_test", "_problem").agg(F.count("*").alias("_size"))
    # two classes times two sides: four rows at most
    parted = (
        ranked.join(F.broadcast(sizes), ["_test", "_problem"])
        .withColumn(
            "split",
            F.when(F.col("_test"), "test")
            .when(F.col("_rank") < part_of(F.col("_size"), 1 - valid), "train")
            .otherwise("valid"),
        )
        .drop("_test", "_rank", "_size")
    )
    return parted if layout else parted.drop("_problem", PART, POS)


def number_nested(
    logs: DataFrame, train: float = 0.8, valid: float = 0.2, split_rule: str = "is_error"
) -> DataFrame:
    """The parts of ``split_nested`` with ``problem``, ``idx`` in the part and ``class_idx`` in the part's class.

    The rows of either class before a row follow from its position and its rank in its class, and so do those of its
    part: the rows are ranked once.
    """
    laid = lay_out_logs(logs.withColumn("problem", is_problem(split_rule)).filter(F.col("problem").isNotNull()))
    train_end = part_of(row_count(laid), train)
    early = number_rows(laid, "_all").filter(F.col("_all") < train_end).groupBy("problem").agg(F.count("*").alias("n"))
    sizes = {r["problem"]: r["n"] for r in early.collect()}  # two classes

    def ends(problem: Column) -> tuple[Column, Column]:
        """Rows of the class before the validation part and before the test part."""
        size = F.when(problem, F.lit(sizes.get(True, 0))).otherwise(F.lit(sizes.get(False, 0))).cast("long")
        return part_of(size, 1 - valid), size

    rank, others = F.col("_rank"), F.col("_all") - F.col("_rank")
    (mine, size), (theirs, _) = ends(F.col("problem")), ends(~F.col("problem"))
    ranked = number_rows_within(number_rows(laid, "_all"), ["problem"], "_rank").withColumn(
        "split", F.when(F.col("_all") >= train_end, "test").when(rank < mine, "train").otherwise("valid")
    )
    in_test, in_train = F.col("split") == "test", F.col("split") == "train"
    return ranked.withColumns({
        "idx": F.when(in_test, F.col("_all") - train_end).when(in_train, rank + F.least(others, theirs)).otherwise(
            rank - mine + F.greatest(others - theirs, F.lit(0))),
        "class_idx": F.when(in_test, rank - size).when(in_train, rank).otherwise(rank - mine),
    }).drop("_all", "_rank", PART, POS)


def split_chunked(
    indexed: DataFrame, train: float = 0.8, valid: float = 0.2, chunk_rows: int | None = None
) -> DataFrame:
    """train / valid / test by position.

    With ``chunk_rows`` a whole chunk goes to train when it starts before the valid boundary, unless it
    straddles the test boundary; without, the boundaries are exact.
    """
    n = row_count(indexed)
    train_end = part_of(n, train)
    valid_start = part_of(train_end, 1 - valid)
    pos = F.col("idx")
    if chunk_rows:
        start = F.col("idx") - F.pmod("idx", F.lit(chunk_rows))
        whole = F.least(start + chunk_rows, n) <= train_end
        pos = F.when(whole, start).otherwise(F.col("idx"))
    return indexed.withColumn(
        "split",
        F.when(F.col("idx") >= train_end, "test").when(pos >= valid_start, "valid").otherwise("train"),
    )


def first_share(indexed: DataFrame, share: float = 0.8, idx: str = "idx") -> DataFrame:
    """The first ``share`` of the rows by index."""
    return indexed.filter(F.col(idx) < part_of(row_count(indexed), share))


def sample_systematic(indexed: DataFrame, max_rows: int, idx: str = "idx") -> DataFrame:
    """Every k-th row, k = rows // ``max_rows``, and at most ``max_rows`` of them; all rows if few."""
    n = row_count(indexed)
    step = F.greatest(F.floor(n / max_rows), F.lit(1))
    picked = (F.pmod(F.col(idx), step) == 0) & (F.col(idx) / step < max_rows)
    return indexed.filter((n <= max_rows) | picked)


def sample_random(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows in an order set by a hash of a unique key: the same rows every time.

    Rows above a bound on the hash, about four times as wide as needed, are dropped before the sort, so the
    last step gets some ``n`` rows, not ``n`` of every partition.
    """
    lot = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    drawn = df.withColumn("_lot", lot)
    total, share = df.count(), 4.0
    while share * n < total:
        some = drawn.filter(F.conv(F.left("_lot", F.lit(8)), 16, 10).cast("long") < int((1 << 32) * share * n / total))
        if some.count() >= n:
            drawn = some
            break
        share *= 2
    return drawn.orderBy("_lot", F.col(key)).limit(n).drop("_lot")


def sample_even(indexed: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """``n`` rows at even, truncated positions from the first to the last row; all rows if fewer."""
    if n == 1:
        return indexed.filter(F.col(idx) == 0)
    sized = indexed.withColumn("_total", row_count(indexed))
    gap = (F.col("_total") - 1) / F.lit(float(n - 1))
    # Row i is hit when some k has floor(k * gap) = i; only a k next to i / gap can.
    near = F.floor(F.col(idx) / gap)
    hit = F.exists(
        F.array(near - 1, near, near + 1, near + 2),
        lambda k: (k >= 0) & (k < n)
        & (F.when(k == n - 1, F.col("_total") - 1).otherwise(F.floor(k * gap)) == F.col(idx)),
    )
    return sized.filter((F.col("_total") <= n) | hit).drop("_total")
