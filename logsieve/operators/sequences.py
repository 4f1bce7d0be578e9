"""Sliding sequences over the dense row index.

Rows are cut into equal buckets of consecutive indexes.  A row near an edge is also copied into the
neighbouring bucket, so that every frame of ``w`` rows is complete inside one bucket.  Buckets are equal
in size by construction: there is no hot bucket, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

BUCKET_ROWS = 4096
BUCKET, OWN = "_bucket", "_own"


def with_forward_halo(df: DataFrame, w: int, idx: str = "idx", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Copies of the first ``w - 1`` rows of a bucket go to the bucket before (for look-ahead frames)."""
    return _with_halo(df, w, idx, bucket_rows, forward=True)


def with_backward_halo(df: DataFrame, w: int, idx: str = "idx", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Copies of the last ``w - 1`` rows of a bucket go to the bucket after (for look-back frames)."""
    return _with_halo(df, w, idx, bucket_rows, forward=False)


def _with_halo(df: DataFrame, w: int, idx: str, bucket_rows: int, forward: bool) -> DataFrame:
    size = max(bucket_rows, w)
    home = F.floor(F.col(idx) / size).cast("long")
    inside = F.pmod(F.col(idx), F.lit(size))
    shared = inside < w - 1 if forward else inside >= size - (w - 1)
    other = home - 1 if forward else home + 1
    return df.withColumn(
        BUCKET, F.explode(F.when(shared, F.array(home, other)).otherwise(F.array(home)))
    ).withColumn(OWN, F.col(BUCKET) == F.floor(F.col(idx) / size))


def frame(start: int, end: int, idx: str = "idx") -> WindowSpec:
    """Frame by index distance inside a bucket."""
    return W.partitionBy(BUCKET).orderBy(idx).rangeBetween(start, end)


def over_sequences(
    rows: DataFrame, w: int, aggs: dict[str, Column], idx: str = "idx", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``aggs`` over the ``w`` rows that start at each row; incomplete tails are left out.

    ``aggs`` are plain aggregate columns, e.g. ``{"max_score": F.max("score")}``.
    """
    halo = with_forward_halo(rows, w, idx, bucket_rows)
    span = frame(0, w - 1, idx)
    framed = halo.select(
        idx, OWN, F.count("*").over(span).alias("_n"), *[agg.over(span).alias(k) for k, agg in aggs.items()]
    )
    return framed.filter(F.col(OWN) & (F.col("_n") == w)).select(F.col(idx).alias("sequence_index"), *aggs)


def sequences(rows: DataFrame, value: str, w: int, step: int = 1, out: str = "sequence", **kw) -> DataFrame:
    """Arrays of ``w`` consecutive values, one per start index (every ``step``-th start)."""
    packed = over_sequences(rows, w, {out: F.collect_list(value)}, **kw)
    return packed if step == 1 else packed.filter(F.pmod("sequence_index", F.lit(step)) == 0)


def next_event_pairs(rows: DataFrame, w: int, value: str = "template_id", **kw) -> DataFrame:
    """``w`` values and the one that follows them, for every start that has a follower."""
    both = sequences(rows, value, w + 1, out="_both", **kw)
    return both.select(
        "sequence_index",
        F.slice("_both", 1, w).alias("sequence"),
        F.element_at("_both", w + 1).alias("next_value"),
    )


def spans(rows: DataFrame, w: int, step: int, n: Column) -> DataFrame:
    """Start and end (exclusive) of each sequence, from the row count alone."""
    return rows.filter((F.col("idx") <= n - w) & (F.pmod("idx", F.lit(step)) == 0)).select(
        F.col("idx").alias("sequence_index"),
        F.col("idx").alias("start_idx"),
        (F.col("idx") + w).alias("end_idx"),
    )


def for_sequences(
    starts: DataFrame, rows: DataFrame, w: int, aggs: dict[str, Column], at: dict[str, tuple[str, int]] | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Aggregates over the rows ``[s, s + w - 1]`` of each start ``s`` in ``starts.sequence_index``.

    ``at`` picks single values: ``{"second": ("message", 1)}`` is the message of row ``s + 1``.

    A range join turned into one shuffle: starts are put among the rows of their bucket and look ahead.
    The tail of the table gives shorter spans; a start beyond the last row finds nothing.
    """
    at = at or {}
    keep = [c for c in starts.columns if c != "sequence_index"]
    halo = with_forward_halo(rows.withColumn("_start", F.lit(False)), w, bucket_rows=bucket_rows)
    size = max(bucket_rows, w)
    asked = starts.withColumns({
        "idx": F.col("sequence_index"),
        "_start": F.lit(True),
        BUCKET: F.floor(F.col("sequence_index") / size).cast("long"),
        OWN: F.lit(True),
    }).drop("sequence_index")
    mixed = halo.unionByName(asked, allowMissingColumns=True)
    span = frame(0, w - 1)
    return mixed.select(
        "idx", "_start", *keep,
        *[agg.over(span).alias(k) for k, agg in aggs.items()],
        # one row lies at that distance, and the starts have no values of their own
        *[F.max(col).over(frame(k, k)).alias(name) for name, (col, k) in at.items()],
    ).filter("_start").select(F.col("idx").alias("sequence_index"), *keep, *aggs, *at)


def members(starts: DataFrame, w: int) -> DataFrame:
    """One row per (sequence, row index) of the given sequences; for equi-joins with few sequences."""
    return starts.withColumn(
        "idx", F.explode(F.sequence(F.col("sequence_index"), F.col("sequence_index") + (w - 1)))
    )


def spread_scores(
    rows: DataFrame, scored: DataFrame, w: int = 15, score: str = "anomaly_score",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Give each row the highest score of the sequences that cover it, 0 if there is none.

    ``scored`` holds flagged sequences (or all of them, to spread raw scores); ``y_pred`` is 1 for a
    covered row.  The look-back is ``w`` = 15 rows whatever the length of the sequences.
    """
    marks = scored.select(F.col("sequence_index").alias("idx"), F.col(score).alias("_mark")).withColumn(
        "_row", F.lit(False)
    )
    mixed = rows.select("idx").withColumns({"_mark": F.lit(None).cast("double"), "_row": F.lit(True)})
    halo = with_backward_halo(mixed.unionByName(marks), w, bucket_rows=bucket_rows)
    best = F.max("_mark").over(frame(-(w - 1), 0))
    return (
        halo.select("idx", OWN, "_row", best.alias("_best"))
        .filter(F.col(OWN) & F.col("_row"))
        .select(
            "idx",
            F.col("_best").isNotNull().cast("int").alias("y_pred"),
            F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0)).alias("anomaly_score"),
        )
    )
