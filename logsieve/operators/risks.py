"""Risk of anomalous sequences: text, score, bucket and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.risk import RISK_LEVELS, risk_bucket, risk_score
from .sequences import BUCKET_ROWS, for_sequences


FIRST_MESSAGES = {f"_m{k}": ("message", k) for k in range(3)}


def sequence_details(
    anomalies: DataFrame, indexed: DataFrame, w: int = 15, whole_text: bool = False, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Rows, distinct levels and the first three messages of each sequence.

    ``whole_text=True`` adds ``sequence_text``, all messages of the sequence.
    """
    rows = indexed.select("idx", "level", "message")
    aggs = detail_aggs()
    if whole_text:
        # the frame is in index order, so the list is too
        aggs["_texts"] = F.collect_list("message")
    packed = unpack_details(for_sequences(anomalies, rows, w, aggs, FIRST_MESSAGES, bucket_rows))
    return packed.withColumn("sequence_text", F.array_join("_texts", " ")).drop("_texts") if whole_text else packed


def detail_aggs() -> dict[str, Column]:
    """Aggregates behind the details; the messages come from ``FIRST_MESSAGES``."""
    return {"log_count": F.count("message"), "_levels": F.collect_set("level")}


def unpack_details(packed: DataFrame) -> DataFrame:
    return (
        packed.withColumn("log_levels", F.array_join(F.array_sort("_levels"), ", "))
        .withColumn("sample_messages", F.concat_ws(" | ", *FIRST_MESSAGES))
        .drop("_levels", *FIRST_MESSAGES)
    )


def risk_text(df: DataFrame) -> Column:
    """Sample messages if there are any, else the whole text of the sequence."""
    cols = [F.col(c) for c in ("sample_messages", "sequence_text") if c in df.columns]
    return F.coalesce(*cols, F.lit("")) if cols else F.lit("")


def with_risk(anomalies: DataFrame) -> DataFrame:
    """Risk score and bucket from ``anomaly_score``, ``max_severity_score`` and the text."""
    score = risk_score(F.col("anomaly_score"), F.col("max_severity_score"), risk_text(anomalies))
    return anomalies.withColumn("risk_score", score).withColumn("risk_level", risk_bucket(F.col("risk_score")))


def risk_distribution(risks: DataFrame) -> DataFrame:
    """Sequences and mean / highest score per risk level."""
    return risks.groupBy("risk_level").agg(
        F.count("*").alias("n"), F.avg("risk_score").alias("avg_risk_score"), F.max("risk_score").alias("max_risk_score")
    )


def risk_totals(risks: DataFrame) -> DataFrame:
    """One row: total, count per level, mean and maximum; all zero for an empty input."""
    return risks.agg(
        F.count("*").alias("total_anomalies"),
        *[F.count_if(F.col("risk_level") == v).alias(f"{v.lower()}_anomalies") for v in RISK_LEVELS],
        F.avg("risk_score").alias("avg_risk_score"),
        F.max("risk_score").alias("max_risk_score"),
    )


def top_by_risk(risks: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest scores of each risk level; the group limit is applied before the shuffle."""
    order = W.partitionBy("risk_level").orderBy(F.desc("risk_score"), "sequence_index")
    return risks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def risk_slices(risks: DataFrame) -> dict[str, DataFrame]:
    """One frame per risk level."""
    return {v: risks.filter(F.col("risk_level") == v) for v in RISK_LEVELS}
