"""Comparison of the sequences that several models found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def stack_results(results: dict[str, DataFrame], *cols: str) -> DataFrame:
    """(model, cols) rows of all results."""
    parts = [df.select(F.lit(name).alias("model"), *cols) for name, df in results.items()]
    return reduce(DataFrame.unionByName, parts)


def _found_by(results: dict[str, DataFrame]) -> DataFrame:
    return stack_results(results, "sequence_index").groupBy("sequence_index").agg(
        F.count_distinct("model").alias("models"), F.min("model").alias("model")
    )


def found_by_all(results: dict[str, DataFrame]) -> DataFrame:
    """Sequences that every model found."""
    return _found_by(results).filter(F.col("models") == len(results)).select("sequence_index")


def found_by_one(results: dict[str, DataFrame]) -> DataFrame:
    """Sequences that exactly one model found, with that model."""
    return _found_by(results).filter(F.col("models") == 1).select("model", "sequence_index")


def severity_by_model(results: dict[str, DataFrame], level: str = "max_severity_level") -> DataFrame:
    """Model x severity counts with the number of detections."""
    stacked = stack_results(results, level)
    return stacked.groupBy("model").agg(
        F.count("*").alias("detected"),
        *[F.count_if(F.col(level) == v).alias(v.lower()) for v in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
    )
