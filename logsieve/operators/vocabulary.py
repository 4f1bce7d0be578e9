"""Template vocabulary and TF-IDF vectors of templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.templates import template, terms
from .ordering import LOG_ORDER, rank_rows, row_count


def with_template(logs: DataFrame, specific_first: bool = False) -> DataFrame:
    return logs.withColumn("template", template(F.col("message"), specific_first))


def template_counts(logs: DataFrame) -> DataFrame:
    """Rows per template."""
    return logs.groupBy("template").agg(F.count("*").alias("n"))


def template_vocab(logs: DataFrame, order: tuple[str, ...] = LOG_ORDER) -> DataFrame:
    """Templates with ids from 0 by frequency; of equally frequent ones the first seen comes first."""
    first = F.min(F.struct(*order)).alias("_first")
    counts = logs.groupBy("template").agg(F.count("*").alias("n"), first)
    ranked = rank_rows(counts, [F.desc("n"), F.col("_first"), F.col("template")], "template_id")
    return ranked.select("template", (F.col("template_id") - 1).alias("template_id"), "n")


def with_template_id(logs: DataFrame, vocab: DataFrame, unknown: int = 0) -> DataFrame:
    """Template ids; ``unknown`` for templates outside the vocabulary (0 is also the commonest one).

    Whether the vocabulary is sent around or shuffled is left to the planner, which knows its size.
    """
    ids = vocab.select("template", "template_id")
    return logs.join(ids, "template", "left").withColumn(
        "template_id", F.coalesce("template_id", F.lit(unknown).cast("long"))
    )


def template_terms(templates: DataFrame) -> DataFrame:
    """(template, term, tf) of distinct templates: words and word pairs."""
    return (
        templates.select("template").distinct()
        .select("template", F.explode(terms(F.col("template"))).alias("term"))
        .groupBy("template", "term")
        .agg(F.count("*").alias("tf"))
    )


def term_weights(counted: DataFrame, n_templates, max_terms: int = 100) -> DataFrame:
    """The ``max_terms`` most frequent terms with their position in term order and smoothed idf."""
    top = (
        counted.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
        .orderBy(F.desc("total"), "term")
        .limit(max_terms)
    )
    # at most ``max_terms`` rows from here on
    position = top.select(F.array_sort(F.collect_list("term"))).scalar()
    return top.select(
        "term",
        (F.array_position(position, F.col("term")) - 1).cast("int").alias("dim"),
        (F.log((1 + n_templates) / (1 + F.col("df"))) + 1).alias("idf"),
    )


def tfidf_entries(templates: DataFrame, max_terms: int = 100) -> DataFrame:
    """Non-zero vector entries (template, dim, term, value), each vector of length one."""
    distinct = templates.select("template").distinct()
    counted = template_terms(distinct)
    weights = term_weights(counted, row_count(distinct), max_terms)
    raw = counted.join(F.broadcast(weights), "term").withColumn("_w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norms, "template").select("template", "dim", "term", (F.col("_w") / F.col("_norm")).alias("value"))


def tfidf_templates(templates: DataFrame, max_terms: int = 100) -> DataFrame:
    """Sparse vector per template: ``dims`` and ``vals``; templates without a kept term have none."""
    packed = tfidf_entries(templates, max_terms).groupBy("template").agg(
        F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_v")
    )
    return packed.select(
        "template",
        F.transform("_v", lambda x: x["dim"]).alias("dims"),
        F.transform("_v", lambda x: x["value"]).alias("vals"),
    )
