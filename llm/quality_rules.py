"""Quality rules with adaptive thresholds per language and source (native expressions only).

Every document gets five base measures of its whole text.  Four ratios of them are summarised in mergeable
quantile sketches: a histogram with relative bucket widths (8 buckets per doubling), which is a plain sum per
(language, source, ratio, bucket), so partial sketches of tasks, sources and days merge by addition.  The upper
fence of a ratio is q75 + WIDTH * (q75 - q25) + FLOOR of the sketch; a source with fewer than LEAST documents takes
the sketch of its language, merged from all its sources, and a language with fewer takes the sketch of all rows.
A document is rejected when a base rule fails or when a ratio lies above its fence.

Defined cases: null or blank text has no words and fails the base rule; null language or source is a group of
its own; repeated rows are judged alike; an empty table gives no rows; extra columns pass through filter_rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import BLANK, join_small, stored

SYMBOLS = r"[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = {  # ratio -> (expression in units of 1/1000, floor of the fence)
    "word_length": ("1000 * word_chars div greatest(n_words, 1)", 2500),
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", 100),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 200),
    "repeat_words": ("1000 * n_repeat_words div greatest(n_words, 1)", 150),
}
WIDTH = 3
LEAST = 40
STEPS = 8


def measures(text: str = "text") -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of a whole text.

    Repeated windows are found by sorting (hash of window, position) inside the row: n log n for any length, and
    no shuffle.  Lambda variables keep every intermediate array from being computed twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, BLANK), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def repeats(w: Column) -> Column:
        windows = F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>"))
        return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])),
            )
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        return _let(_let(ranked, starts), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x,
        ))

    both = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeats(w).cast("long").alias("n_repeat_words"),
    ))
    per_line = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))
    return [
        both.alias("_w"), per_line.alias("_l"),
        (F.size(F.split(t, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
    ]


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _w, _l and n_symbols in one struct column _m."""
    return docs.withColumn("_m", F.struct(*measures(text)))


def unpacked(prefix: str = "_m") -> list[Column]:
    return [
        F.col(f"{prefix}._w.n_words"), F.col(f"{prefix}._w.word_chars"), F.col(f"{prefix}.n_symbols"),
        F.col(f"{prefix}._l.n_dup_lines"), F.col(f"{prefix}._w.n_repeat_words"), F.col(f"{prefix}._l.n_lines"),
    ]


def bucket(x: Column) -> Column:
    """Bucket of a whole number >= 0: exact below 2 * STEPS, then STEPS buckets per doubling."""
    e = F.length(F.bin(x)) - F.length(F.bin(F.lit(STEPS)))
    return F.when(x < 2 * STEPS, x).otherwise(e * STEPS + F.floor(x / F.pow(F.lit(2.0), e)).cast("long"))


def bucket_low(b: Column) -> Column:
    """The least number of a bucket."""
    e = F.floor(b / F.lit(STEPS)) - 1
    return F.when(b < 2 * STEPS, b).otherwise(((b - e * STEPS) * F.pow(F.lit(2.0), e)).cast("long"))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): one mergeable histogram per group; rows that fail the base rule don't count."""
    ratios = F.explode(F.array(*[
        F.struct(F.lit(name).alias("ratio"), F.expr(e).alias("value")) for name, (e, _) in RATIOS.items()
    ])).alias("r")
    return rows.filter(~F.col("base_failed")).select("lang", "source", ratios).groupBy(
        "lang", "source", F.col("r.ratio").alias("ratio"), bucket(F.col("r.value")).alias("bucket")
    ).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, one fence per ratio) from the sketches, with the merged ones for small groups."""
    def quartiles(s: DataFrame, keys: list[str]) -> DataFrame:
        # buckets of a group are few (some hundreds), so the window holds a bounded group
        from pyspark.sql import Window

        merged = s.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
        order = Window.partitionBy(*keys, "ratio").orderBy("bucket")
        whole = Window.partitionBy(*keys, "ratio")
        cum = merged.withColumn("below", F.sum("n").over(order)).withColumn("total", F.sum("n").over(whole))
        at = lambda q: F.min(F.when(F.col("below") * 4 >= F.col("total") * q, F.col("bucket")))
        return cum.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), bucket_low(at(1)).alias("q1"), bucket_low(at(3)).alias("q3"))

    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(sketch, ["lang"]).select(
        F.col("lang").alias("_lang"), F.col("ratio").alias("_ratio"),
        F.col("total").alias("lt"), F.col("q1").alias("l1"), F.col("q3").alias("l3"))
    whole = quartiles(sketch, []).select(F.col("ratio").alias("_ratio2"), F.col("q1").alias("w1"), F.col("q3").alias("w3"))
    rows = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("ratio") == F.col("_ratio")))
    rows = rows.join(F.broadcast(whole), F.col("ratio") == F.col("_ratio2"))  # one row per ratio
    pick = lambda a, b, c: F.when(F.col("total") >= LEAST, F.col(a)).when(F.col("lt") >= LEAST, F.col(b)).otherwise(F.col(c))
    q1, q3 = pick("q1", "l1", "w1"), pick("q3", "l3", "w3")
    floor = F.create_map(*[F.lit(x) for name, (_, f) in RATIOS.items() for x in (name, f)])[F.col("ratio")]
    rows = rows.withColumn("fence", (q3 + WIDTH * (q3 - q1) + floor).cast("long"))
    return rows.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("ratio") == name, F.col("fence"))).alias(f"fence_{name}") for name in RATIOS
    ])


def judge(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs with the measures, base_failed and kept; the measures are computed once and stored.

    With keep_text=False only doc_id, lang and source of the columns remain.
    """
    have = docs if keep_text else docs.select("doc_id", "text", "lang", "source")
    own = [c for c in have.columns if keep_text or c != "text"]
    nested = measured(have.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("text"), F.col("lang"), F.col("source")))
    rows = nested.select("_row", "lang", "source", "_m").select("_row", "lang", "source", *unpacked())
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = stored(rows, "quality")
    limits = fences(sketches(rows))
    found = join_small(rows, stored(limits, "fences"), ["lang", "source"])
    bad = F.lit(False)
    for name, (e, _) in RATIOS.items():
        bad = bad | F.coalesce(F.expr(e) > F.col(f"fence_{name}"), F.lit(False))
    return found.withColumn("kept", ~F.col("base_failed") & ~bad)


def filter_rules(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    return judge(docs, keep_text=True).filter("kept").select("_row.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("_row.doc_id", *MEASURES, "base_failed", "kept", *[f"fence_{r}" for r in RATIOS])
