"""Quality classifier: interpolated modified Kneser-Ney model of byte n-grams, one per language.

The model is trained on trusted documents.  Tasks count n-grams of ORDER bytes (ORDER - 1 start marks and an end mark
frame each text), Spark adds the counts up by (language, n-gram); every lower order takes the number of distinct
left extensions as its count.  Discounts D1, D2, D3+ come from the counts of counts of each language and order.
Probabilities of all seen n-grams and the back-off weights of all contexts are made by joins of the counts that are
sharded by their keys, from order 1 up.

Scoring: the tables are counted; up to BROADCAST_ROWS rows they are sent to all tasks, beyond that the distinct
n-grams of each document are joined with the sharded tables.  Both give a document's perplexity over its whole text.
A language's threshold is q50 + SPREAD * (q90 - q50) of the perplexity of its trusted documents; a document above it is
rejected.  A language without trusted documents is judged by the pooled model and threshold of all languages.

Defined cases: null or empty text has no perplexity and is not kept; null language counts as a language of its own;
no trusted documents at all: no model, and every document with text is kept; repeated rows are judged alike (and train
as often as they occur); a document with several labels is trusted if all of them are; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.bytescan import texts_of, trim
from llm.common import join_small, small_batches, stored

ORDER = 4
SPREAD = 5
BROADCAST_ROWS = 3_000_000
SLICE = 1 << 20
START, END, POOL = 2, 3, -1
UNIFORM = 1 / 257


def framed(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of a batch as integers, and the text number of each; a text of m bytes has m + 1."""
    size = np.diff(offsets)
    n = len(size)
    wide = size + order  # order - 1 start marks, the bytes, an end mark
    at = np.cumsum(wide) - wide
    room = np.full(int(wide.sum()) if n else 0, START, np.uint64)
    room[np.arange(len(data)) + np.repeat(at + order - 1 - offsets[:-1], size)] = data
    room[at + wide - 1] = END
    gram = np.zeros(max(len(room) - order + 1, 0), np.uint64)
    for k in range(order):
        gram = gram << np.uint64(8) | room[k : k + len(gram)]
    text = np.repeat(np.arange(n), size + 1)
    begin = np.cumsum(size + 1) - (size + 1)
    return gram[np.arange(len(text)) + np.repeat(at - begin, size + 1)], text


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = texts_of(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
        trim()


def counts(trusted: DataFrame, order: int) -> DataFrame:
    """(l, g, c): counts of the n-grams of trusted rows (l, text), and of the pool of all languages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_numpy().astype(np.uint64)
            for at, to, data, offsets in slices(batch.column(1)):
                gram, text = framed(data, offsets, order)
                key, many = np.unique(lang[at:to][text] << np.uint64(8 * order) | gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array((key >> np.uint64(8 * order)).astype(np.int32)), pa.array((key & np.uint64((1 << 8 * order) - 1)).astype(np.int64)), pa.array(many)], ["l", "g", "c"])

    own = trusted.mapInArrow(work, "l int, g long, c long").groupBy("l", "g").agg(F.sum("c").alias("c"))
    own = stored(own, "ngrams")
    return own.union(own.groupBy(F.lit(POOL).alias("l"), "g").agg(F.sum("c").alias("c")))


def _discounts(t: DataFrame) -> DataFrame:
    """(l, d1, d2, d3) from the counts of counts; 0.5, 1 and 1.5 where a language has too few to tell."""
    n = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    make = lambda k, default: F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0), F.greatest(F.lit(0.0), F.least(F.lit(float(k)), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(default)
    return t.groupBy("l").agg(*n).select("l", make(1, 0.5).alias("d1"), make(2, 1.0).alias("d2"), make(3, 1.5).alias("d3"))


def model(trusted: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of orders 1 .. order: (l, g, p) of seen n-grams, and (l, x, b) back-off weights of contexts."""
    count = {order: stored(counts(trusted, order), f"count{order}")}
    for k in range(order - 1, 0, -1):
        suffix = F.col("g").bitwiseAND((1 << 8 * k) - 1)
        count[k] = stored(count[k + 1].groupBy("l", suffix.alias("g")).agg(F.count("*").alias("c")), f"count{k}")
    seen, back = [], []
    for k in range(1, order + 1):
        t = count[k].withColumn("x", F.shiftright("g", 8))
        share = [F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("m1"), F.sum(F.when(F.col("c") == 2, 1).otherwise(0)).alias("m2"), F.sum(F.when(F.col("c") > 2, 1).otherwise(0)).alias("m3")]
        # one row per language
        contexts = t.groupBy("l", "x").agg(F.sum("c").alias("total"), *share).join(F.broadcast(_discounts(t)), "l")
        contexts = stored(contexts.withColumn("b", (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")), f"context{k}")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = t.join(contexts, ["l", "x"])
        if k == 1:
            rows = rows.withColumn("lower", F.lit(UNIFORM))
        else:
            low = seen[-1].select("l", F.col("g").alias("s"), F.col("p").alias("lower"))
            rows = rows.withColumn("s", F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(low, ["l", "s"])
        seen.append(stored(rows.select("l", "g", ((F.col("c") - d) / F.col("total") + F.col("b") * F.col("lower")).alias("p")), f"seen{k}"))
        back.append(contexts.select("l", "x", "b"))
    return seen, back


class Tables:
    """The model as sorted arrays; looks up logarithms of probabilities with back-off."""

    def __init__(self, seen: list, back: list):
        self.seen, self.back = seen, back

    @staticmethod
    def find(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key))
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, values[at]

    def logp(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        for k in range(len(self.seen), 0, -1):
            bits = np.int64(8 * k)
            g = gram[left] & np.int64((1 << 8 * k) - 1)
            hit, value = self.find(self.seen[k - 1], lang[left] << bits | g)
            out[left[hit]] += value[hit]
            left, g = left[~hit], g[~hit]
            if not len(left):
                return out
            has, weight = self.find(self.back[k - 1], lang[left] << np.int64(8 * k - 8) | g >> np.int64(8))
            out[left] += np.where(has, weight, 0.0)
        out[left] += np.log(UNIFORM)
        return out


def _collected(df: DataFrame, key: str, value: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select(F.shiftleft((F.col("l") + 1).cast("long"), bits).bitwiseOR(F.col(key)).alias("k"), F.log(value).cast("float").alias("v")).toArrow()
    k, v = rows.column("k").to_numpy(), rows.column("v").to_numpy()
    order = np.argsort(k)
    return k[order], v[order]


def perplexities(rows: DataFrame, seen: list[DataFrame], back: list[DataFrame], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows (uid columns, m, text) with log probability and length: uid columns, m, logp, length.  m is the model's l."""
    order, names = len(seen), [c for c in rows.columns if c != "text"]
    schema = rows.select(*names).selectExpr("*", "0D AS logp", "0L AS length").schema
    if sum(t.count() for t in [*seen, *back]) <= broadcast_rows:
        tables = Tables([_collected(t, "g", "p", 8 * k) for k, t in enumerate(seen, 1)], [_collected(t, "x", "b", 8 * k - 8) for k, t in enumerate(back, 1)])
        shared = rows.sparkSession.sparkContext.broadcast(tables)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lang = batch.column(batch.schema.get_field_index("m")).to_numpy().astype(np.int64) + 1
                for at, to, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))):
                    gram, text = framed(data, offsets, order)
                    logp = np.bincount(text, weights=shared.value.logp(lang[at:to][text], gram.astype(np.int64)), minlength=to - at)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(batch.schema.get_field_index(c)).slice(at, to - at) for c in names), pa.array(logp), pa.array(np.diff(offsets))], [*names, "logp", "length"])

        return rows.mapInArrow(work, schema)

    # a model too large to send: each document's distinct n-grams meet the sharded tables
    told = rows.withColumn("_u", F.xxhash64("text", "m"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in slices(batch.column(2)):
                gram, text = framed(data, offsets, order)
                by = np.lexsort((gram, text))
                gram, text = gram[by], text[by]
                first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])])) if len(gram) else np.zeros(0, np.int64)
                many = np.diff(np.append(first, len(gram)))
                pick = pa.array(text[first] + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(gram[first].astype(np.int64)), pa.array(many)], ["_u", "m", "g", "n"])

    one = told.select("_u", "m", "text").dropDuplicates(["_u"])
    ask = one.mapInArrow(grams, "_u long, m int, g long, n long")
    logp: Column = F.lit(0.0)
    open_: Column = F.lit(True)
    for k in range(order, 0, -1):
        key = F.col("g").bitwiseAND((1 << 8 * k) - 1)
        s = seen[k - 1].select(F.col("l").alias(f"l{k}"), F.col("g").alias(f"g{k}"), F.log("p").cast("float").cast("double").alias(f"p{k}"))
        b = back[k - 1].select(F.col("l").alias(f"m{k}"), F.col("x").alias(f"x{k}"), F.log("b").cast("float").cast("double").alias(f"b{k}"))
        ask = ask.join(s, (F.col("m") == F.col(f"l{k}")) & (key == F.col(f"g{k}")), "left").join(
            b, (F.col("m") == F.col(f"m{k}")) & (F.shiftright(key, 8) == F.col(f"x{k}")), "left")
        logp = logp + F.when(open_, F.coalesce(F.col(f"p{k}"), F.col(f"b{k}"), F.lit(0.0))).otherwise(0.0)
        open_ = open_ & F.col(f"p{k}").isNull()
    logp = logp + F.when(open_, F.lit(float(np.log(UNIFORM)))).otherwise(0.0)
    sums = ask.groupBy("_u").agg(F.sum(logp * F.col("n")).alias("logp"))
    return told.join(sums, "_u").select(*names, "logp", F.octet_length("text").cast("long").alias("length"))


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept."""
    small_batches(docs.sparkSession)
    good = labels.groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")).alias("good")).filter("good = 1").select(F.col("doc_id").alias("_id"))
    langs = sorted({r["lang"] for r in docs.select("lang").distinct().collect()}, key=lambda x: (x is None, x))  # languages, not rows
    code = F.lit(len(langs)).cast("int")
    for i, name in enumerate(langs):
        code = F.when(F.col("lang").eqNullSafe(F.lit(name)), F.lit(i)).otherwise(code)
    rows = docs.select("doc_id", "lang", code.cast("int").alias("l"), F.coalesce("text", F.lit("")).alias("text"))
    # a merge hint: one plan at every size, with even growth, instead of a broadcast while the labels are few
    trusted = rows.filter("text <> ''").join(good.hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi").select("l", "text")
    seen, back = model(trusted, order)
    have = [r["l"] for r in seen[0].select("l").distinct().collect()]
    which = F.when(F.col("l").isin([x for x in have if x != POOL]), F.col("l")).otherwise(F.lit(POOL)) if have else F.lit(POOL)
    scored = perplexities(rows.withColumn("m", which.cast("int")).select("doc_id", "lang", "m", "text"), seen, back, broadcast_rows)
    ppl = F.when((F.col("length") > 0) & F.lit(bool(have)), F.exp(-F.col("logp") / (F.col("length") + 1)))
    scored = stored(scored.select("doc_id", "lang", "m", F.col("length").alias("n_bytes"), ppl.alias("perplexity")), "scores")
    sure = scored.join(good.hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi").filter("perplexity is not null")
    both = sure.select("m", "perplexity").union(sure.select(F.lit(POOL).alias("m"), "perplexity"))
    quantiles = both.groupBy("m").agg(F.percentile_approx("perplexity", [0.5, 0.9], 10000).alias("q"))
    limits = stored(quantiles.select("m", (F.col("q")[0] + SPREAD * (F.col("q")[1] - F.col("q")[0])).alias("threshold")), "limits")
    found = join_small(scored, limits, ["m"])
    kept = (F.col("n_bytes") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return found.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", kept.alias("kept"))


def op1_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
