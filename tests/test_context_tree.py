import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logsieve.operators.detectors import context_tree, ngram_next


def brute(train, test, w, order, least):
    """Blended probabilities by walking the contexts of each target."""
    counts = defaultdict(Counter)
    for i in range(w, len(train)):
        for k in range(order + 1):
            counts[tuple(train[i - k:i])][train[i]] += 1
    vocab = set(train)
    known = [t if t in vocab else None for t in test]
    for i in range(w, len(test)):
        p = 1 / (len(vocab) + 1)
        for k in range(order + 1):
            c = counts.get(tuple(known[i - k:i]))
            if c is None or (k and sum(c.values()) < least):
                break
            p = (c[known[i]] + len(c) * p) / (sum(c.values()) + len(c))
        yield i - w, p


def frame(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "idx long, template string").repartition(3)
    return rows.selectExpr("*", "idx AS timestamp", "'f' AS file_path", "idx AS line_number")


@pytest.mark.parametrize("order, least", [(6, 2), (6, 1), (3, 4)])
def test_tree_equals_brute_force(spark, order, least):
    rng = random.Random(order * 10 + least)
    train = [rng.choice("aabc") if rng.random() < 0.4 else "xyz"[i % 3] for i in range(300)]
    test = [rng.choice("aabcq") if rng.random() < 0.4 else "xyz"[i % 3] for i in range(120)]
    fitted = context_tree.fit(frame(spark, train), w=6, order=order, least=least, bucket_rows=32)
    got = {r.sequence_index: r.prediction_prob for r in context_tree.score(frame(spark, test), fitted, bucket_rows=32).collect()}
    want = dict(brute(train, test, 6, order, least))
    assert got == pytest.approx(want)
    assert fitted.depth <= order and fitted.nodes.filter("size > 0").agg(F.min("total")).first()[0] >= least


def test_probabilities_of_all_followers_add_up(spark):
    rng = random.Random(9)
    train = [rng.choice("abcd") for _ in range(200)]
    fitted = context_tree.fit(frame(spark, train), w=4)
    ids = [r.template_id for r in fitted.vocab.collect()] + [ngram_next.UNKNOWN]
    cases = spark.createDataFrame([([0, 1, 2, i], j) for i in (0, 3) for j in ids], "sequence array<long>, next_id long")
    sums = context_tree.score_cases(cases, fitted).groupBy("sequence").agg(F.sum("prediction_prob").alias("p")).collect()
    assert [r.p for r in sums] == pytest.approx([1.0, 1.0])


def long_memory(rng, n):
    """What follows four fillers is decided by the template before them: two ids of context can't know it."""
    out = []
    while len(out) < n:
        head = rng.choice("pqrs")
        out += [head, "f", "f", "f", "f", head + "_end"]
    return out[:n]


def test_looks_further_back_than_two(spark):
    rng = random.Random(4)
    train, test = frame(spark, long_memory(rng, 1200)), frame(spark, long_memory(rng, 600))

    def accuracy(module, fitted):
        rows = module.score(test, fitted)
        return rows.agg(F.avg((F.col("predicted_template") == F.col("actual_template")).cast("int"))).first()[0]

    deep = accuracy(context_tree, context_tree.fit(train, w=8))
    flat = accuracy(ngram_next, ngram_next.fit(train, w=8, order=2))
    assert deep > flat + 0.1 and deep > 0.8


def test_odd_tables(spark):
    fitted = context_tree.fit(frame(spark, list("ab") * 3), w=8)  # shorter than the look-back
    assert fitted.depth == 0 and context_tree.score(frame(spark, list("abc")), fitted).count() == 0
    rows = context_tree.score(frame(spark, list("abababababz")), fitted).collect()
    assert len(rows) == 3 and all(r.prediction_prob == pytest.approx(1 / 3) for r in rows)
    with pytest.raises(ValueError):
        context_tree.fit(frame(spark, list("ab")), w=3, order=4)
