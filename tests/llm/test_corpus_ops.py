"""Whitening, collocations and line dedup against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from llm import collocations, line_dedup, perfect_hash, whitening

BLANK = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


# whitening


def entries(vec):
    return tuple(max(-(1 << 62), min(1 << 62, math.floor(64 * float(c)))) + 1_000_000 for c in vec)


@pytest.mark.parametrize("wide", [False, True])
def test_cross_products_are_exact(wide):
    rng = np.random.default_rng(3)
    edge = 1 << 61 if wide else 900
    block = rng.integers(-edge, edge, (130, 5))
    block[:, 3] = 7  # a dimension without variance has no planes
    sums, products = whitening.cross_products(block)
    exact = block.astype(object)
    assert sums.tolist() == exact.sum(axis=0).tolist()
    assert products.tolist() == (exact.T @ exact).tolist()


def test_whitening(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) * (1 + d) for d in range(6)] for _ in range(300)]
    rows = [(i, v, "x", 1) for i, v in enumerate(vectors)] + [(i, vectors[0], "y", 2) for i in range(900, 1000)]  # a hot vector
    bad = [None, [1.0, None, 2.0, 3.0, 4.0, 5.0], [math.nan] * 6, [math.inf] + [0.0] * 5, []]
    short = [[0.5, 1.0], [0.25, -1.0], [3.0, 2.0], [3.0, 2.0]]
    rows += [(2000 + i, v, None, None) for i, v in enumerate(bad)] + [(3000 + i, v, None, None) for i, v in enumerate(short)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string, n int").repartition(5)
    got = defaultdict(list)
    for r in whitening.whiten(df).collect():
        got[r.vec_id, r.row].append(r)
    assert len(got) == 404
    for used, size in (([r for r in rows if r[1] in vectors], 6), ([r for r in rows if r[1] in short], 2)):
        fit = sorted({entries(r[1]) for r in used})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        cov = [[Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n**3) for j in range(size)] for i in range(size)]
        values, axes = np.linalg.eigh(np.array(cov, float))
        white = {}
        for r in used:
            x = entries(r[1])
            mine = sorted(got[r[0], r[2]], key=lambda g: g.component)
            assert [g.component for g in mine] == list(range(1, size + 1))
            assert {g.n for g in mine} == {n} and {int(g.deviation) for g in mine} == {sum((n * a - s) ** 2 for a, s in zip(x, sums))}
            white[x] = [g.whitened for g in mine]
            for k, g in enumerate(mine):
                want = sum(float(Fraction(n * a - s, n)) * c for a, s, c in zip(x, sums, axes[:, -1 - k])) / math.sqrt(values[-1 - k])
                assert abs(g.whitened) == pytest.approx(abs(want), abs=1e-9)
                assert g.explained == pytest.approx(values[-1 - k] / values.sum(), rel=1e-9) and g.identity_error < 1e-9
        table = np.array([white[x] for x in fit])
        assert np.abs(np.cov(table.T, bias=True) - np.eye(size)).max() < 1e-9


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # one distinct vector
    far = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 0.0])], schema)
    rows = whitening.whiten(far).collect()
    assert len(rows) == 3 and {r.component for r in rows} == {1} and rows[0].n == 3
    assert {r.vec_id: r.deviation for r in rows}[3] == (3 * 1_000_064 - 3_000_064) ** 2
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(20)], schema)
    assert {r.component for r in whitening.whiten(line).collect()} == {1}


# line dedup


@pytest.mark.parametrize("size", [0, 1, 63, 5000])
def test_perfect_hash(size):
    rng = np.random.default_rng(size)
    high, low = rng.integers(-(1 << 62), 1 << 62, size), rng.integers(-(1 << 62), 1 << 62, size)
    high[: size // 2] = 5  # keys that agree in one half
    index = perfect_hash.build(high, low)
    again = perfect_hash.PerfectHash.of(index.sizes.tolist(), index.words.tobytes())
    assert sorted(again.slots(high, low).tolist()) == list(range(size))
    assert len(again.slots(low, high)) == size and 64 * len(index.words) <= 5 * size + 400


def key_of(line):
    return line.strip(BLANK).translate(UPPER)


def brute_lines(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(-math.inf if doc is None else doc)
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = -math.inf if doc is None else doc
        stay = [x for x in lines if len(key_of(x)) < 10 or len(holders[key_of(x)]) < 2 or min(holders[key_of(x)]) == own]
        yield doc, len(lines), len(lines) - len(stay), "\n".join(stay)


def line_rows():
    rng = random.Random(11)
    pool = ["".join(rng.choice("abéñC ") for _ in range(rng.randint(5, 30))) for _ in range(120)]
    pool += ["héllö wör", "héllö wörl", "ab\x0bcdefghijk", "\x85abcdefghij", "the line of a third of all documents"]
    rows = []
    for i in range(150):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", " \x0c"]) for x in lines]
        rows.append((rng.randint(0, 120), "\n".join(lines + pool[-1:] * (i % 3 == 0))))
    rows += [(None, "\n".join(pool[:20])), (None, pool[3] + "\n" + pool[3]), (500, None), (501, ""), (502, "\n\n"), (503, "x" * 70_000 + "\n" + pool[0]), (504, "x" * 70_000)]
    return rows + [rows[4], rows[4], (-7, rows[4][1])]


@pytest.mark.parametrize("options", [{}, {"shard_lines": 40, "hot_lines": 12}, {"shard_lines": 9, "hot_lines": 1}])
def test_line_dedup(spark, options):
    rows = line_rows()
    df = spark.createDataFrame([(d, t, "a", 1, 2) for d, t in rows], "doc_id long, text string, id string, `row` int, kept int").repartition(6)
    got = Counter((r.row.c0, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in line_dedup.dedup_lines(df, **options).collect())
    want = Counter(brute_lines(rows))
    assert got == want and sum(k[2] * n for k, n in want.items()) > 100
    out = line_dedup.remove_lines(df, **options)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((d, None if t is None else k) for (d, t), (_, _, _, k) in zip(rows, brute_lines(rows)))
    assert line_dedup.remove_lines(df.limit(0)).count() == 0


def test_repeated_row_keeps_its_lines(spark):
    df = spark.range(20_000).selectExpr("7L AS doc_id", "'one line that everybody has\n' || 'second line of the text' AS text")
    done = line_dedup.dedup_lines(df.union(spark.createDataFrame([(8, "second line of the text\nshort")], df.schema)))
    assert {(r.row.c0, r.n_dropped) for r in done.select("row", "n_dropped").distinct().collect()} == {(7, 0), (8, 1)}


# collocations


def brute_phrases(rows, least, cover, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, f in counts.items():
        found = []
        for words, a in f.items():
            if len(words) < 2 or a < least:
                continue
            if any(100 * n >= cover * a for longer, n in f.items() if len(longer) == 3 > len(words) and n >= least and words in (longer[:2], longer[1:])):
                continue
            score, k = min((1_000_000 * a * a // (f[words[:k]] * f[words[k:]]), k) for k in range(1, len(words)))
            found.append((-score, -a, " ".join(words).encode(), f[words[:k]], f[words[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, phrase.decode(), -a, l, r, totals[lang], -score


def phrase_rows():
    rng = random.Random(2)
    words = ["Der", "die", "Éclair", "of", "the", "a\x00b", "ñ", "x\x85y"] + ["w%d" % i for i in range(25)]
    rows = []
    for i in range(240):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts += rng.choice([["New", "York", "City"], ["new", "york"], [rng.choice(words)], [rng.choice(words[:4])]])
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]) for w in parts)
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return rows + [("en", None), (None, ""), ("zz", " \t.\n"), ("qq", "lonely words here")] + [("hot", "same words again and same words again")] * 60


@pytest.mark.parametrize("options", [{}, {"shards": 2, "top": 7}, {"shards": 11, "least": 12, "cover": 20}])
def test_collocations(spark, options, monkeypatch):
    rows = phrase_rows()
    if options:  # several key ranges, several counts of a task, slices of a text
        monkeypatch.setattr(collocations, "RANGE_PHRASES", 1000)
    df = spark.createDataFrame([(i, t, lang, 1, "s") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, salt string")
    got = [tuple(r) for r in collocations.collocations(df.repartition(7), **options).collect()]
    want = list(brute_phrases(rows, options.get("least", 10), options.get("cover", 50), options.get("top", 2000)))
    assert sorted(got) == sorted(want) and len(want) > 20
    assert collocations.collocations(df.limit(0)).count() == 0


def test_phrases_across_slices(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 10)
    one = collocations.Phrases("en")
    one.add(b"a long piece of words. and the next\none here: b c d")
    words = one.words()
    pieces = " ".join(words[i].decode() if i else "|" for i in one.ids().tolist())
    assert [p.strip() for p in pieces.split("|") if p.strip()] == ["a long piece of words", "and the next", "one here", "b c d"]


def test_score_passes_64_bits(spark):
    a, l, r = 3 * 10**12, 5 * 10**12, 7 * 10**12
    counts = spark.createDataFrame([("en", "p q", a), ("en", "p", l), ("en", "q", r), ("en", "", 10**13)], "lang string, phrase string, n long")
    assert collocations.scored(counts).first().score == 1_000_000 * a * a // (l * r)


def test_packs():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 1000).astype(np.uint32))
    back, counts = collocations.unpack(collocations.pack(keys, np.arange(len(keys))))
    assert back.tolist() == keys.tolist() and counts.tolist() == np.minimum(np.arange(len(keys)), 255).tolist()
    assert len(collocations.unpack(collocations.pack(keys[:0], keys[:0]))[0]) == 0


def test_digests(spark, tmp_path):
    spark.createDataFrame([(1, "a shared line here\nx"), (2, "A shared line here \ny"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op13_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {
        1: (2, 0, hashlib.sha256(b"a shared line here\nx").hexdigest()), 2: (2, 1, hashlib.sha256(b"y").hexdigest()),
        3: (1, 0, hashlib.sha256(b"").hexdigest())}
