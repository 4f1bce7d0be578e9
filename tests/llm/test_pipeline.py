"""The pipeline, stage by stage, against brute force on small tables."""

import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from llm import bpe, quality_rules
from test_llm import brute_groups, brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(40)
    passage = prose(60)
    texts = [prose(rng.randint(60, 200)) for _ in range(60)]
    texts += [texts[0], texts[1] + " end", texts[2].upper(), prose(10), "", None, "### $$$ " * 60]
    texts += [f"{prose(70)} {passage} {prose(70)}" for _ in range(4)]
    texts += [f"{prose(80)}. {item} {prose(50)}", prose(60) + " " + " ".join(item.split()[5:35])]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[4], None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(docs.collect())
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    kept = sorted(seen[0], key=key)
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(source).selectExpr("_row.doc_id", "kept").collect()}
    assert [r.doc_id for r in kept] == [r[0] for r in rows if verdict[r[0]]]
    assert len(kept) > 50 and not {63, 64, 65, 66} & {r.doc_id for r in kept}
    sets, group = brute_groups([(r.doc_id, r.text) for r in kept], 5, 80)
    first = {}
    for r, g in zip(kept, group):
        first.setdefault(g, r.doc_id)
    unique = sorted(seen[1], key=key)
    assert [r.doc_id for r in unique] == [r.doc_id for r, g in zip(kept, group) if first[g] == r.doc_id]
    cut = sorted(seen[2], key=key)
    assert [r.doc_id for r in cut] == [r.doc_id for r in unique]
    for r, (text, _, _) in zip(cut, brute_repeats([r.text.encode() for r in unique])):
        assert r.text == text.decode("utf-8", "ignore") and r.n_chars == len(r.text)
    clean = {r.doc_id for r in seen[3]}
    assert {r.doc_id for r in cut} - clean == {71, 72}
    library = Tokenizer.from_file(bpe.default_path())
    text = {r.doc_id: r.text for r in seen[3]}
    assert {r.doc_id for r in seen[4]} == clean
    for r in seen[4]:
        assert np.array_equal(r.ids, library.encode(text[r.doc_id], add_special_tokens=False).ids) and r.n_tokens == len(r.ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == clean


def test_repeated_rows(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows = [(i, prose(60), "en", None, 300) for i in range(8)]
    twice = [(8, prose(60)[:400], "en", "s", 400), (None, prose(60), None, None, None)]
    rows += twice * 3 + [(9, "", "en", "s", 0)] * 2
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), sorted(r[1] for r in rows[:8] + twice)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k in (1, 2, 3):
            assert sorted(r.text for r in docs.collect() if r.text) == want
    assert docs.count() == len(want)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
