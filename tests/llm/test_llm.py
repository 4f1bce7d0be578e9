"""Small cases of every operator against brute force: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import html
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from llm import bpe, decontamination, histogram_shards, html_text, kneser_ney, prefix_tree_join, quality_rules, suffix_dedup, token_files, warc
from llm.common import components, scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, `row` int, text_hash string"
BLANKS = rb"[^\x20\x09-\x0D]+"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, blanks, one very long text; ids with null and repeats."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    passage = prose(rng, 60, words)
    texts = [prose(rng, rng.randint(5, 160), words) for _ in range(40)]
    texts += [f"{prose(rng, 30, words)}\n{passage}\n{prose(rng, 30, words)}" for _ in range(6)]
    base = prose(rng, 400, words).split()
    for k in range(6):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [texts[0], texts[0], texts[3], "", None, " \n\t ", "one two", "one two", "Ab Cd", "aB cD", "same line\nsame line\nsame line\n" * 30]
    texts.append(prose(rng, 30_000, words))
    texts.append("x" * 70_000)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None]), len(t or ""), "n", 1, "h") for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, texts[5], None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(BLANKS, (text or "").encode())


def test_quality_measures(docs, corpus, none):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(docs).selectExpr("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()}
    for doc_id, text, *_ in corpus:
        w = [x.decode() for x in words_of(text)]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        r = got[doc_id, len(w)]
        assert (r.word_chars, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(lines) - len(set(lines)), len(hit))
        assert r.n_symbols == sum((text or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.filter_rules(docs).columns == docs.columns
    assert quality_rules.filter_rules(none).count() == 0


def test_quality_buckets(spark):
    df = spark.range(5000).selectExpr("id as x").withColumn("b", quality_rules.bucket(quality_rules.F.col("x")))
    rows = df.withColumn("low", quality_rules.bucket_low(quality_rules.F.col("b"))).collect()
    assert all(r.low <= r.x < r.low * 1.126 + 1 for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def brute_repeats(texts, length=200):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        yield bytes(x for x, m in zip(t, mark) if not m), sum(mark), sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1]))


def test_difference_cover():
    cover = suffix_dedup.COVER.tolist()
    assert {(a - b) % suffix_dedup.PERIOD for a in cover for b in cover} == set(range(suffix_dedup.PERIOD))


def test_suffix_dedup(docs, corpus, none):
    short = [r for r in corpus if len(r[1] or "") < 60_000]
    texts = [(r[1] or "").encode() for r in corpus]
    want = Counter()
    for (row, (kept, gone, spans)) in zip(corpus, brute_repeats(texts)):
        want[row[0], len((row[1] or "").encode()), gone, spans, hashlib.sha256(kept).hexdigest()] += 1
    got = Counter(tuple(r) for r in suffix_dedup.digests(docs).collect())
    assert got == want and len(short) > 50
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(corpus)
    assert out.filter("text is null").count() == sum(r[1] is None for r in corpus)
    assert suffix_dedup.digests(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_shifts(spark, seed):
    rng = random.Random(seed)
    pool = [bytes(rng.choice(b"ab c") for _ in range(rng.randint(150, 900))).decode() for _ in range(6)]
    texts = []
    for _ in range(25):
        cut = [(p := rng.choice(pool))[rng.randrange(0, 60) : len(p) - rng.randrange(0, 60)] for _ in range(rng.randint(0, 3))]
        texts.append("".join(cut) + str(rng.random()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(df).collect()}
    for i, (kept, gone, spans) in enumerate(brute_repeats([t.encode() for t in texts])):
        assert got[i] == (gone, spans, hashlib.sha256(kept).hexdigest())


def brute_groups(rows, size, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for row in rows:
        w = re.findall(BLANKS, (row[1] or "").encode().translate(low))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sets, group


def test_prefix_tree_join(docs, corpus, none):
    sets, group = brute_groups(corpus, 4, 85)
    least = {}
    for row, g in zip(corpus, group):
        if row[0] is not None:
            least[g] = min(least.get(g, 1 << 60), row[0])
    want = Counter((row[0], len(s), least.get(g, row[0]) if s else row[0]) for row, s, g in zip(corpus, sets, group))
    assert Counter(tuple(r) for r in prefix_tree_join.component_rows(docs).collect()) == want
    assert prefix_tree_join.component_rows(none).count() == 0


def test_repeated_row_gives_one_set(spark):
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words[:199], "other"])
    rows = spark.createDataFrame([(1, near), (3, "alone by itself in here")], "doc_id long, text string").union(
        spark.range(20_000).selectExpr("2L", f"'{' '.join(words)}'"))
    got = Counter((r.doc_id, r.component_id) for r in prefix_tree_join.component_rows(rows).collect())
    assert got == {(1, 1): 1, (2, 1): 20_000, (3, 3): 1}


def test_unique_documents(docs, corpus):
    sets, group = brute_groups(corpus, 5, 80)
    got = prefix_tree_join.unique_documents(docs)
    assert got.columns == docs.columns
    want = {min(r[0] for r, h in zip(corpus, group) if h == g and r[0] is not None) for g, s in zip(group, sets) if s}
    want |= {r[0] for r, s in zip(corpus, sets) if not s}
    assert {r.doc_id for r in got.select("doc_id").collect()} == want


def test_join_sets_blocks():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 40, 200).astype(np.uint64))
    sets = []
    for _ in range(700):
        drop = rng.integers(0, len(base), rng.integers(0, 30))
        sets.append(np.unique(np.concatenate([np.delete(base, drop), rng.integers(0, 1 << 40, rng.integers(0, 12)).astype(np.uint64)])))
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    pairs = prefix_tree_join.join_sets(np.concatenate(sets), start, np.array([len(s) for s in sets]), 85)
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in pairs:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)
        group[find(a)] = find(b)
    for a in range(0, len(sets), 7):
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if a != b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert find(a) == find(b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 10 != 9] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(60)) and all(got[k] == 100 for k in range(100, 140))


def test_decontamination(spark, none):
    item = "A train leaves Boston at 9 and runs 120 km to reach Albany before the other one that leaves at 9 as well today."
    text = {
        1: f"Some words first. {item} And after.",
        2: "Well then. " + item.replace("9", "7").replace("120", "300").replace("Boston", "Madrid"),
        3: "Well then. " + item.replace("at 9 and", "at 4 and").replace("120", "300"),  # one 9 changed, the other not
        4: "A train leaves the station in the morning and that is all there is to say about it on this page today.",
        5: None, 6: "", 7: item,
    }
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None)], "item_id long, text string")
    rows = [(k, t, None, None, None, "n", 1, "h") for k, t in text.items()] + [(1, text[1], None, None, None, "n", 1, "h")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()}
    assert found >= {(1, 10), (2, 10), (7, 10)} and not {(4, 10), (5, 10), (6, 10)} & found
    kept = decontamination.clean_documents(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {4, 5, 6}
    lined = {r.doc_id: r.n_windows for r in decontamination.matches(docs, bench).collect()}
    assert lined.get(3, 0) < lined[2]
    assert decontamination.matches(none, bench).count() == 0
    assert decontamination.matches(docs, bench.limit(0)).count() == 0


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.n_windows for r in decontamination.matches(docs, bench).collect()}


def test_decontamination_capitals(spark):
    item = "The river Elbe flows past Dresden and Hamburg before it finally reaches the cold North Sea near Cuxhaven harbour."
    passage = " ".join(item.split()[2:14])
    texts = [item.upper(), item.lower(), f"so IT SAID {passage.upper()} as ever", "THE RIVER ELBE FLOWS PAST A TOWN THAT NOBODY KNOWS AND REACHES THE SEA"]
    assert {d for d, _ in leaks(spark, texts, [item])} == {0, 1, 2}


def test_decontamination_short_items(spark):
    items = ["What is the capital of Xanadu?", "Add 3 km, 40 m, 7 cm and 12 mm to 5 km.", "Who?", "...", "What is the capital of Xanadu", "Name it now"]
    texts = ["Tell me: what is THE capital of Xanadu? Nobody knows.", "add 3 km, 40 m, 7 cm and 12 mm to 5 km", "what is the capital of Spain", "who", "Xanadu", "name", "it. Name it now"]
    want = {(0, 0), (0, 4), (1, 1), (3, 2), (6, 5)}
    assert set(leaks(spark, texts, items)) == want


def test_decontamination_one_slot_changed(spark):
    item = "A train leaves Boston at 9 and runs 120 km to reach Albany before the other one that leaves at 9 as well today."
    two = "We gave 2 red apples to the first child in line and then 2 green pears to another child who came later."
    texts = [
        item.replace("9 as", "8 as"),  # near copy, one number of two edited
        item.replace("9 and", "7 and").replace("120", "300").replace("9 as", "8 as"),  # all changed, the equal ones apart
        two.replace("2 red", "3 red").replace("2 green", "5 green"),
        item.replace("9", "7"),
    ]
    got = leaks(spark, texts, [item, two])
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 0)}
    slots = item.split()
    assert got[0, 0] == sum("9" not in slots[i : i + 8] or i + 8 <= slots.index("as") - 1 for i in range(len(slots) - 7))
    assert got[1, 0] < got[3, 0]


def test_decontamination_probes(spark):
    """The places around anchors hold every window that an item has, and few others."""
    rng = random.Random(4)
    words = ["river", "Elbe", "flows", "past", "12", "km", "3rd", "Mary", "of", "the", "ΟΔΟΣ", "Σ.", "İzmir", "naïve", "a.b", "it's", "--", "«Le»", "Ⅷ", "10,5", "q…", "-x-"]

    def text(n):
        return rng.choice(["", " ", ".. "]) + "".join(rng.choice(words) + rng.choice(["", "", ".", ",", "?!"]) + rng.choice([" ", " ", "\n", "\t ", " - "]) for _ in range(n))

    texts = [text(rng.randrange(50)) for _ in range(300)] + [None, "", " ", " .. . ", "-" * 100_000 + "x"]
    items = [" ".join(t.split()[k : k + 14]).replace("12", "40") for t in texts[:80] for k in (0, 3)] + ["Mary", "the river", "ΟΔΟΣ Σ. 12 km Mary", "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    found = decontamination.item_windows(spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).cache()
    keys, anchors = found.select("key").distinct(), found.select("code", "at").distinct()
    short = sorted({r[0] for r in found.select(F.size("slots")).collect() if r[0] < decontamination.WINDOW})
    assert 1 in short and 2 in short
    probed = decontamination.probes(docs, anchors, found.count(), short)
    got = {tuple(r) for r in probed.join(keys, "key").select("doc_id", "pos", "key").collect()}
    slots = docs.select("doc_id", decontamination.hashed(decontamination.slots_of(F.col("text"))).alias("h"))
    both = F.col("both")
    every = slots.select("doc_id", F.explode(decontamination.windows(F.col("h"))).alias("both")).select("doc_id", both["pos"].alias("pos"), F.explode(F.array(both["template"], both["plain"])).alias("key"))
    for size in short:
        at = F.explode(F.expr(f"transform(filter(sequence(0, size(h.w)), i -> i + {size} <= size(h.w)), i -> struct(i AS pos, slice(h.w, i + 1, {size}) AS w))"))
        every = every.union(slots.select("doc_id", at.alias("both")).select("doc_id", both["pos"], F.xxhash64(both["w"])))
    want = {tuple(r) for r in every.join(keys, "key").select("doc_id", "pos", "key").collect()}
    assert got == want and len({k for _, _, k in want}) > 300
    # a frequent pair that a window only begins with is no anchor, and the words are split once
    item = spark.createDataFrame([(1, "of the seventeen wonderful elephants that never forgot anything whatsoever")], "item_id long, text string")
    known = decontamination.item_windows(item).cache()
    plain = spark.createDataFrame([(1, "of the " * 500, 1)], "doc_id long, text string, text_hash long")
    probed = decontamination.probes(plain, known.select("code", "at").distinct(), known.count())
    assert probed.count() == 0
    assert "size(split(" not in probed._jdf.queryExecution().executedPlan().toString()


def test_bpe(docs, corpus, none):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library = Tokenizer.from_file(path)
    model = bpe.load(path)
    rng = random.Random(5)
    signs = "abAB 'sŚ̀éÉİIΣς  \u0085 \t\n<|endoftext|>½日😀ﬁ각가0123.,!?\x00\x1c"
    texts = ["".join(rng.choice(signs) if rng.random() < 0.9 else rng.choice(["<|endoftext|>", "<|startoftext|>", "'ll"]) for _ in range(rng.randrange(25))) for _ in range(3000)]
    texts += [r[1] or "" for r in corpus] + ["ab" * 5000]
    coded = [ids[a:b] for ids, ends in model.encode(pa.array(texts)) for a, b in zip(ends[:-1], ends[1:])]
    for text, ids in zip(texts, coded):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert model.decode(ids).decode() == library.decode(want, skip_special_tokens=False)
    rows = Counter((r.doc_id, r.n_tokens) for r in bpe.digests(docs).collect())
    assert rows == Counter((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus)
    assert bpe.encode_decode(docs).columns == [*docs.columns, "ids", "n_tokens", "decoded"]
    assert bpe.digests(none).count() == 0


def test_variable_length_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.pack(v)
        assert (token_files.unpack(control, data, n) == v).all()
    with pytest.raises(ValueError):
        token_files.unpack(control, data[:-1], n)


def test_token_files(spark, docs, corpus, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.default_path())
    folder = scratch_path(spark, "test-tokens")
    token_files.write_tokens(docs, folder)
    rows = token_files.read_tokens(spark, folder).collect()
    by_start = sorted(rows, key=lambda r: r.start)
    assert by_start[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(by_start, by_start[1:]))
    ids = [r.doc_id for r in by_start]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    want = Counter((r[0], zlib.crc32(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in corpus)
    assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in rows) == want
    files = sorted(pathlib.Path(folder, "blocks").glob("*.parquet"))
    by_name = [i for f in files for block in pq.read_table(f, columns=["doc_ids"]).column(0).to_pylist() for i in block]
    assert len(files) > 1 and by_name == ids
    empty = scratch_path(spark, "test-tokens")
    token_files.write_tokens(none, empty)
    assert token_files.read_tokens(spark, empty).count() == 0


PAGES = "page_id long, url string, html string, digest string"


def test_warc(spark):
    big = "<p>" + "same words again " * 20 + "</p>"
    rows = [(5, "http://a/x", big, "d"), (3, "http://b/y", big, "d"), (None, None, big, "d"), (9, "u\r\nX: y", "short", "d"), (8, "u", "short", "d"), (7, "u", None, "d"), (6, "u", "é" * 50_000, "d"), (6, "u", "é" * 50_000, "d")]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    folder = scratch_path(spark, "test-warc")
    warc.write_archives(df, folder)
    got = warc.read_archives(spark, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter([
        (3, len(big), "response", None), (5, len(big), "revisit", 3), (None, len(big), "revisit", 3), (9, 5, "response", None), (8, 5, "response", None),
        (7, 0, "response", None), (6, 100_000, "response", None), (6, 100_000, "response", None)])
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got)
    empty = scratch_path(spark, "test-warc")
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_validation():
    import struct

    import zstandard

    coder = zstandard.ZstdCompressor()
    good = warc.record(1, "http://a", b"body", hashlib.sha256(b"body").hexdigest(), None)
    packed = coder.compress(zstandard.ZstdCompressionDict(b"dictionary bytes" * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT).as_bytes())
    archive = struct.pack("<II", warc.MAGIC_DICTIONARY, len(packed)) + packed + coder.compress(good) + warc.EMPTY_FRAME + coder.compress(good)
    assert [warc.parse_record(raw)[1] for _, raw in warc.frames(archive)] == [b"body", b"body"]
    for bad in (archive[:-3], archive + b"xyz", archive + b"not a frame", archive[:20]):
        with pytest.raises(Exception):
            list(warc.frames(bad))
    for bad in (good.replace(b"Content-Length: 4", b"Content-Length: 5"), good.replace(b"body", b"bodz"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date: ", b"X-Date: ")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_histogram_shards(spark, docs, corpus, none):
    rows = histogram_shards.shard_documents(docs, 4).collect()
    assert len(rows) == len(corpus)
    for k in {r._shard for r in rows}:
        assert sorted(r._slot for r in rows if r._shard == k) == list(range(sum(r._shard == k for r in rows)))
    assert histogram_shards.shard_documents(none).count() == 0
    # a third of the rows are one text: the law holds, and only that group is split
    many = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot text ', 20), concat(repeat('a', 150), id % 1500)) as text")
    out = histogram_shards.shard_documents(many, 8).selectExpr("text", "_size", "_shard", "doc_id").toPandas()
    size = out.groupby("_shard")._size.sum()
    assert len(size) == 8 and size.max() - size.min() < 0.01 * size.mean()
    split = out.groupby("text")._shard.nunique()
    assert set(split[split > 1].index) <= {"hot text " * 20} | set(split[split == 2].index) and (split > 1).sum() <= 8
    assert sorted(out.doc_id) == list(range(6000))


def test_html_blocks():
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><div class='top-banner'>ad</div><header>H</header><nav><ul><li>menu</ul></nav>"
        "<article><h1>A &amp; B</h1><p>one\n two&nbsp;<b>bold<br>next<p>three &lt;x&gt; 1 < 2<!-- <p>no --></p><script>var t='</p>'</script>"
        "<aside>side</aside><div id=comments><p>nice</p></div><form>f</form><blockquote>four</blockquote></article><footer>foot</footer></body></html><foo")
    assert html_text.main_text(page, 1, lambda k: np.zeros(len(k), bool)) == "A & B\n\none two bold next\n\nthree <x> 1 < 2\n\nfour"
    assert html_text.main_text("", 1, lambda k: np.zeros(len(k), bool)) == ""
    assert html_text.main_text("<nav>only</nav>", 1, lambda k: np.zeros(len(k), bool)) == ""


def test_html_copies_and_quotes(spark):
    rng = random.Random(6)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    copied, parts, quoted, notice = word(60), [word(40), word(30)], word(30), word(25)
    pages = [f"<p>{copied}</p><footer>{i}</footer>" for i in range(4)]
    pages += [f"<p>{parts[0]}</p><p>{parts[1]}</p>"] * 4
    pages += [f"<p>{word(20 + i)}</p><p>{copied}</p>" for i in range(3)]  # reposts with an introduction
    pages += [f"<article><p>{quoted}</p></article>"] + [f"<article><p>{word(20)}</p></article><aside>{quoted}</aside>" for _ in range(4)]
    own = [word(40) for _ in range(3)]
    pages += [f"<p>{x}</p><p>{notice}</p>" for x in own]
    rows = [(i, f"http://h.example/{i}", p, "d") for i, p in enumerate(pages)]
    got = {r.page_id: r.main_text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == copied for i in range(4)) and all(got[i] == "\n\n".join(parts) for i in range(4, 8))
    assert all(got[i].endswith(copied) for i in range(8, 11)) and got[11] == quoted
    assert [got[i] for i in range(16, 19)] == own


def test_html_article_in_marked_container():
    text = lambda page: html_text.main_text(page, 1, lambda k: np.zeros(len(k), bool))
    article = "<article><div class='entry-header'><h1>Head</h1></div><p>body</p><div class='comments'>nice</div></article>"
    for before, after in (("<div class='content with-sidebar'>", "</div>"), ("<div id='header-wrap'>", "</div>"), ("<form id=all>", "</form>"), ("<div class='header'>", "</div>")):
        assert text(f"{before}<p>menu</p>{article}{after}<p>more</p>") == "Head\n\nbody"
    assert text("<form><p>no article here</p></form>") == "no article here"
    assert text(f"<aside>{article}</aside>") == text(f"<div class='comments'>{article}</div>") == text(f"<nav>{article}</nav>") == ""


def test_suffix_groups():
    rng = random.Random(2)
    streams = [np.array([rng.randrange(1, 4) for _ in range(rng.randrange(0, 80))], np.uint64) for _ in range(12)]
    want = Counter()
    for s in streams:
        want.update({tuple(s[i : i + html_text.DEPTH].tolist()) for i in range(len(s) - html_text.DEPTH + 1)})
    key, count = html_text.suffix_groups(streams, 9)
    assert Counter(count.tolist()) == Counter(want.values()) and len(set(key.tolist())) == len(want)


def test_html_extract(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    notice = word(25)
    rows = [(i, "http://h.example/x", f"<div>{word(30)}</div><div>{notice}</div><p>{word(5)}</p>", "d") for i in range(5)]
    rows += [(10, "http://h.example/y", f"<article><p>{word(30)}</p></article><div>{word(20)}</div>", "d"), (11, None, None, "d"), (12, "http://h.example/y", "", "d"), rows[0]]
    df = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r.main_text for r in html_text.extract(df).collect()}
    for i in range(5):
        parts = re.findall(r">([^<]+)<", rows[i][2])
        assert got[i] == f"{parts[0]}\n\n{parts[2]}"
    assert got[10] == re.search(r"<p>([^<]+)", rows[5][2])[1] and got[11] == got[12] == ""
    monkeypatch.setattr(html_text, "BROADCAST_KEYS", -1)
    assert {r.page_id: r.main_text for r in html_text.extract(df).collect()} == got
    assert html_text.extract(df.limit(0)).count() == 0
    assert html.unescape("&amp;") == "&"


def brute_kneser_ney(texts, order):
    """p(gram) by the textbook formulas over Counters."""
    top = Counter()
    for t in texts:
        b = bytes([2]) * (order - 1) + t.encode() + bytes([3])
        top.update(b[i : i + order] for i in range(len(b) - order + 1))
    count = {order: top}
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [max(0.0, min(float(k), k - (k + 1) * y * n[k + 1] / n[k])) if n[1] and n[k] else k / 2 for k in (1, 2, 3)]

    d = {k: discounts(count[k]) for k in count}
    follow = {k: {} for k in count}
    for k in count:
        for g, c in count[k].items():
            follow[k].setdefault(g[:-1], []).append(c)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 257
        f = follow[k].get(g[:-1])
        if not f:
            return p(g[1:])
        c = count[k].get(g, 0)
        back = sum(d[k][min(x, 3) - 1] for x in f) / sum(f)
        return (max(c - d[k][min(c, 3) - 1], 0) / sum(f) if c else 0) + back * p(g[1:])

    return p


def test_kneser_ney(spark, docs, corpus, none):
    good = [r for r in corpus if r[0] is not None and r[0] < 30]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(40, 0, 0), (41, 1, 1), (42, None, None)], "doc_id long, quality int, toxic int").distinct()
    got = kneser_ney.classify(docs, labels).collect()
    other = kneser_ney.classify(docs, labels, broadcast_rows=-1).collect()
    near = lambda rows: sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, round(r.perplexity or 0, 6), r.kept) for r in rows)
    assert near(got) == near(other)
    trained = [r for r in good if r[2] == "de" and r[1]]
    p = brute_kneser_ney([r[1] for r in trained], kneser_ney.ORDER)
    for r in got:
        if r.lang == "de" and 0 < r.n_bytes < 3000 and r.doc_id is not None:
            b = bytes([2]) * 3 + next(x[1] for x in corpus if x[0] == r.doc_id).encode() + bytes([3])
            want = np.exp(-sum(np.log(p(b[i : i + 4])) for i in range(len(b) - 3)) / (len(b) - 3))
            assert abs(r.perplexity - want) < 1e-5 * want
    assert all(not r.kept and r.perplexity is None for r in got if r.n_bytes == 0)
    assert kneser_ney.classify(none, labels).count() == 0
    blank = kneser_ney.classify(docs, labels.limit(0)).collect()
    assert all(r.kept == (r.n_bytes > 0) for r in blank)
