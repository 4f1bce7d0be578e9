"""Benchmark decontamination by template canonicalisation (native expressions only).

A text becomes a sequence of slots: words in lower case without surrounding punctuation, where a number becomes <num>,
a unit after a number <unit>, and a word with a capital inside a sentence <name>.  Windows of WINDOW slots are hashed
and joined with the windows of the benchmark items that hold at least PLAIN ordinary words; an item with changed numbers,
names or units has the same template, so the same windows.  A second set of windows, over the plain words in lower case,
finds passages whose slots differ only because their capitals do.  An item of fewer than WINDOW slots is one window of plain
words over its whole length, and documents are probed for the few lengths that occur.  A document's windows are hashed only
around an anchor: two words side by side that every match of some window has (PLAIN ordinary words of WINDOW slots always
leave two neighbours).  For one alignment (place in the document minus place in
the item) every value of the item stands for the document's value that most of its slots have (on a tie, the item's own); windows
that contradict it don't count, windows with the item's own words always do.  A document is contaminated by an item if HITS distinct windows of it
(all, if it has fewer) are found and count.

Defined cases: null text and text without a letter or digit have no windows; an item without one is never found; repeated rows are judged alike; an empty table on either side gives no matches; extra columns pass through
clean_documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import BLANK, BROADCAST_ROWS, stored

WINDOW = 8
HITS = 3
MOST_WORDS = 1 << 14  # of the bitmap of anchors: 2**20 bits
PLAIN = 5
#: Units of measure and currency.
UNITS = [
    "km", "m", "cm", "mm", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "min", "h", "hours", "hour", "minutes", "minute", "seconds",
    "days", "day", "miles", "mile", "feet", "inches", "meters", "metres", "grams", "dollars", "euros", "cents", "percent",
]
EDGES = ".,;:!?()[]{}\"'`*#%&$|<>~^_=+/\\-…«»“”‘’¿¡"
BLANKS = " \t\n\x0b\x0c\r"
_EDGE, _GAP = ("".join(f"\\x{{{ord(c):x}}}" for c in signs) for signs in (EDGES, BLANKS))
#: What lies between two words with a letter or digit, with the signs that close the first and without; linear in long runs of signs.
CLOSED = rf"(?![a-z])(?:[{_GAP}]|[{_EDGE}](?<![{_EDGE}][{_EDGE}])[{_EDGE}]*+[{_GAP}])[{_EDGE}{_GAP}]*+"
OPEN = rf"[{_GAP}][{_EDGE}{_GAP}]*+"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _spelled(words: Column) -> Column:
    """(raw, core) per word that has more than EDGES."""
    return F.filter(F.transform(words, lambda w: F.struct(w.alias("raw"), F.btrim(w, F.lit(EDGES)).alias("core"))), lambda w: w["core"] != "")


def judged(words: Column, make) -> Column:
    """make(kind, core) for every word with a letter or digit, in order; kind names a placeholder or is null."""

    def digit(core: Column) -> Column:
        return (F.ascii(core) <= 57) & (F.ascii(core) >= 48)

    def one(words: Column) -> Column:
        def slot(w: Column, i: Column) -> Column:
            core, before = w["core"], F.get(words, i - 1)
            first = F.substring(core, 1, 1)
            unit = digit(before["core"]) & F.lower(core).isin(UNITS)
            # most words begin with a small letter, which the first test settles
            name = ((F.ascii(core) < 97) | (F.ascii(core) > 122)) & (first != F.lower(first)) & F.coalesce(~F.right(before["raw"], F.lit(1)).isin(".", "!", "?", ":"), F.lit(False))
            return make(F.when(digit(core), "<num>").when(unit, "<unit>").when(name, "<name>"), core)

        return F.transform(words, slot)

    return _let(_spelled(words), one)


def slots_of(text: Column) -> Column:
    """(t, w) per slot: the slot and its word in lower case."""
    return _slots(F.split(F.coalesce(text, F.lit("")), BLANK))


def _slots(words: Column) -> Column:
    return judged(words, lambda kind, core: F.struct(F.coalesce(kind, F.lower(core)).alias("t"), F.lower(core).alias("w")))


def hashed(slots: Column) -> Column:
    """(t, w): the hashes of slots and of words, as two arrays."""
    return F.struct(F.transform(slots, lambda x: F.xxhash64(x["t"])).alias("t"), F.transform(slots, lambda x: F.xxhash64(x["w"])).alias("w"))


def _window(hashes: Column, i: Column) -> list[Column]:
    """Fingerprints of the WINDOW slots from i on and of their words."""
    return [F.xxhash64(*[F.get(hashes[c], i + k) for k in range(WINDOW)]) for c in ("t", "w")]


def windows(hashes: Column) -> Column:
    """(pos, template, plain) per place: fingerprints of the WINDOW slots from there on and of their words."""

    def one(h: Column) -> Column:
        def at(i: Column) -> Column:
            template, plain = _window(h, i)
            return F.struct(i.alias("pos"), template.alias("template"), plain.alias("plain"))

        n = F.size(h["w"])
        return F.transform(F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>")), at)

    return _let(hashes, one)


def anchor(slots: Column, plenty: Column) -> Column:
    """(code, at): two neighbouring words of a window that every match of it has, and their place in it; the longest, as they are rare.

    A window told by its template also has placeholders, so both are ordinary words then.  The one word of a window of one.
    """

    def pairs(s: Column) -> Column:
        def two(i: Column) -> Column:
            a, b = F.get(s, i)["w"], F.get(s, i + 1)["w"]
            return F.struct((F.length(a) + F.length(b)).alias("many"), F.xxhash64(a, b).alias("code"), i.alias("at"))

        sure = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 2, F.lit(0))), lambda i: ~plenty | (_value(F.get(s, i)).isNull() & _value(F.get(s, i + 1)).isNull()))
        return F.array_max(F.transform(sure, two))

    return _let(slots, pairs)


def _place(code: Column, words: int) -> Column:
    return F.pmod(code, F.lit(64 * words)).cast("int")


def _marked(starts: tuple[Column, int], code: Column) -> Column:
    bitmap, words = starts
    at = _place(code, words)
    return F.getbit(F.get(bitmap, F.shiftright(at, 6)), at.bitwiseAND(63)) == 1


def bitmap_of(codes: DataFrame, known: int) -> tuple[Column, int]:
    """(bitmap, 64-bit words) of a column code of at most known values: a constant of the plan, of 16 K words at most.

    A crowded bitmap lets more through, never fewer.
    """
    words = min(1 << max((known - 1).bit_length() - 2, 4), MOST_WORDS) if known else 1
    marks = codes.select(_place(F.col("code"), words).alias("at")).distinct().groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, at & 63)) AS bits"))
    bits = [0] * words
    for r in marks.collect():
        bits[r["word"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>"), words


def probes(rows: DataFrame, anchors: DataFrame, known: int, short: Sequence[int] = ()) -> DataFrame:
    """(doc_id, text_hash, pos, key) of the places of the texts that an anchor points to: key is a fingerprint of the WINDOW slots
    from pos on, of their words, or of the L words for a length L in short; none where the text ends before.

    Every word is tested by plain expressions on the exploded row; slots are judged only around an anchor.
    """
    body = F.btrim(F.col("text"), F.lit(EDGES + BLANKS))
    words = rows.select("doc_id", "text_hash", F.split(F.lower(body), CLOSED).alias("words"), F.split(body, OPEN).alias("raws"))
    words = words.select("doc_id", "text_hash", "words", "raws", F.posexplode_outer("words").alias("at", "word"))  # without outer, the planner splits again to see whether it's empty
    code = F.xxhash64("word", F.get("words", F.col("at") + 1))
    if 1 in short:
        words = words.withColumn("code", F.explode(F.array_distinct(F.array(code, F.xxhash64("word")))))
    else:
        words = words.withColumn("code", code)
    # the window and the word before it, for any place of the anchor in the window
    since = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    near = words.filter(_marked(bitmap_of(anchors, known), F.col("code"))).select(
        "doc_id", "text_hash", "code", "at", since.alias("since"), F.size("words").alias("n"), F.slice("raws", since + 1, 2 * WINDOW - 1).alias("near"))
    found = near.join(_side(anchors.select("code", F.col("at").alias("inside")), known), "code").withColumn("pos", F.col("at") - F.col("inside")).filter("pos >= 0")
    skipped = F.least(F.col("pos"), F.lit(1))  # words before the window
    around = F.slice("near", F.col("pos") - skipped - F.col("since") + 1, WINDOW + 1)

    def told_by(h: Column) -> Column:
        keys = [(WINDOW, x) for x in _window(h, skipped)] + [(size, F.xxhash64(F.slice(h["w"], skipped + 1, size))) for size in short]
        return F.array_distinct(F.array_compact(F.array(*[F.when(F.col("pos") + size <= F.col("n"), x) for size, x in keys])))

    return found.select("doc_id", "text_hash", "pos", F.explode(_let(_let(_slots(around), hashed), told_by)).alias("key"))


def _value(slot: Column) -> Column:
    """The value of a placeholder, null for an ordinary word."""
    return F.when(F.left(slot["t"], F.lit(1)) == "<", slot["w"])


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, ipos, key, slots, plain, code, at, item_windows): both fingerprints of the items' windows, where they differ, and the anchor.

    An item of fewer slots has one window, of all its words.

    The template of a window without PLAIN ordinary words is too common to be told by; its words still are.
    """
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.col(item).alias("item_id"), slots_of(F.col(text)).alias("s"))
    found = rows.select("item_id", "s", F.explode(windows(hashed(F.col("s")))).alias("both"))
    found = found.select("item_id", F.col("both.pos").alias("ipos"), F.slice("s", F.col("both.pos") + 1, WINDOW).alias("slots"), "both.template", "both.plain")
    whole = F.xxhash64(F.transform("s", lambda x: F.xxhash64(x["w"])))
    less = rows.filter(F.size("s").between(1, WINDOW - 1)).select("item_id", F.lit(0).alias("ipos"), F.col("s").alias("slots"), whole.alias("template"), whole.alias("plain"))
    found = found.union(less).distinct()
    plenty = F.size(F.filter("slots", lambda x: _value(x).isNull())) >= PLAIN
    found = found.withColumn("anchor", anchor(F.col("slots"), plenty))
    found = found.select("item_id", "ipos", "slots", "plain", "anchor.code", "anchor.at", F.explode(F.array_distinct(F.array("plain", F.when(plenty, F.col("template")).otherwise(F.col("plain"))))).alias("key"))
    many = found.groupBy(F.col("item_id").alias("_item")).agg(F.countDistinct("plain").alias("item_windows"))
    return found.join(many, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")


def _side(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what was counted and is small; the planner shuffles anything else."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, item_windows, n_slots): the items that contaminate each document.

    n_slots counts the placeholder values compared.  text_hash tells apart rows with equal or no doc_id.
    """
    items = stored(item_windows(benchmark), "items")
    known = items.count()
    short = sorted(r[0] for r in items.select(F.size("slots")).filter(F.size("slots") < WINDOW).distinct().collect())  # at most WINDOW - 1
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    every = probes(rows, items.select("code", "at").distinct(), known, short)
    hits = every.join(_side(items.drop("slots", "code", "at"), known), "key").select("doc_id", "text_hash", "pos", "item_id", "ipos", "plain", "item_windows").distinct()
    hits = stored(hits, "hits")
    most = hits.count()
    # enough windows, whatever their slots; then the slots of those documents only
    enough = hits.groupBy("doc_id", "text_hash", "item_id").agg(F.countDistinct("plain").alias("n"), F.max("item_windows").alias("item_windows")).filter(
        F.col("n") >= F.least(F.lit(HITS), F.col("item_windows"))).select("doc_id", "text_hash", "item_id")
    hits = stored(_same(hits, enough, ["doc_id", "text_hash", "item_id"]), "hits", most)
    wanted = hits.select("doc_id", "text_hash").distinct()
    few = wanted.count()
    texts = _same(rows, _side(wanted, few), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    told = texts.select("doc_id", "text_hash", slots_of(F.col("text")).alias("s"))
    keys = [F.col(c).alias(f"_{c}") for c in ("doc_id", "text_hash")]
    both = told.join(hits.select(*keys, "pos", "item_id", "ipos", "plain", "item_windows"), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")))
    both = both.select("doc_id", "text_hash", "pos", "item_id", "ipos", "plain", "item_windows", F.slice("s", F.col("pos") + 1, WINDOW).alias("mine"))
    theirs = items.select(F.col("item_id").alias("_item"), F.col("ipos").alias("_ipos"), F.col("plain").alias("_plain"), F.size("slots").alias("many"), "slots").dropDuplicates(["_item", "_ipos", "_plain"])
    both = both.join(_side(theirs, known), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("ipos") == F.col("_ipos")) & (F.col("plain") == F.col("_plain")))
    both = both.withColumn("mine", F.slice("mine", 1, F.col("many")))
    words = [F.transform(c, lambda x: x["w"]) for c in ("mine", "slots")]
    both = both.withColumn("verbatim", words[0] == words[1])
    both = both.withColumn("shift", F.col("pos") - F.col("ipos"))
    pairs = F.filter(F.zip_with("mine", "slots", lambda a, b: F.struct(a["w"].alias("a"), _value(b).alias("b"))), lambda x: x["b"].isNotNull())
    placed = F.zip_with("mine", F.transform("slots", lambda x, k: F.struct(_value(x).alias("b"), (F.col("ipos") + k).alias("place"))),
                        lambda a, b: F.struct(b["b"].alias("b"), a["w"].alias("a"), b["place"].alias("place")))
    # one exchange; the counts of an alignment and of its values then stay in the task.  An alignment has at most the slots of one item
    line = ["doc_id", "text_hash", "item_id", "shift"]
    both = both.select(*line, "ipos", "plain", "item_windows", "verbatim", pairs.alias("pairs"), F.filter(placed, lambda x: x["b"].isNotNull()).alias("placed"))
    votes = both.repartition(*line).select("*", F.explode_outer("placed").alias("slot")).select(
        *line, "ipos", "plain", "item_windows", "verbatim", "pairs", "slot.b", "slot.a", "slot.place")
    votes = votes.withColumn("many", F.size(F.collect_set("place").over(Window.partitionBy(*line, "b", "a"))))
    chosen = F.max(F.struct("many", (F.col("a") == F.col("b")).alias("own"), "a")).over(Window.partitionBy(*line, "b"))["a"]
    agree = F.col("verbatim") | F.col("b").isNull() | (F.col("a") == chosen)
    counted = votes.withColumn("agree", agree).groupBy(*line, "ipos", "plain").agg(
        F.max("item_windows").alias("item_windows"), F.first("pairs").alias("pairs"), F.every("agree").alias("agree")).filter("agree")
    lined = counted.groupBy(*line).agg(
        F.collect_set("plain").alias("places"), F.max("item_windows").alias("item_windows"), F.size(F.array_distinct(F.flatten(F.collect_list("pairs")))).alias("n_slots"))
    return lined.select("*", F.explode("places").alias("place")).groupBy("doc_id", "text_hash", "item_id").agg(
        F.countDistinct("place").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("n_slots").cast("long").alias("n_slots"),
    ).filter(F.col("n_windows") >= F.least(F.lit(HITS), F.col("item_windows")))


def _same(rows: DataFrame, keys: DataFrame, names: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose names are (or are not) among keys, null equal to null."""
    right = keys.select(*[F.col(c).alias(f"_k_{c}") for c in names])
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(right, on, how)


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with the columns of docs."""
    bad = stored(matches(docs, benchmark, key, text).select("doc_id", "text_hash").distinct(), "leaks")
    right = _side(bad.select(F.col("doc_id").alias("_leak_key"), F.col("text_hash").alias("_leak_hash")), bad.count())
    return docs.join(right, F.col(f"`{key}`").eqNullSafe(F.col("_leak_key")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("_leak_hash")), "left_anti")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return matches(docs, benchmark).select("doc_id", "item_id", "n_windows", "item_windows", "n_slots")
