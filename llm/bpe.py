"""BPE encoding with a segment tree over adjacent pair ranks, and decoding.

A piece of n symbols has n - 1 adjacent pairs.  The leaves of a segment tree hold (merge rank, position) of the
pairs, each node the lesser of its children, so the root is the leftmost pair of lowest rank.  A merge changes at
most three leaves (its own, its left and its right neighbour), each mended in log n steps; the loop ends when the
root holds no mergeable pair.  A piece of n characters thus costs n log n, whatever its length.

Text is cut at ASCII blanks first: neither the normaliser (canonical composition, blanks, lower case) nor the
pre-tokeniser's pattern joins anything over a blank, so a run without blanks has the same ids wherever it stands.
A batch's distinct runs are encoded once, and a worker keeps the runs and pieces it has met in tables of bounded
size; that only saves time.

Defined cases: null text is empty and has no ids; repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from llm import bytescan
from llm.bytescan import trim
from llm.common import small_batches

NONE = 1 << 62
SLICE = 4 << 20
#: Latin letters, each a character of its own that composes with no other of them, and signs of which one piece is made.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
SIGNS = r"!-&(-/:;=?@\[-`{-~"
#: Letters, then signs that form one piece: lower case and nothing else to normalise.
PLAIN = re.compile(f"([{LETTERS}]+)([{SIGNS}]*)")


class Known(dict):
    """A table of at most keep short keys; what is not there is worked out.

    Half of them are the newest; when these are full, the older half is dropped but for what was asked for since.
    """

    def __init__(self, make, keep: int):
        self.make, self.half, self.older = make, max(keep // 2, 1), {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            self.add(key, got)
        return got

    def add(self, key: str, got: bytes) -> None:
        if len(self) >= self.half:
            self.older = dict(self)
            super().clear()
        self[key] = got

    def missing(self, keys: list[str]) -> list[str]:
        """The keys that would have to be worked out."""
        older = self.older
        return [k for k in keys if k not in self and k not in older]

    def clear(self) -> None:
        super().clear()
        self.older = {}


class Bpe:
    """The model of a tokenizers JSON file of type BPE with an end-of-word suffix."""

    KEEP = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks = {(a, b): i for i, (a, b) in enumerate(model["merges"])}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        #: capitals matter only next to combining marks, and in the names of added tokens
        self.as_written = "|".join(["[\u0300-\u036f]", *(f"(?i:{re.escape(a)})" for a in added)])
        #: unless an added token ends with a letter and signs, these signs can be set apart from the letter
        self.apart = not any(re.search(f"[{LETTERS}][{SIGNS}]+$", a) for a in added)
        self.library = library = Tokenizer.from_file(path)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.names = {i: t for t, i in {**self.vocab, **added}.items()}
        top = max(self.names) + 1
        self.spelled = [(self.names.get(i, "") + " ").encode() for i in range(top)]
        self.letters = _byte_letters()
        self.pieces, self.runs = Known(self.piece, self.KEEP), Known(self.run, self.KEEP)

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the merges to the symbols of one piece."""
        n = len(symbols)
        if n < 2:
            return symbols
        ranks = self.ranks
        size = 1
        while size < n - 1:
            size *= 2
        tree = [NONE] * (2 * size)  # rank * n + position; the lesser number is the leftmost of the lowest rank
        for i in range(n - 1):
            r = ranks.get((symbols[i], symbols[i + 1]))
            if r is not None:
                tree[size + i] = r * n + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        while tree[1] < NONE:
            i = tree[1] % n
            j = after[i]
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[j]
            after[i] = k
            if j < n - 1:
                put(j, NONE)
            if k < n:
                before[k] = i
                r = ranks.get((symbols[i], symbols[k]))
                put(i, NONE if r is None else r * n + i)
            else:
                put(i, NONE)
            h = before[i]
            if h >= 0:
                r = ranks.get((symbols[h], symbols[i]))
                put(h, NONE if r is None else r * n + h)
        return [s for s in symbols if s]

    def piece(self, piece: str) -> bytes:
        """Ids of one piece of text."""
        letters, vocab = self.letters, self.vocab
        symbols = [letters[b] for b in piece.encode()]
        symbols[-1] += self.suffix
        return b"".join([vocab[s].to_bytes(4, "little") for s in self.merge(symbols) if s in vocab])

    def _part(self, text: str) -> bytes:
        """Ids of text without added tokens."""
        normal = self.normalise(text)
        return b"".join([self.pieces[normal[a:b]] for _, (a, b) in self.cut(normal)])

    def run(self, run: str) -> bytes:
        """Ids of any text; of a run without blanks when called by encode."""
        if not run:
            return b""
        if plain := PLAIN.fullmatch(run):
            word, signs = plain.groups()
            return self.pieces[word.lower()] + (self.pieces[signs] if signs else b"")
        if self.special is None or not any(a in run for a in self.added):
            return self._part(run)
        parts = self.special.split(run)
        return b"".join([self.added[p].to_bytes(4, "little") if k % 2 else self._part(p) if p else b"" for k, p in enumerate(parts)])

    def forget(self) -> None:
        """Drop the known words, so that a worker that lives on for other stages holds the model alone."""
        self.pieces.clear()
        self.runs.clear()
        trim()

    def prepare(self, runs: list[str]) -> None:
        """Called with the distinct runs of a slice before they are looked up."""

    def encode(self, texts: pa.Array, size_limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of whole texts as (ids, offsets of the texts), for slices of about size_limit bytes, in order."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size_limit, side="right")))
            part = texts.slice(at, to - at)
            if not pc.any(pc.match_substring_regex(part, self.as_written)).as_py():
                part = pc.ascii_lower(part)
            if self.apart:  # signs between a letter and a blank are a piece of their own: fewer distinct runs
                part = pc.replace_substring_regex(part, rf"([{LETTERS}])([{SIGNS}]+)(\s)", r"\1 \2\3")
            lists = pc.ascii_split_whitespace(part)
            runs = lists.flatten().dictionary_encode()
            distinct = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
            self.prepare(distinct)
            coded = list(map(self.runs.__getitem__, distinct))
            table = np.frombuffer(b"".join(coded), "<u4")
            size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            place = runs.indices.to_numpy()
            count = size[place]
            before = np.concatenate([[0], np.cumsum(count)])
            start = (np.cumsum(size) - size)[place]
            ids = table[np.repeat(start - before[:-1], count) + np.arange(before[-1])]
            yield ids, before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            at = to
            del part, lists, runs, distinct, coded, table, place, count, before, start, ids
            trim()

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of the ids (names joined by a blank, as a file without a decoder asks for), in UTF-8."""
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids.tolist()])[:-1]


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


bytescan.kept["bpe"] = load.cache_clear


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, text: str = "text", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with three columns more: ids (array of int), n_tokens and decoded text; columns of these names are replaced.

    With keep_text=False the text column is left out, and so need not come back from the workers.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "n_tokens", "decoded")
    where, names = path or default_path(), docs.columns
    kept = [c for c in names if keep_text or c != text]
    shown = docs.select(*[f"`{c}`" for c in kept]).selectExpr("*", "cast(null as array<int>) AS ids", "0L AS n_tokens", "'' AS decoded").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytescan.forget("bpe")
        bpe = load(where)
        try:
            for batch in batches:
                at = 0
                for ids, ends in bpe.encode(batch.column(names.index(text)), SLICE // 4):
                    n = len(ends) - 1
                    told = [bpe.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4")))
                    cols = [*batch.select(kept).slice(at, n).columns, lists, pa.array(np.diff(ends), pa.int64()), pa.array([t.decode() for t in told], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, [*kept, "ids", "n_tokens", "decoded"])
                    at += n
        finally:
            bpe.forget()

    return docs.mapInArrow(work, shown)


def digests(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text, without carrying either out of the task."""
    small_batches(docs.sparkSession)
    where = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(where)
        for batch in batches:
            at = 0
            for ids, ends in bpe.encode(batch.column(1)):
                n = len(ends) - 1
                each = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), pa.array(np.diff(ends), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in each], pa.string()),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += n

    return docs.select("doc_id", text).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
