"""Words of Latin letters: asked for once, without what has nothing left to do, with the library's ids."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm import bpe, token_files


def wrong(model, path, texts):
    """The texts whose ids are not the library's."""
    whole, at, bad = Tokenizer.from_file(path), 0, []
    for ids, ends in model.encode(pa.array(texts, pa.string()), 4096):
        for a, b in zip(ends[:-1], ends[1:]):
            if not np.array_equal(ids[a:b], whole.encode(texts[at], add_special_tokens=False).ids):
                bad.append(texts[at])
            at += 1
    assert at == len(texts)
    return bad


def test_a_word_is_asked_for_once_whatever_its_signs_and_capitals():
    model = token_files.LibraryBpe(bpe.default_path())
    asked, library = [], model.library

    class Noting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            return library.encode(text, **options)

    model.library = Noting()
    runs = ["été", "Été", "été!!", "ÉTÉ,", "straße", "Straße;", "Ñandú", "the"]
    model.prepare(runs)
    assert len(asked) == 4
    whole = Tokenizer.from_file(bpe.default_path())
    assert [np.frombuffer(model.runs[r], "<u4").tolist() for r in runs] == [whole.encode(r, add_special_tokens=False).ids for r in runs]
    assert library.normalizer is None and library.pre_tokenizer is None


@pytest.mark.parametrize("made", [token_files.LibraryBpe, bpe.Bpe])
def test_ids_of_odd_words_are_the_library_s(made):
    letters = [c for c in map(chr, range(0x250)) if bpe.PLAIN.fullmatch(c) and c.isalpha()]
    assert len(letters) > 200 and "İ" not in letters
    texts = [f"a{c}{c}!? {c}, {c}́. {c}#*\t'{c}'s {c}.{c} {c}1, {c}<|endoftext|>! " for c in map(chr, range(0xA0, 0x250))]
    texts += ["", "\x00 \x1c\x1d a\x7f. ", "é, e̸= ≠", "x" * 100 + "! " + "é" * 70 + "?? ", "<|EndOfText|> |> t|> <|startoftext|", " é, b. c! ", "日本, слово. ά; \U0001f600! "]
    rng = random.Random(5)
    signs = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ 0 \n\t́ <|endoftext|>")
    texts += ["".join(rng.choice(letters if rng.random() < 0.6 else signs) for _ in range(rng.randrange(60))) for _ in range(800)]
    assert wrong(made(bpe.default_path()), bpe.default_path(), texts) == []


def test_signs_stay_with_a_letter_that_ends_an_added_token(tmp_path):
    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 49408, "content": "<end]"})
    path = str(tmp_path / "ends.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    assert wrong(token_files.LibraryBpe(path), path, ["a <end] b <end], c, <end]\n", "the <end]", "x] "]) == []
