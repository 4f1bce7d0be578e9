"""The tables of known words: bounded, and what is asked for again stays."""

from llm import bpe, token_files


def test_frequent_words_outlive_rare_ones():
    made = []
    known = bpe.Known(lambda k: made.append(k) or k.encode(), 8)
    for i in range(100):
        assert known["the"] == b"the" and known[f"rare{i}"] == f"rare{i}".encode()
        assert len(known) + len(known.older) <= 8
    assert made.count("the") == 1 and len(made) == 101
    known.clear()
    assert not known and not known.older


def test_library_is_not_asked_for_known_words(monkeypatch):
    monkeypatch.setattr(token_files.LibraryBpe, "KEEP", 40)
    model = token_files.LibraryBpe(bpe.default_path())
    asked, library = [], model.library

    class Noting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            asked.append(text)
            return library.encode(text, **options)

    model.library = Noting()
    for i in range(60):
        runs = ["common", "", f"w{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}"]
        model.prepare(runs)
        for r in runs:
            assert model.runs[r] == bytes(b"".join(x.to_bytes(4, "little") for x in library.encode(r, add_special_tokens=False).ids))
    assert asked.count("common") == 1 and len(asked) == 61
