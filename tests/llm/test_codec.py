import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pagemill.llm import piece_codec as C

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "a", "e", "th", "ing", "\n", "\t", "é", "ß", "日本", "🙂", "▁", "1", "23", ".", ",", "-", "==", "aaaa", "A", "The ", "\x00", "e\u0301", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return C.Codec(C.Vocabulary.load(PATH))


def test_ids_equal_the_librarys(library, codec):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        ids = codec.encode(text)
        assert ids == library.encode(text), repr(text)
        assert codec.decode(ids) == text.replace("▁", " ")


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 3000, "thethingis" * 400, " " * 300, "=" * 500 + "-" * 333, "日" * 200])
def test_long_runs(library, codec, text):
    assert codec.encode(text) == library.encode(text)


def test_commits_early(codec):
    """Pieces come out long before the text ends, and the window stays small."""
    seen = []
    original = codec._back

    def back(last, end):
        seen.append(len(last))
        return original(last, end)

    codec._back = back
    try:
        pieces = list(codec.search("thethingis" * 2000))
    finally:
        del codec._back
    assert "".join(pieces) == "thethingis" * 2000
    assert len(seen) > 500
    assert max(seen) <= 4 * codec.vocabulary.longest


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(C, "WORDS", 3)
    monkeypatch.setattr(C, "NEIGHBOURS", 3)
    codec = C.Codec(C.Vocabulary.load(PATH))
    text = "the cat, the dog; the bird and thereafter nothing (at all) " * 3
    assert codec.encode(text) == library.encode(text)


def test_whole_operator(frame, library):
    rows = [(1, "Some text,  with gaps "), (2, None), (3, ""), (None, "no key"), (4, "same"), (4, "same"), (5, "long " * 40_000), (6, "own ▁ mark")]
    out = C.coded(frame(rows), PATH).collect()
    expected = []
    for key, text in rows:
        ids = library.encode(text or "")
        expected.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(text or ""), "▁" not in (text or "")))
    assert sorted(map(tuple, out), key=str) == sorted(expected, key=str)


def test_both_ways_apart(frame):
    docs = frame([(1, "Some text"), (2, None), (3, " ")])
    ids = C.encode_texts(docs, PATH)
    back = {r.doc_id: r.text for r in C.decode_ids(ids, PATH).collect()}
    assert back == {1: "Some text", 2: "", 3: " "}


def test_empty(frame):
    assert C.coded(frame([]), PATH).count() == 0
