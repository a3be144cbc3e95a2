import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm.packing import Limits, Packer, pack
from pagemill.llm.word_bpe import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", "The", "thing", "ÉCOLE", "straße", "don't", "'sound", "it's", "12", "3.5", "²", "½", "!!", "…", "—", "a_b", "日本", "🙂", "\x1c", "\x85", "\u00a0", "e\u0301", "İ", "Σ", "ΑΣ", "<|endoftext|>", "ª", "µ", "\u00ad", "ﬁ", "_", "x", "$%&"]


def test_ids_equal_the_tokenizers():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    plain = Tokenizer.from_file(PATH)
    encoder = WordBpe(PATH, words=50)  # forgets often
    for text, ids in zip(texts, encoder.encode_all(texts)):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_remembered_once_and_within_limits():
    encoder, plain = WordBpe(PATH), Tokenizer.from_file(PATH)
    texts = ["The end\x0bTHE\n end", "", " the end ", "the 日本 end", "日本", "tHe\x1cend", "<|endoftext|> THE"]
    wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in encoder.encode_all(texts)] == wanted
    # Words that differ in case only are one, across all texts of a batch; gaps at the edges are an empty word.
    assert sorted(w for w in encoder.index if w.isascii()) == ["", "\n<|endoftext|>", "end", "the"]
    small = WordBpe(PATH, words=30, units=20)
    for i in range(200):
        word = "".join(chr(97 + (i * k) % 26) for k in range(3, 9))
        assert small.encode_all([f"{word}, so"])[0].tolist() == plain.encode(f"{word}, so", add_special_tokens=False).ids
        assert len(small.index) <= 30 and len(small.units) <= 20 + 3


@pytest.mark.parametrize(
    "limits", [Limits(), Limits(64, 4, 64), Limits(64, 100, 20), Limits(50, 1, 50), Limits(7, 3, 1), Limits(1, 1, 1)]
)
def test_sequences_keep_the_limits(limits):
    rng = random.Random(7)
    packer = Packer(limits)
    examples, sequences = {}, []
    for n in range(300):
        size = rng.choice([1, 2, 3, rng.randint(1, 40), rng.randint(1, 300)])
        examples[n] = np.arange(size, dtype=np.uint32) + 1000 * n
        sequences += packer.add(n, examples[n], rng.randint(0, size))
        sequences += packer.ready()
    sequences += packer.rest()
    found = {n: [] for n in examples}
    for sequence in sequences:
        assert 0 < sum(len(p.ids) for p in sequence) <= limits.tokens
        assert len(sequence) <= limits.segments
        assert sum(p.loss(len(p.ids)) for p in sequence) <= limits.loss_tokens
        for p in sequence:
            found[p.example].append((p.start, p.ids))
    for n, ids in examples.items():
        assert np.concatenate([x for _, x in sorted(found[n], key=lambda f: f[0])]).tolist() == ids.tolist()


def test_no_padding_where_tokens_alone_bind():
    rng = random.Random(7)
    packer, lengths = Packer(Limits(64, 64, 64)), []
    for n in range(400):
        lengths += [sum(len(p.ids) for p in s) for s in packer.add(n, np.zeros(rng.randint(1, 200), np.uint32))]
    lengths += [sum(len(p.ids) for p in s) for s in packer.rest()]
    assert all(x == 64 or x & (x - 1) == 0 for x in lengths)
    assert sum(x < 64 for x in lengths) <= 6


def test_whole_operator(spark, prose):
    rows = [(i, prose(i, 30 * i % 900), "x") for i in range(1, 60)]
    rows += [(100, None, "x"), (101, "", "x"), (None, "no key", "x"), (7, "again", "x"), (7, "again", "x"), (102, "long " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id string").repartition(3)
    out = [r.asDict() for r in pack(docs, PATH).collect()]
    assert set(out[0]) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"}
    plain = Tokenizer.from_file(PATH)
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    sequences, pieces = {}, {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        if r["doc_id"] == 7:  # three examples under one key
            continue
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r["loss_tokens"] == r["length"]
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0
    wanted = {}
    for key, text, _ in rows:
        wanted[key] = wanted.get(key, 0) + len(plain.encode(text or "", add_special_tokens=False).ids) + 1
    assert {key: sum(n for _, n in parts) for key, parts in pieces.items()} == wanted


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "a question", "an answer"), (2, None, None)], "id int, prompt string, response string")
    # The last sequence may be cut, so an example may come in pieces.
    out = pack(docs, PATH, key="id", response="response", prompt="prompt").collect()
    loss, total = ({i: sum(r[c] for r in out if r.id == i) for i in (1, 2)} for c in ("loss_tokens", "length"))
    plain = Tokenizer.from_file(PATH)
    answer = len(plain.encode("an answer", add_special_tokens=False).ids)
    assert loss == {1: answer + 1, 2: 1}
    assert total == {1: answer + 1 + len(plain.encode("a question", add_special_tokens=False).ids), 2: 1}


def test_empty(frame):
    assert pack(frame([]), PATH).count() == 0


def test_limits_must_be_positive():
    with pytest.raises(ValueError):
        Limits(0)
