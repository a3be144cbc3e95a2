import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pagemill.llm.token_counts import section_token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def slow(tokenizer, text):
    """Sections by character, token by token, from the tokenizer's own offsets."""
    lines = text.split("\n")
    spans, at = [], 0
    for i, line in enumerate(lines):
        end = at + len(line) + (i < len(lines) - 1)
        if end > at or i == 0:
            spans.append((at, end))
        at = end
    own, shared = [0] * len(spans), [0] * len(spans)
    for start, end in tokenizer.encode(text, add_special_tokens=False).offsets:
        inside = [max(0, min(end, b) - max(start, a)) for a, b in spans]
        own[inside.index(max(inside))] += 1
        if sum(x > 0 for x in inside) > 1:
            for i, x in enumerate(inside):
                shared[i] += x > 0
    return [(i, a, b, o, s) for i, ((a, b), o, s) in enumerate(zip(spans, own, shared))]


TEXTS = ["one line", "two\nlines", "ends\n", "\nbegins", "\n", "\n\n\n\n", "a\n\n\n  b\n \n c", "é\nß 日本\n🙂🙂\n", "tabs\t\t\n\t\tmore\n", "x", "word " * 3000 + "\n" + "y\n" * 300]


@pytest.mark.parametrize("text", TEXTS)
def test_sections(frame, tokenizer, text):
    out = section_token_counts(frame([(1, text)]), RANKS, P.PATTERN).orderBy("section").collect()
    assert [tuple(r)[1:] for r in out] == slow(tokenizer, text)
    assert sum(r.n_tokens for r in out) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a\nb", 0), (3, "same", 0), (3, "same", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    out = section_token_counts(docs, RANKS, P.PATTERN).collect()
    assert sorted(map(tuple, out), key=str) == sorted(
        [(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (None, 0, 0, 2, 2, 0), (None, 1, 2, 3, 1, 0), (3, 0, 0, 4, 1, 0), (3, 0, 0, 4, 1, 0)],
        key=str,
    )


def test_empty(frame):
    assert section_token_counts(frame([]), RANKS, P.PATTERN).count() == 0
