import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm.katz import Discounts, katz_scores
from pagemill.llm.queries import QUERIES

LOSS = 0.01


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "\n"]


class SlowKatz:
    """The model by dictionaries and recursion, one token at a time."""

    def __init__(self, texts, order=3, least=(1, 1, 2)):
        self.order = order
        self.least = [0, *[least[min(m, len(least)) - 1] for m in range(1, order + 1)]]
        self.grams = [None] + [Counter() for _ in range(order)]
        self.context = [None] + [Counter() for _ in range(order)]
        for text in texts:
            sequence = ["", *tokens(text)]
            for i in range(1, len(sequence)):
                for m in range(1, min(order, i + 1) + 1):
                    gram = tuple(sequence[i - m + 1 : i + 1])
                    self.grams[m][gram] += 1
                    self.context[m][gram[:-1]] += 1
        self.kept = [None]
        for m in range(1, order + 1):
            seen = np.bincount([min(c, 7) for c in self.grams[m].values()], minlength=8)[1:7]
            self.kept.append(Discounts.fit(seen, self.least[m]))
        self.n = sum(self.grams[1].values())
        mass = sum(self.star(1, c) for c in self.grams[1].values())
        self.scale = min(1.0, self.n / (self.n + 1) / (mass / self.n)) if self.n else 0.0
        self.unknown = 1 - self.scale * mass / self.n if self.n else 1.0
        self.followers = [None] + [{} for _ in range(order)]
        for m in range(2, order + 1):
            for gram, c in self.grams[m].items():
                if c >= self.least[m]:
                    self.followers[m].setdefault(gram[:-1], []).append(gram)

    def star(self, m, count):
        return self.kept[m].kept[count] if count < len(self.kept[m].kept) else count - LOSS

    def p(self, history, word):
        m = len(history) + 1
        if m == 1:
            c = self.grams[1][(word,)]
            return self.scale * self.star(1, c) / self.n if c else self.unknown
        total = self.context[m][history]
        c = self.grams[m][(*history, word)]
        if c >= self.least[m]:
            return self.star(m, c) / total
        known = self.followers[m].get(history, [])
        left = 1 - sum(self.star(m, self.grams[m][g]) for g in known) / total if total else 1.0
        lower = 1 - sum(self.p(history[1:], g[-1]) for g in known)
        return left / lower * self.p(history[1:], word)

    def score(self, text):
        sequence = ["", *tokens(text)]
        total = 0.0
        for i in range(1, len(sequence)):
            total += math.log10(self.p(tuple(sequence[max(0, i - self.order + 1) : i]), sequence[i]))
        return total

    def base(self, text):
        return sum(math.log10((self.grams[1][(t,)] + 1) / (self.n + len(self.grams[1]) + 1)) for t in tokens(text))


def check(got, rows, learned, order=3, least=(1, 1, 2)):
    """Rows of the operator against the slow model; ``learned`` says which rows teach."""
    model = SlowKatz([t for (_, t), yes in zip(rows, learned) if yes], order, least)
    expected = []
    for (key, text), yes in zip(rows, learned):
        words = tokens(text)
        known = sum(model.grams[1][(w,)] > 0 for w in words)
        expected.append((key, not yes, len(words), known, model.n, model.base(text), model.score(text)))
    order_of = lambda r: (r[0] is None, r[0], r[2], r[6])
    got, expected = sorted(map(tuple, got), key=order_of), sorted(expected, key=order_of)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-9, abs=1e-9) for r in expected]
    return model


def test_registered_query_equals_recursion(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    learned = [zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows]
    got = QUERIES["op12_katz"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    check(got, rows, learned)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order, least", [(1, (1,)), (2, (1, 1)), (3, (1, 2, 3)), (4, (1, 1, 1))])
def test_shards_and_spread_contexts_change_nothing(spark, order, least):
    rng = random.Random(order)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = katz_scores(frame, F.col("doc_id") % 5 != 0, order=order, least=least, shard_tokens=900, bucket_keys=64)
    check(got.collect(), rows, [k % 5 != 0 for k, _ in rows], order, least)


@pytest.mark.parametrize("text", ["a b c a b a a c d", "x " * 40 + "y", "only"])
def test_probabilities_of_all_words_sum_to_one(text):
    model = SlowKatz([text, "a b c d e", "a b a c", text], 3, (1, 1, 2))
    words = [w for (w,) in model.grams[1]]
    for history in [(), ("a",), ("x",), ("a", "b"), ("x", "x"), ("", "a"), ("", "unseen"), ("unseen",)]:
        assert sum(model.p(history, w) for w in [*words, "never seen"]) == pytest.approx(1.0)


def test_awkward_rows(spark):
    schema = "doc_id long, text string, key string, shard int, learned int"
    empty = spark.createDataFrame([], schema)
    assert katz_scores(empty, F.lit(True)).collect() == []
    texts = [(1, None), (None, ""), (2, "A B\x0bc\x1cÀ " * 3), (2, "a b"), (None, "long text " * 30_000), (3, "a b"), (3, "a b")]
    frame = spark.createDataFrame([(*t, "k", 7, 9) for t in texts], schema)
    check(katz_scores(frame, F.lit(True)).collect(), texts, [True] * len(texts))
    # Nothing to learn from: every token is unknown.
    got = katz_scores(frame, F.lit(None).cast("boolean")).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.score == 0 and r.base_score == 0 for r in got)


def test_questions_hold_each_context_once():
    """Also one that is spread over buckets, in each of those; of the sequences only the last words are sent."""
    from pagemill.llm import shards as X
    from pagemill.llm.katz import Grams

    rng = np.random.default_rng(1)
    ids = np.concatenate([[0], rng.integers(2, 30, 3000), [1]])
    shard = {"ids": X.pack(ids), "lengths": X.pack(np.array([len(ids)])), "learned": X.pack(np.array([1]))}
    grams = Grams(shard, 1, (np.arange(1, 30), np.bincount(ids, minlength=30)[1:]))
    grams.extend()
    for buckets, bucket_keys in ((7, 1 << 20), (7, 40), (2, 10)):
        dealt = grams.deal(2, 1, buckets, bucket_keys)
        pairs = list(zip(dealt.bucket.tolist(), dealt.at.tolist()))
        assert pairs == sorted(set(pairs)) and set(dealt.at.tolist()) == set(range(len(dealt.contexts)))
        spread = np.minimum(np.maximum(-(-grams.counts[1][dealt.contexts] // bucket_keys), 1), buckets)
        assert np.bincount(dealt.at).tolist() == spread.tolist()
        assert sorted(dealt.asked.tolist()) == list(range(len(grams.n[2])))
        assert (grams.prefix[2][dealt.asked] == dealt.contexts[np.repeat(dealt.at, dealt.size)]).all()


def test_keys_are_numbered_alike_in_one_column_and_several():
    from pagemill.llm import shards as X

    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 9, 500), rng.integers(0, 5, 500)]
    for wide in (1, 1 << 40):  # too wide for one column
        mine = [columns[0] * wide, columns[1] * wide]
        places, number = X.numbered(mine)
        keys = list(zip(*[c.tolist() for c in mine]))
        assert [keys[i] for i in places] == sorted(set(keys))
        assert [keys[places[i]] for i in number] == keys


def test_discounts_lie_between_zero_and_one():
    for seen in ([100, 40, 20, 12, 8, 6], [10, 0, 0, 0, 0, 0], [0, 5, 0, 1, 0, 0], [0] * 6, [5, 50, 3, 90, 1, 4]):
        kept = Discounts.fit(np.array(seen), 1).kept
        assert all(0 < k < r for r, k in enumerate(kept) if r)
