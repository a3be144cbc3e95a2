import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm.collocations import FmIndex, collocations, phrases
from pagemill.llm.queries import QUERIES


def pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def slow_collocations(rows, least=30, top=2000, longest=4, absorbed=80):
    """``rows`` are (language, text); counts by dictionaries, every cut and every longer candidate tried."""
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in pieces(text):
            words[lang] += len(piece)
            for m in range(1, longest + 1):
                for i in range(len(piece) - m + 1):
                    counts[lang][tuple(piece[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = [g for g, a in f.items() if len(g) > 1 and a >= least]
        gone = set()
        for g in candidates:
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    if 100 * f[g] >= absorbed * f[g[i : i + m]]:
                        gone.add(g[i : i + m])
        scored = []
        for g in candidates:
            if g not in gone:
                score, _, l, r = min((2_000_000 * f[g] // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -f[g], " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


def test_registered_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text")
    got = QUERIES["op11_collocations"](spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = slow_collocations([tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, got.collect())) == expected
    assert {len(r[2].split(" ")) for r in expected} >= {2, 4}


@pytest.mark.parametrize("longest", [2, 3, 4, 5])
def test_shards_change_nothing(spark, longest):
    rng = random.Random(longest)
    common = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(400):
        words = rng.choices(common, [1 / (j + 1) for j in range(12)], k=rng.randint(0, 25))
        words += rng.choice([["New", "York", "City"], ["at", "the", "end", "of", "it"], [], ["rare" + str(i)]])
        rows.append((rng.choice(["en", "en", "de", None, "und", "x y\n%"]), rng.choice([" ", ", ", "\t", "\n"]).join(words)))
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations(frame, longest=longest, least=4, shard_tokens=500, bucket_keys=300)
    assert sorted(map(tuple, got.collect())) == slow_collocations(rows, least=4, longest=longest)


def test_index_counts_every_phrase():
    rng = np.random.default_rng(5)
    text = np.concatenate([[0], rng.integers(0, 4, 600), np.zeros(4, np.int64)])
    text = np.concatenate([[0], text[1:][(text[1:] > 0) | (text[:-1] > 0)], np.zeros(4, np.int64)])
    index = FmIndex.build(text, 4)
    known = []
    for length in (2, 3, 4):
        columns, sizes = phrases(index, known, np.arange(4), 1)
        found = {tuple(map(int, g)): int(n) for *g, n in zip(*columns, sizes)}
        expected = Counter(g for i in range(len(text)) if len(g := tuple(map(int, text[i : i + length]))) == length and all(g))
        assert found == dict(expected)
        known.append(sizes)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from pagemill.llm.collocations import _scored

    a, l, r = 9_000_000_000_000_000_001, 9_100_000_000_000_000_000, 9_200_000_000_000_000_000
    level = spark.createDataFrame([("en", "x y", a, [l], [r])], "lang string, phrase string, f long, heads array<long>, tails array<long>")
    assert _scored(level, 2).select(F.col("score")).first()[0] == 2_000_000 * a // (l + r)


def test_awkward_rows(spark):
    schema = "text string, lang string, shard int, f int, rank int"
    assert collocations(spark.createDataFrame([], schema)).collect() == []
    texts = [(None, None), ("", "en"), ("a b " * 40, None), ("a b. " * 40, "und"), ("a b " * 40, ""), ("x y z " * 60_000, "en"), ("...!?\n", "fr")]
    texts += [("À la carte, À la mode", "fr")] * 30
    frame = spark.createDataFrame([(t, g, 1, 2, 3) for t, g in texts], schema)
    assert sorted(map(tuple, collocations(frame).collect())) == slow_collocations([(g, t) for t, g in texts])
