import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm.queries import QUERIES
from pagemill.llm.spelling import near_pairs, spelling_variants, word_counts


def slow_counts(rows, typo_every=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def slow_near(words):
    """Words of one class under leaving out or masking one letter, told apart by trying every edit."""
    masks = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masks[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    known = set(words)
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in known:
                near[w].add(shorter)
                near[shorter].add(w)
    return near


def slow_variants(rows):
    counts = slow_counts(rows)
    near = slow_near(counts)
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 5 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None)
    return sorted(out.values())


def test_registered_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = slow_variants(docs.select("doc_id", "text").collect())
    got = QUERIES["op13_spelling"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == expected
    assert any(r[1] for r in expected)


def test_counts_lose_letters_alike(spark):
    rows = [(i, "Überfluß Überfluß straßen-bahn ABCDEFG") for i in range(400)] + [(None, "abcdefg")] * 6
    got = word_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.word: r.n for r in got.collect()} == slow_counts(rows)


@pytest.mark.parametrize(
    "words",
    [
        ["aabbcc", "aabcc", "abbcc", "aabbccc", "aabbc", "xaabbcc", "aaabbcc"],
        ["banana", "bananas", "banane", "anana", "bandana", "b", "a", ""],
        ["é" * 6, "é" * 7, "é" * 5 + "a", "a" + "é" * 5],
        ["wx" * 1500, "wx" * 15, "wx" * 12 + "yx" + "wx" * 2, "wx" * 15 + "w", "short"],
    ],
)
def test_pairs_equal_all_edits(spark, words):
    words = [w for w in words if w]
    got = near_pairs(spark.createDataFrame([(w,) for w in words], "word string"))
    near = slow_near(words)
    assert sorted(map(tuple, got.collect())) == sorted((w, x) for w in words for x in near[w])


def test_forms_are_followed_to_the_last(spark):
    # 5 -> 25 -> 125; equal frequencies go to the first in code points; less than five times gives no form.
    rows = [(0, "kitten " * 125 + "mitten " * 24 + "kittena " * 25 + "kittenas " * 5 + "zzzzzz " * 30 + "zzzzza zzzzzb " * 6)]
    got = {r.word: tuple(r)[1:] for r in spelling_variants(
        spark.createDataFrame(rows, "doc_id long, text string"), typo_every=1 << 40).collect()}
    assert got["kittenas"] == ("kittena", "kitten", 5, 1, 25)
    assert got["mitten"] == ("kitten", "kitten", 24, 1, 125)
    assert got["kitten"][:2] == (None, "kitten") and got["kitten"][3] == 2
    assert got["zzzzzb"] == ("zzzzzz", "zzzzzz", 6, 2, 30)


def test_awkward_rows(spark):
    schema = "doc_id long, text string, word string, n int, near string"
    assert spelling_variants(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, "w", 1, "x"), (None, "", "w", 1, "x"), (2, "long" * 50_000 + " plainword" * 5, "w", 1, "x")]
    rows += [(2, "plainwort " * 30, "w", 1, "x")] * 3
    got = {r.word: r for r in spelling_variants(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == set(slow_counts([r[:2] for r in rows]))
    assert got["plainword"].form == "plainwort"
