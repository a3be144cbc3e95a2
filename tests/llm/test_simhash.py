import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import simhash as S
from pagemill.llm.common import staged
from pagemill.llm.components import connected_components


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, max_bits=4):
    """Component of every distinct value as a frozenset, by brute force."""
    left, found = set(values), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= max_bits}
            left -= near
            todo += near
        found.append(group)
    return found


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One TWO", "a b c d", "Ünï Çode ÄÖ x y z", "a b c\x1cd e", "w " * 500])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


def test_counting_in_parts(monkeypatch, prose):
    text = prose(1, 300)
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "HASHES_AT_ONCE", 7)
    assert S.fingerprint(text) == whole == slow_fingerprint(text)


@pytest.mark.parametrize("bucket_rows", [2000, 25])
def test_links_lose_nothing(spark, bucket_rows):
    """Also where buckets are dealt again several times."""
    rng = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        center = rng.getrandbits(64)
        values.add(center)
        for _ in range(40):
            values.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    table = staged(spark.createDataFrame(signed, "fp bigint"), "values")
    links = S.fingerprint_links(table, bucket_rows=bucket_rows).collect()
    mask = (1 << 64) - 1
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = a & mask, b & mask
        assert (a ^ b).bit_count() <= 4
        parent[root(a)] = root(b)
    found = {}
    for v in values:
        found.setdefault(root(v), set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, components(values)))


def test_pivots_discard_only_far_pairs():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
    p = S.pivots()
    dx, dy = (np.bitwise_count(v[:, None] ^ p[None, :]).astype(int) for v in (x, y))
    assert np.abs(dx - dy).max() <= 4


def test_whole_operator(frame, prose):
    base = prose(3, 400)
    words = base.split()
    near = " ".join([*words[:200], "changed", *words[201:]])
    rows = [(1, base), (2, near), (3, base), (3, base), (4, prose(4, 300)), (5, None), (6, ""), (None, ""), (None, base), (7, "x " * 50_000)]
    out = S.simhash_components(frame(rows)).collect()
    assert len(out) == len(rows)
    expected = {}
    prints = [slow_fingerprint(t) for _, t in rows]
    for group in components(prints):
        ids = [k for (k, _), f in zip(rows, prints) if f in group and k is not None]
        for f in group:
            expected[f"{f:016x}"] = min(ids, default=None)
    assert sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in out) == sorted(
        (k is None, k, f"{f:016x}", expected[f"{f:016x}"]) for (k, _), f in zip(rows, prints)
    )
    assert expected["0" * 16] == 5


def test_only_null_keys(frame):
    out = S.simhash_components(frame([(None, "a b c d e"), (None, "a b c d e")])).collect()
    assert [r.component_id for r in out] == [None, None]


def test_one_row_of_each_group_stays(frame, prose):
    base = prose(3, 400)
    rows = [(9, base, 0), (3, base, 1), (3, base, 2), (None, base, 3), (4, prose(4, 300), 4), (None, prose(6, 300), 5), (None, prose(6, 300), 6), (8, None, 7), (7, "", 8)]
    docs = frame(rows, "doc_id bigint, text string, fp int")
    out = S.one_per_group(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [3, 4, 7]
    assert len([r for r in kept if r.doc_id is None]) == 1


def test_empty(frame):
    assert S.simhash_components(frame([])).count() == 0
    assert S.one_per_group(frame([])).count() == 0


def test_missing_column(frame):
    with pytest.raises(ValueError, match="txt"):
        S.simhash_components(frame([]), text="txt")


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    chain = [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)]
    rng.shuffle(chain)
    edges += [(b, a) for a, b in chain] + [(None, 1), (7, None)]
    found = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    low = {x: x for e in edges for x in e if x is not None}
    for _ in range(len(low)):
        for a, b in edges:
            if a is not None and b is not None:
                low[a] = low[b] = min(low[a], low[b])
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    assert found == {x: low[x] for x in linked}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("some four word shingle")).alias("h")).first()
    assert row.h & ((1 << 64) - 1) == xxhash.xxh64_intdigest(b"some four word shingle", 42)
