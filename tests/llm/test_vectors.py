import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import pivot_lists as L
from pagemill.llm import projections as N

SCHEMA = "vec_id bigint, embedding array<float>, label int"
ODD = [(90_001, None, 0), (90_002, [], 0), (90_003, [0.0] * 16, 0), (90_004, [None] + [1.0] * 15, 0), (90_005, [float("nan")] * 16, 0), (90_006, [float("inf")] + [0.0] * 15, 0)]


@pytest.fixture(scope="module")
def groups():
    """Random vectors, near copies, exact copies, a chain of links, another length."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base[0] + 0.08 * rng.normal(size=(60, 16))
    angle = [base[1] / np.linalg.norm(base[1]), None]
    side = base[2] - (base[2] @ angle[0]) * angle[0]
    side /= np.linalg.norm(side)
    chain = [math.cos(a) * angle[0] + math.sin(a) * side for a in np.arange(0, 1.6, 0.4)]
    rows = [*base, *near, *chain, *([base[5]] * 7)]
    out = [(i + 1, [float(x) for x in np.float32(v)], i % 3) for i, v in enumerate(rows)]
    return [*out, (1, out[0][1], 2), (80_000, [1.0, 2.0], 0), (80_001, [2.0, 4.0], 0)]


def cosines(rows):
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v @ v.T


@pytest.mark.parametrize("list_rows", [512, 5])
def test_links(spark, groups, list_rows):
    """Counts and components, also where lists are cut into parts."""
    df = spark.createDataFrame([*groups, *ODD, (None, groups[0][1], 0)], SCHEMA)
    out = L.similar_vectors(df, nearest=12, list_rows=list_rows).collect()
    assert len(out) == len(groups) + len(ODD) + 1
    long = [r for r in groups if len(r[1]) == 16]
    close = cosines(long) >= 0.9
    links = close.sum(axis=1) - 1
    low = np.array([r[0] for r in long])
    for _ in range(20):
        low = np.array([low[c].min() for c in close])
    expected = sorted((r[0], int(n), int(c), r[0] == int(c)) for r, n, c in zip(long, links, low))
    expected += [(80_000, 1, 80_000, True), (80_001, 1, 80_000, False)]
    expected += [(r[0], 0, r[0], True) for r in ODD]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in out if r.vec_id is not None]
    assert sorted(got) == sorted(expected)
    assert [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, True)]


def test_recall_at_the_threshold(spark):
    """Pairs a little above 0.9 in 64 dimensions, the hardest there are."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(400, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.905 * x + math.sqrt(1 - 0.905**2) * z
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))]
    out = L.similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert out.where("n_links > 0").count() / 800 >= 0.9


def test_no_vectors(spark):
    assert L.similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert L.similar_vectors(spark.createDataFrame(ODD, SCHEMA)).count() == len(ODD)
    assert N.nearest_neighbours(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert N.nearest_neighbours(spark.createDataFrame(ODD, SCHEMA), F.lit(True)).count() == 0


def brute(rows, query, k=10):
    found = []
    for i, r in enumerate(rows):
        if i != query and len(r[1]) == len(rows[query][1]):
            found.append((float(np.sqrt(((np.array(r[1]) - np.array(rows[query][1])) ** 2).sum())), r[0]))
    return sorted(found)[:k]


@pytest.mark.parametrize("block_rows", [8192, 40])
def test_neighbours(spark, groups, block_rows):
    df = spark.createDataFrame([*groups, *ODD, (None, groups[0][1], 0)], SCHEMA)
    asked = F.col("vec_id") % 20 == 0
    out = N.nearest_neighbours(df, asked, block_rows=block_rows).collect()
    queries = [i for i, r in enumerate(groups) if r[0] % 20 == 0]
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {groups[i][0] for i in queries if brute(groups, i)}
    right = total = 0
    for i in queries:
        wanted = brute(groups, i)
        got = sorted(by[groups[i][0]])
        assert [r for r, _, _ in got] == list(range(1, len(wanted) + 1))
        assert sorted((s, v) for _, v, s in got) == [(s, v) for _, v, s in got]
        distances = {v: d for d, v in brute(groups, i, 10**6)}
        assert all(distances[v] == s for _, v, s in got)
        right += len({v for _, v, _ in got} & {v for _, v in wanted})
        total += len(wanted)
    assert right / total >= 0.95


def test_certain_search_is_exact(spark, groups):
    """With a confidence of nearly one the stopping test never stops early."""
    df = spark.createDataFrame(groups, SCHEMA)
    out = N.nearest_neighbours(df, F.col("vec_id") == 40, confidence=1 - 1e-12).orderBy("rank").collect()
    i = next(i for i, r in enumerate(groups) if r[0] == 40)
    assert [(r.score, r.vec_id) for r in out] == brute(groups, i)


def test_fewer_candidates_than_wanted(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 1.0], 0)], SCHEMA)
    out = N.nearest_neighbours(df, F.col("vec_id") == 1).collect()
    assert [(r["rank"], r.vec_id) for r in out] == [(1, 2), (2, 3)]


def test_quantile():
    # Chi-square with two degrees is exponential: the median is 2 ln 2.
    assert N.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2))
    assert N.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    with pytest.raises(ValueError):
        N.chi_square_quantile(0.5, 3)


def test_many_copies_in_a_block(spark):
    """3000 copies of a vector: of equal distances the smallest ids, over all copies of the block."""
    rng = np.random.default_rng(6)
    hot = rng.normal(size=16)
    rows = [*([hot] * 3000), *(hot + 0.01 * rng.normal(size=(5, 16))), *rng.normal(size=(1000, 16))]
    ids = rng.permutation(len(rows)) + 1
    rows = [(int(i), [float(x) for x in np.float32(v)], 0) for i, v in zip(ids, rows)]
    queries = [*range(0, 3000, 500), 3000, 3001, 3002]
    out = N.nearest_neighbours(
        spark.createDataFrame(rows, SCHEMA), F.col("vec_id").isin([rows[i][0] for i in queries])
    ).collect()
    for i in queries:
        got = sorted((r["rank"], r.vec_id) for r in out if r.query_id == rows[i][0])
        assert [v for _, v in got] == [v for _, v in brute(rows, i)]
