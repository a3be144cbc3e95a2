"""Nearest neighbours through low-dimensional stable projections and kd-trees.

Vectors are projected on ``dims`` Gaussian directions.  The Gaussian law is
2-stable: the squared distance of two projections, divided by the squared
distance of the vectors, follows a chi-square law with ``dims`` degrees of
freedom.  The projections of a block of vectors are held in a kd-tree.  A query
takes the tree's leaves in the order of their distance from its own projection
and verifies, by the true distance, the points that could still be wanted;
it stops when the chi-square test says that any point not yet verified, were it
nearer than the worst neighbour in hand, would have shown itself with
probability ``confidence`` already:

    (projected distance to what is left)^2 > quantile(confidence) * (worst distance in hand)^2

Equal vectors of a block are one point with its smallest ids, so any number of copies
is found together and the ties among them go to the smaller ids.

Queries are a stated set.  They and the table are cut into blocks of bounded size
and every block of queries is held against every block of the table, one pair of
blocks per row; a task's memory is bounded by these two sizes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import link_map, require, staged
from pagemill.llm.vectors import matrix, numeric, usable

DIMS = 8
CONFIDENCE = 0.98
NEIGHBOURS = 10
BLOCK_ROWS = 8192
QUERY_ROWS = 512
LEAF_ROWS = 64
LEAVES_AT_ONCE = 8
SEED = 9


def chi_square_quantile(p: float, dims: int) -> float:
    """The value below which a chi-square variable with an even number of degrees falls with probability ``p``."""
    if dims % 2:
        raise ValueError("dims must be even")

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def directions(width: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng((seed, width)).normal(size=(width, dims))


class KdTree:
    """Leaves of at most ``leaf_rows`` points, cut at the median of the widest coordinate."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        leaves, open_nodes = [], [np.arange(len(points))]
        while open_nodes:
            at = open_nodes.pop()
            if len(at) <= leaf_rows:
                leaves.append(at)
                continue
            part = points[at]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            order = np.argsort(part[:, axis], kind="stable")
            half = len(at) // 2
            open_nodes += [at[order[:half]], at[order[half:]]]
        self.points, self.leaves = points, leaves
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])

    def by_distance(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the leaves, nearest first, and the squared distances of their boxes."""
        gap = np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)
        bound = (gap * gap).sum(axis=1)
        order = np.argsort(bound, kind="stable")
        return order, bound[order]


def grouped(vectors: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each different vector, and its ``most`` rows of smallest ids (-1 where there are fewer)."""
    rows = np.ascontiguousarray(vectors + 0.0)  # a negative zero is a zero
    _, of = np.unique(rows.view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, of))
    start = np.flatnonzero(np.diff(of[order], prepend=-1))
    nth = np.arange(len(of)) - start[of[order]]
    members = np.full((len(start), min(most, int(nth.max()) + 1)), -1)
    first = nth < most
    members[of[order][first], nth[first]] = order[first]
    return members[:, 0], members


def search(
    tree: KdTree, vectors: np.ndarray, members: np.ndarray, ids: np.ndarray, rids: np.ndarray, q: np.ndarray, rid: int,
    image: np.ndarray, k: int, quantile: float, slack: float,
) -> list[tuple[float, int, int]]:
    """Up to ``k`` nearest rows but the query's own: (distance, id, row), ties to smaller ids.

    The tree holds different ``vectors``, ``members`` the rows that have them.  Only what is
    farther than the limit is left out, and ``slack`` covers the rounding of two projections.
    """
    order, bounds = tree.by_distance(image)
    best = np.empty((0, 3))
    worst = math.inf
    for first in range(0, len(order), LEAVES_AT_ONCE):
        limit = quantile * worst * worst + slack
        if bounds[first] > limit:
            break
        at = np.concatenate([tree.leaves[i] for i in order[first : first + LEAVES_AT_ONCE]])
        if len(best) == k:
            shown = tree.points[at] - image
            at = at[(shown * shown).sum(axis=1) <= limit]
        away = vectors[at] - q
        distance = np.sqrt((away * away).sum(axis=1))
        if len(best) == k:
            near = distance <= worst
            at, distance = at[near], distance[near]
        rows, distance = members[at].ravel(), np.repeat(distance, members.shape[1])
        other = (rows >= 0) & (rids[rows] != rid)
        rows, distance = rows[other], distance[other]
        if not len(rows):
            continue
        found = np.concatenate([best, np.stack([distance, ids[rows], rows], axis=1)])
        best = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))[:k]]
        worst = best[-1, 0] if len(best) == k else math.inf
    return [(float(d), int(i), int(a)) for d, i, a in best]


def _search_blocks(dims: int, k: int, confidence: float):
    quantile = chi_square_quantile(confidence, dims)

    def run(batch):
        out = {"query_rid": [], "query_id": [], "vec_id": [], "score": []}
        for row in range(batch.num_rows):
            width = batch.column("width")[row].as_py()
            sides = {}
            for side in ("items", "queries"):
                items = batch.column(side).slice(row, 1).flatten()
                sides[side] = [
                    items.field("rid").to_numpy(zero_copy_only=False),
                    items.field("id").to_numpy(zero_copy_only=False),
                    matrix(items.field("v"), width),
                ]
            rids, ids, vectors = sides["items"]
            axes = directions(width, dims)
            rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # ties by id, exact beyond 2^53
            # Copies are one point; of theirs only the smallest ids can win, one more than k as one may be the query.
            one, members = grouped(vectors, rank, k + 1)
            different = vectors[one]
            tree = KdTree(different @ axes)
            longest = np.linalg.norm(different, axis=1).max()
            for rid, qid, q in zip(*sides["queries"]):
                slack = (1e-12 * (longest + np.linalg.norm(q)) * np.linalg.norm(axes)) ** 2
                for distance, _, at in search(
                    tree, different, members, rank, rids, q, rid, q @ axes, k, quantile, slack
                ):
                    out["query_rid"].append(rid)
                    out["query_id"].append(qid)
                    out["vec_id"].append(ids[at])
                    out["score"].append(distance)
        return out

    return run


def nearest_neighbours(
    df: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    dims: int = DIMS,
    confidence: float = CONFIDENCE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``queries`` holds, against all rows.

    ``score`` is the Euclidean distance in double precision, ties go to the smaller id,
    and a query has fewer than ``k`` rows only where there are fewer candidates.  A row
    is no candidate of itself, but a repeated row is.  Rows with an unusable vector
    (null, empty, zero, with null or non-finite components) or a null key take no part;
    only vectors of the same length are compared.  Other columns are not looked at.
    Each true neighbour is found with probability ``confidence`` or more.
    """
    require(df, key, vector)
    rows = df.select(
        F.col(key).cast("bigint").alias("id"), numeric(df, vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")
    )
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull()).withColumn("width", F.size("v"))
    rows = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    sizes = rows.groupBy("width").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"),
        F.ceil(F.count_if("asked") / QUERY_ROWS).alias("asks"),
    )
    item = F.struct("rid", "id", "v")

    def blocks(of: DataFrame, count: str, number: str, into: str) -> DataFrame:
        dealt = of.join(sizes, "width").withColumn(number, F.pmod(F.xxhash64("rid"), F.col(count)))
        return dealt.groupBy("width", number).agg(
            F.collect_list(item).alias(into), F.max("blocks").alias("blocks")
        )

    table = blocks(rows, "blocks", "block", "items").select("width", "block", "items")
    asked = blocks(rows.where("asked"), "asks", "ask", "queries")
    # Every block of queries goes to every block of the table.
    asked = asked.select(
        "width", "queries", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    )
    pairs = table.join(asked, ["width", "block"]).select("width", "items", "queries")
    found = link_map(
        pairs,
        _search_blocks(dims, k, confidence),
        "query_rid bigint, query_id bigint, vec_id bigint, score double",
    )
    nearest = Window.partitionBy("query_rid").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
