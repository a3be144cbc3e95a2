"""Near-duplicate documents by SimHash fingerprints, bit blocks and pivot distance tables.

A fingerprint has a bit for the majority of the hashes of a document's word
shingles.  Fingerprints within ``max_bits`` differing bits are linked, and
links form components.

Search.  Equal fingerprints are one row from the start, so groups of exact
copies, however large, cost one row.  Candidates are found by bit blocks, since a
table of distances to pivots alone would have to be compared pair by pair:

* *bit blocks*: the bits are cut into ``max_bits + 2`` groups.  A pair with
  ``max_bits`` or fewer different bits agrees in at least two groups, so it meets
  in the bucket of these two.  Nothing is lost, and no pair outside a bucket is
  looked at.
* *pivots*: ``PIVOTS`` fixed pseudo-random fingerprints.  Within a bucket all
  distances to them are computed once; by the triangle inequality a pair within
  ``max_bits`` differs by no more than that in any of them, and other pairs are
  discarded.  Survivors are verified bit by bit.

A bucket with more than ``bucket_rows`` fingerprints is not compared as it is:
its rows are dealt again by two groups among the bits the bucket has not fixed
yet, which loses no pair for the same reason, until buckets are small.  As the
fingerprints are distinct this ends.  A bucket gives a spanning forest of its
links instead of all its pairs, since components are what is asked for.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import link_map, require, staged, text_or_empty
from pagemill.llm.components import connected_components

SEED = 42
WORDS = 4
MAX_BITS = 4
# Discarding references per table.
PIVOTS = 16
# Fingerprints compared within one bucket; larger buckets are dealt again.
BUCKET_ROWS = 2000
# Hashes whose bits are counted at once.
HASHES_AT_ONCE = 65_536

_ALL = (1 << 64) - 1


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash over word shingles, as an unsigned 64-bit number; 0 for a text without words."""
    # bytes.lower() changes A-Z only; bytes.split() takes space and 0x09-0x0D as gaps.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, len(parts))
    pairs = list(zip(starts[: len(parts) - span + 1].tolist(), ends[span - 1 :].tolist()))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for first in range(0, len(pairs), HASHES_AT_ONCE):
        hashes = [digest(joined[a:b], SEED) for a, b in pairs[first : first + HASHES_AT_ONCE]]
        octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(pairs), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, out: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``out``: the fingerprint as a signed bigint.  A null text counts as empty."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("bigint")
    def of(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.select(*keep, of(text_or_empty(text)).alias(out))


def pivots(count: int = PIVOTS) -> np.ndarray:
    """The discarding references: hashes of the numbers from 0 on."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(count)], np.uint64)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _finer(mask: int, groups: int) -> list[int]:
    """``mask`` with two more of the ``groups`` groups of its open bits, in every choice of two."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // groups for i in range(groups + 1)]
    parts = [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]
    return sorted({mask | x | y for x, y in combinations(parts, 2)})


def _forest(values: np.ndarray, table: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among one bucket's fingerprints."""
    n = len(values)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i in range(n - 1):
        near = np.flatnonzero(np.abs(table[i + 1 :] - table[i]).max(axis=1) <= max_bits) + i + 1
        if len(near):
            near = near[np.bitwise_count(values[near] ^ values[i]) <= max_bits]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((i, j))
    return found


def fingerprint_links(
    distinct: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS, pivot_count: int = PIVOTS
) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``), enough to connect all within ``max_bits``.

    ``distinct`` should be a written table: it is read once a round.  One round
    unless some bucket exceeds ``bucket_rows``.
    """
    spark = distinct.sparkSession
    references = pivots(pivot_count)

    def compare(batch):
        lists = batch.column("fps")
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        table = np.bitwise_count(flat[:, None] ^ references[None, :]).astype(np.int8)
        a, b = [], []
        for start, end in zip(bounds.tolist(), bounds[1:].tolist()):
            for i, j in _forest(flat[start:end], table[start:end], max_bits):
                a.append(start + i)
                b.append(start + j)
        signed = flat.view(np.int64)
        return {"a": signed[np.array(a, np.int64)], "b": signed[np.array(b, np.int64)]}

    rows = distinct.select("fp", F.lit(0).cast("bigint").alias("mask"))
    masks, links = {0}, None
    while masks:
        finer = {m: _finer(m, max_bits + 2) for m in masks}
        rows = _redeal(spark, rows, finer)
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"))
        sizes = staged(sizes.where("n > 1"), "buckets")
        large = sizes.where(F.col("n") > bucket_rows)
        small = sizes.where(F.col("n") <= bucket_rows).select("mask", "key")
        buckets = keyed.join(small, ["mask", "key"], "left_semi").groupBy("mask", "key").agg(
            F.collect_list("fp").alias("fps")
        )
        found = staged(link_map(buckets.select("fps"), compare, "a bigint, b bigint"), "fplinks")
        links = found if links is None else links.unionByName(found)
        masks = {r["mask"] & _ALL for r in large.select("mask").distinct().collect()}  # a few bit patterns
        if masks:
            rows = staged(keyed.join(large.select("mask", "key"), ["mask", "key"], "left_semi").select("fp", "mask"), "crowded")
    return links


def _redeal(spark: SparkSession, rows: DataFrame, finer: dict[int, list[int]]) -> DataFrame:
    """Each row once for every finer mask of its mask; the masks depend on the bits alone, not on data."""
    if len(finer) == 1:
        (choices,) = finer.values()
        return rows.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("bigint") for m in choices])).alias("mask"))
    table = spark.createDataFrame(
        [(_signed(m), _signed(c)) for m, cs in finer.items() for c in cs], "mask bigint, finer bigint"
    )
    return rows.join(F.broadcast(table), "mask").select("fp", F.col("finer").alias("mask"))


def near_duplicate_classes(
    fingerprints: DataFrame, key: str = "doc_id", max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``fp, first, group, component_id`` for every distinct ``fp`` of a written table ``(key, fp)``.

    ``first`` is the smallest key with this fingerprint, ``group`` the smallest fingerprint
    of the component (a signed number), and
    ``component_id`` the smallest key among the documents reachable by links; null keys are
    linked like others but never name a component, so it is null where no member has a key.  Repeated keys and rows make no difference.
    """
    distinct = staged(
        fingerprints.groupBy("fp").agg(F.min(key).alias("first")), "fingerprints"
    )
    roots = connected_components(fingerprint_links(distinct, max_bits, bucket_rows))
    roots = roots.select(F.col("id").alias("fp"), "root")
    linked = staged(distinct.join(roots, "fp"), "linked")
    names = staged(linked.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    named = staged(linked.join(names, "root").select("fp", "root", "component_id"), "named")
    per = distinct.join(named, "fp", "left").select(
        "fp",
        "first",
        F.coalesce("root", "fp").alias("group"),
        F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("first")).alias("component_id"),
    )
    return staged(per, "classes")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``key, fingerprint, component_id`` for every row of ``docs``.

    Null and empty texts have the fingerprint zero and link like any other.  Null
    keys: see ``near_duplicate_classes``.  Rows that repeat come out as often as they
    went in.  Other columns are not looked at.  An empty table gives an empty result.
    """
    require(docs, key, text)
    prints = staged(with_fingerprints(docs, text, "fp", [F.col(key).alias("key")]), "prints")
    classes = near_duplicate_classes(prints, "key", max_bits)
    return prints.join(classes, "fp").select(
        F.col("key").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row left of each group of near-duplicates, all columns kept.

    The row that stays is the one with the smallest key (nulls last, ties by the
    rows' contents), whatever else repeats: exact copies, keys, whole rows.
    """
    require(docs, key, text)
    marked = staged(with_fingerprints(docs, text, "__fp", [F.col(c) for c in docs.columns]), "marked")
    prints = marked.select(F.col(key).alias("key"), F.col("__fp").alias("fp"))
    classes = near_duplicate_classes(prints, "key", max_bits)
    leader = F.struct(F.col("first").isNull(), F.col("first"), F.col("fp"))
    chosen = staged(classes.groupBy("group").agg(F.min_by("fp", leader).alias("__fp")).select("__fp"), "chosen")
    order = F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(*docs.columns))
    best = marked.join(chosen, "__fp", "left_semi").groupBy("__fp").agg(
        F.min_by(F.struct(*docs.columns), order).alias("__row")
    )
    return best.select("__row.*")
