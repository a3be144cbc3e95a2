"""Which pages to look at: expansion, new links, convergence, gaps.

Everything here is decided by aggregates (first page a link was seen on, first
page without a new link), which combine before the shuffle, so a field that
holds most of the links is no problem.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import url_template
from pagemill.operators.scan import ROWS_PER_BLOCK, running_total


def frontier(seeds: DataFrame, field: str, max_page: int, template: str) -> DataFrame:
    """One address per field and page number.  A generator, not a join."""
    pages = seeds.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(max_page))))
    return pages.withColumn("url", url_template(template, field=F.col(field), page=F.col("page_no")))


def unseen(links: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct links that were not seen before."""
    return links.select(*keys).distinct().join(seen.select(*keys).distinct(), list(keys), "left_anti")


# A sketch has so many bits whatever it is made of, 512 KB, and each key sets so many of them.
SKETCH_BITS = 1 << 22
SKETCH_HASHES = 4


def _bits(keys: Sequence[str], bits: int, hashes: int) -> list[Column]:
    """Positions a key sets, from hashes that differ in a number put before it."""
    return [F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(bits)) for i in range(hashes)]


def seen_sketch(seen: DataFrame, keys: Sequence[str], bits: int = SKETCH_BITS, hashes: int = SKETCH_HASHES) -> DataFrame:
    """One row ``sketch``: an array of ``bits`` bits in words of 64, set where a seen key hashes to.

    Words are combined before the shuffle; no more than ``bits / 64`` of them meet in the last task.
    """
    at = seen.select(F.explode(F.array(*_bits(keys, bits, hashes))).alias("at"))
    words = at.select(
        F.shiftright("at", 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int")).alias("word")
    )
    empty = seen.sparkSession.range(bits // 64).select("id", F.lit(0).cast("bigint").alias("word"))
    whole = words.unionByName(empty).groupBy("id").agg(F.bit_or("word").alias("word"))
    ordered = F.array_sort(F.collect_list(F.struct("id", "word")))
    return whole.agg(F.transform(ordered, lambda w: w["word"]).alias("sketch"))


def maybe_seen(
    links: DataFrame, seen: DataFrame, keys: Sequence[str], out: str, bits: int = SKETCH_BITS, hashes: int = SKETCH_HASHES
) -> DataFrame:
    """Add ``out``: false for links that surely were not seen, true for the seen ones and a few others."""
    sketch = seen_sketch(seen, keys, bits, hashes).scalar()
    tests = [F.getbit(F.get(sketch, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1 for at in _bits(keys, bits, hashes)]
    found = tests[0]
    for test in tests[1:]:
        found &= test
    return links.withColumn(out, found)


def unseen_by_sketch(
    links: DataFrame, seen: DataFrame, keys: Sequence[str], bits: int = SKETCH_BITS, hashes: int = SKETCH_HASHES
) -> DataFrame:
    """``unseen`` where most links are new: the exact join only gets what a sketch of the seen ones lets through.

    The same rows as ``unseen`` whatever the size of the sketch; a full one merely lets everything through.  A key with a
    NULL never counts as seen, as in the join.
    """
    marked = maybe_seen(links.select(*keys).distinct(), seen, keys, "__maybe", bits, hashes)
    doubtful = marked.where("__maybe").drop("__maybe")
    exact = doubtful.join(seen.select(*keys).distinct(), list(keys), "left_anti")
    return marked.where(~F.col("__maybe")).drop("__maybe").unionByName(exact)


def distinct_links(links: DataFrame, keys: Sequence[str], link: str) -> DataFrame:
    """Number of different links per group: distinct pairs first, then a plain count."""
    return (
        links.where(F.col(link).isNotNull())
        .select(*keys, link)
        .distinct()
        .groupBy(*keys)
        .agg(F.count("*").alias("n_links"))
    )


def first_seen(links: DataFrame, keys: Sequence[str], link: str, page: str) -> DataFrame:
    """The page on which each link first turned up."""
    return links.groupBy(*keys, link).agg(F.min(page).alias(page))


def cumulative_distinct(
    links: DataFrame, keys: Sequence[str], link: str, page: str, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Per group and page: links new on it and links known so far."""
    new = first_seen(links, keys, link, page).groupBy(*keys, page).agg(F.count("*").alias("n_new"))
    visited = links.select(*keys, page).distinct()
    per_page = visited.join(new, [*keys, page], "left").fillna(0, ["n_new"])
    return running_total(per_page, keys, [page], F.col("n_new"), "n_known", rows_per_block=rows_per_block)


def converge_pages(links: DataFrame, visited: DataFrame, keys: Sequence[str], link: str, page: str) -> DataFrame:
    """Pages up to and including the first one that adds no new link.

    ``visited`` lists all ``keys, page`` pairs, also those without any link.
    """
    new = first_seen(links, keys, link, page).where(F.col(link).isNotNull()).select(*keys, page).distinct()
    pages = visited.select(*keys, page).distinct()
    last = (
        pages.join(new, [*keys, page], "left_anti").groupBy(*keys).agg(F.min(page).alias("__last"))
    )
    kept = pages.join(last, list(keys), "left")
    return kept.where(F.col("__last").isNull() | (F.col(page) <= F.col("__last"))).drop("__last")


def until_first_gap(rows: DataFrame, key: str, start: int) -> DataFrame:
    """Rows with ids ``start, start+1, …`` before the first missing one."""
    # The first missing id is `start` or follows one that is present.
    present = F.struct(F.col(key).cast("bigint").alias("id"), F.lit(True).alias("present"))
    follower = F.struct((F.col(key) + 1).cast("bigint").alias("id"), F.lit(False).alias("present"))
    marks = rows.where(F.col(key) >= start).select(F.inline(F.array(present, follower)))
    first = rows.sparkSession.range(start, start + 1).select("id", F.lit(False).alias("present"))
    missing = marks.unionByName(first).groupBy("id").agg(F.bool_or("present").alias("present")).where(~F.col("present"))
    gap = missing.agg(F.min("id"))
    return rows.where((F.col(key) >= start) & (F.col(key) < gap.scalar()))
