"""Cutting ordered rows into documents and reading fields off them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.scan import ROWS_PER_BLOCK, cut_into_blocks, neighbours, running_total


def segment(
    rows: DataFrame,
    is_end: Column,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "doc_no",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Number the documents: a row with ``is_end`` closes its document, the rest is the last one."""
    flag = F.when(is_end, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return running_total(rows, keys, order, flag, out, before=True, rows_per_block=rows_per_block)


def take_while(rows: DataFrame, stop: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of each group before its first ``stop`` row: an aggregate finds it, a join compares."""
    stops = rows.where(stop).groupBy(F.struct(*keys).alias("__of")).agg(F.min(F.struct(*order)).alias("__stop"))
    joined = rows.join(stops, F.struct(*keys) == F.col("__of"), "left")
    return joined.where(F.col("__stop").isNull() | (F.struct(*order) < F.col("__stop"))).select(*rows.columns)


def last_in_segment(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Last non-NULL value of each expression per document; combines before the shuffle."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(
        *[F.max_by(value, F.when(value.isNotNull(), at)).alias(name) for name, value in values.items()]
    )


def next_sibling(
    rows: DataFrame, col: str, keys: Sequence[str], order: Sequence[str], out: str, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    return neighbours(rows, keys, order, {out: (col, 1)}, rows_per_block=rows_per_block)


def previous_siblings(
    rows: DataFrame, col: str, keys: Sequence[str], order: Sequence[str], names: Sequence[str],
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """The values 1, 2, … rows back, nearest first."""
    wanted = {name: (col, -k) for k, name in enumerate(names, start=1)}
    return neighbours(rows, keys, order, wanted, rows_per_block=rows_per_block)


def ordered_concat(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    sep: str = " ",
    out: str = "text",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Glue the texts of each group in order: one row per ``keys``.

    A group's blocks are glued by their own tasks, and then the glued blocks in order.  NULL texts
    are left out; a group without any text gives no row.
    """
    blocked = cut_into_blocks(rows.where(F.col(text).isNotNull()), keys, order, rows_per_block)

    def glued(at: Column, item: Column) -> Column:
        items = F.array_sort(F.collect_list(F.struct(at.alias("p"), item.alias("t"))))
        return F.array_join(F.transform(items, lambda x: x["t"]), sep)

    parts = blocked.rows.groupBy("__key", "__block").agg(glued(F.struct(*order), F.col(text)).alias("__part"))
    whole = parts.groupBy("__key").agg(glued(F.col("__block"), F.col("__part")).alias(out))
    return whole.select(*[F.col("__key")[k].alias(k) for k in keys], out)


def first_per(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group, as an aggregate rather than a window."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
        .select(*keys, "__first.*")
    )


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each group: what is left after each write replaced the one before."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
        .select(*keys, "__last.*")
    )


def dict_last_wins(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """One row per key with its last value."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
