"""Ordered scans (running totals, neighbours, ordinals) that survive hot groups.

A window over ``partitionBy(keys)`` sends each group to one task.  That is fine
until one key holds a third of the table, or there is no key at all.  Here every
group is cut into consecutive blocks, each block is scanned by itself, and what
a block needs from those before it comes from a summary with a few rows per block.

Where a group is cut depends on its rows alone: a row begins a block if the hash of
its keys and order columns is divisible by ``rows_per_block``.  So blocks hold that many rows
on average however many rows there are, a small group usually is one block, and
the same rows always give the same blocks: no counting beforehand, no sample, and the plan has
one shape at any size.  The order columns should tell the rows of a group
apart; rows that agree in all of them are never cut.

Blocks come in stretches: where the hash is divisible by ``blocks_per_stretch`` times as much, a
stretch begins as well.  What is gathered is bounded by that: the beginnings of blocks lie in one array for each
stretch, a few thousand whatever the size of the table, and sums and border rows of blocks are scanned a stretch at a time.  Only
beginnings, sums and borders of whole stretches meet, one for each 268 million rows (3,700 of a
table of 10^12 rows).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a block and blocks of a stretch, on average.
ROWS_PER_BLOCK = 65_536
BLOCKS_PER_STRETCH = 4_096
# The rows of a stretch meet its beginnings in so many parts, which the hash deals out.
PARTS = 64

_KEY = "__key"
_BLOCK = "__block"
_CUT = "__cut"
# A block's number is that of its stretch and, in the lower bits, its own in there.
_BITS = 32


def _stretch(block: str = _BLOCK) -> Column:
    return F.shiftright(block, _BITS)


@dataclass(frozen=True)
class Blocked:
    """Rows with the struct of their keys, their block number, and whether their group is cut at all."""

    rows: DataFrame
    order: tuple[str, ...]

    @property
    def within(self):
        return Window.partitionBy(_KEY, _BLOCK).orderBy(*self.order)

    @property
    def along(self):
        # Only border rows of the blocks of a stretch go through this window.
        return Window.partitionBy(_KEY, _stretch()).orderBy(*self.order)

    @property
    def across(self):
        # Only border rows of stretches go through this one.
        return Window.partitionBy(_KEY).orderBy(*self.order)


def _edges(places: Column) -> Column:
    """Sorted block beginnings, and every ``step``-th of them to look among first."""
    ordered = F.sort_array(F.collect_set(places))
    step = F.ceil(F.sqrt(F.size(ordered))).cast("int")
    return F.struct(
        ordered.alias("all"),
        step.alias("step"),
        F.filter(ordered, lambda _, i: (i + 1) % step == 0).alias("coarse"),
    )


def _passed(edges: Column, place: Column) -> Column:
    """How many beginnings are at or before the row; 0 where there are none at all."""

    def passed(places: Column) -> Column:
        return F.size(F.filter(places, lambda e: e <= place))

    sure = passed(edges["coarse"]) * edges["step"]
    number = sure + passed(F.slice(edges["all"], sure + 1, edges["step"]))
    return F.when(F.size(edges["all"]) > 0, number).otherwise(0).cast("bigint")


def cut_into_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_block: int = ROWS_PER_BLOCK,
    blocks_per_stretch: int = BLOCKS_PER_STRETCH,
) -> Blocked:
    """Give every row its block, and deal the rows out by group and block.

    ``df`` is read twice, the second time only keys and order columns of one row in ``rows_per_block``.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    place = F.struct(*order)
    draw = F.xxhash64(*keys, *order)
    # Different beginnings, each once: both sorts are read from the same few rows.
    marks = (
        df.where(F.pmod(draw, F.lit(rows_per_block)) == 0)
        .groupBy(key.alias("__of"), place.alias("__place"))
        .agg(F.bool_or(F.pmod(draw, F.lit(rows_per_block * blocks_per_stretch)) == 0).alias("__far"))
    )
    far = marks.where("__far")

    def with_stretch(rows: DataFrame, of: str, at: Column) -> DataFrame:
        if keys:
            # One beginning for each stretch of rows_per_block * blocks_per_stretch rows: small at any size.
            edges = far.groupBy(F.col("__of").alias("__whose")).agg(_edges(F.col("__place")).alias("__stretches"))
            # Structs of nulls are equal, so null keys find their blocks as well.
            rows = rows.join(F.broadcast(edges), F.col(of) == F.col("__whose"), "left").drop("__whose")
        else:
            rows = rows.withColumn("__stretches", far.agg(_edges(F.col("__place"))).scalar())
        several = F.coalesce(F.size(F.col("__stretches")["all"]) > 0, F.lit(False))
        return rows.withColumns({"__several": several, "__stretch": _passed(F.col("__stretches"), at)}).drop("__stretches")

    edges = (
        with_stretch(marks.where("not __far"), "__of", F.col("__place"))
        .groupBy("__of", F.col("__stretch").alias("__in"))
        .agg(_edges(F.col("__place")).alias("__edges"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    )
    rows = with_stretch(df.withColumn(_KEY, key), _KEY, place).withColumn("__dealt", F.pmod(draw, F.lit(PARTS)).cast("int"))
    # By key and stretch alone a whole stretch, or a table without keys, would be joined by one task.
    same = (F.col(_KEY) == F.col("__of")) & (F.col("__stretch") == F.col("__in")) & (F.col("__dealt") == F.col("__part"))
    rows = rows.join(edges, same, "left")
    number = F.shiftleft("__stretch", _BITS) + _passed(F.col("__edges"), place)
    cut = F.col("__several") | F.col("__edges").isNotNull()
    numbered = rows.withColumns({_CUT: cut, _BLOCK: number}).drop(
        "__of", "__in", "__edges", "__several", "__stretch", "__dealt", "__part"
    )
    return Blocked(numbered.repartition(_KEY, _BLOCK), tuple(order))


def _carried(sums: DataFrame) -> DataFrame:
    """``__of, __in, __carry``: for each block the sum of those before it, in its stretch and in the stretches before."""
    before = (Window.unboundedPreceding, -1)
    near = Window.partitionBy("__of", _stretch("__in")).orderBy("__in").rowsBetween(*before)
    far = Window.partitionBy("__whose").orderBy("__stretch").rowsBetween(*before)
    stretches = (
        sums.groupBy(F.col("__of").alias("__whose"), _stretch("__in").alias("__stretch"))
        .agg(F.sum("__sum").alias("__sum"))
        .withColumn("__far", F.sum("__sum").over(far))
        .drop("__sum")
    )
    blocks = sums.withColumn("__near", F.sum("__sum").over(near))
    joined = blocks.join(stretches, (F.col("__of") == F.col("__whose")) & (_stretch("__in") == F.col("__stretch")))
    carry = F.coalesce("__near", F.lit(0)) + F.coalesce("__far", F.lit(0))
    return joined.select("__of", "__in", carry.alias("__carry"))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    *,
    before: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
    blocks_per_stretch: int = BLOCKS_PER_STRETCH,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to each row, or over the rows ``before`` it."""
    blocked = cut_into_blocks(df.withColumn("__value", value), keys, order, rows_per_block, blocks_per_stretch)
    frame = blocked.within.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    local = F.coalesce(F.sum("__value").over(frame), F.lit(0))
    sums = (
        blocked.rows.where(_CUT)
        .groupBy(F.col(_KEY).alias("__of"), F.col(_BLOCK).alias("__in"))
        .agg(F.sum("__value").alias("__sum"))
    )
    rows = blocked.rows.withColumn("__local", local)
    joined = rows.join(_carried(sums), (F.col(_KEY) == F.col("__of")) & (F.col(_BLOCK) == F.col("__in")), "left")
    return joined.select(*df.columns, (F.col("__local") + F.coalesce("__carry", F.lit(0))).alias(out))


def ordinal(
    df: DataFrame,
    order: Sequence[str],
    out: str,
    *,
    keys: Sequence[str] = (),
    rows_per_block: int = ROWS_PER_BLOCK,
    blocks_per_stretch: int = BLOCKS_PER_STRETCH,
) -> DataFrame:
    """Add ``out``: the 0-based position of each row within ``keys`` (or the whole table)."""
    one = F.lit(1).cast("bigint")
    return running_total(
        df, keys, order, one, out, before=True, rows_per_block=rows_per_block, blocks_per_stretch=blocks_per_stretch
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    wanted: Mapping[str, tuple[str, int]],
    *,
    rows_per_block: int = ROWS_PER_BLOCK,
    blocks_per_stretch: int = BLOCKS_PER_STRETCH,
) -> DataFrame:
    """Add a column per entry of ``wanted``: name -> (column, offset).

    A negative offset looks back, a positive one ahead; past either end of the
    group the value is NULL.
    """

    def shifted(window):
        return {
            name: (F.lag(col, -offset) if offset < 0 else F.lead(col, offset)).over(window)
            for name, (col, offset) in wanted.items()
        }

    blocked = cut_into_blocks(df, keys, order, rows_per_block, blocks_per_stretch)
    reach = max(abs(offset) for _, offset in wanted.values())

    def borders(distance: int) -> Column:
        return F.col(_CUT) & ((F.col("__head") <= distance) | (F.col("__tail") <= distance))

    rows, found = blocked.rows.withColumn("__open", F.lit(True)), []
    for window, parts in [(blocked.within, [_KEY, _BLOCK]), (blocked.along, [_KEY, _stretch()])]:
        size = F.count(F.lit(1)).over(Window.partitionBy(*parts))
        numbered = rows.withColumn("__head", F.row_number().over(window)).withColumn("__tail", size - F.col("__head") + 1)
        # A row whose neighbours may lie in another part is within `reach` of a border.
        found.append(numbered.withColumns(shifted(window)).where(F.col("__open") & ~borders(reach)))
        # Any such row finds all rows up to `reach` away among rows that lie within 2*reach of a border.
        rows = numbered.withColumn("__open", F.col("__open") & borders(reach)).where(borders(2 * reach))
    found.append(rows.withColumns(shifted(blocked.across)).where("__open"))
    inside, along, across = (part.select(*df.columns, *wanted) for part in found)
    return inside.unionByName(along).unionByName(across)
