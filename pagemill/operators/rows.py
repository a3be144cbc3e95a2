"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: Sequence[str], array: Column | str, item: str, pos: str = "pos") -> DataFrame:
    """One row per element: ``keep, pos, item``; rows without elements disappear.

    For a plain ``explode`` the optimizer adds a filter on the array's size,
    which computes an expensive array (a regexp over a page) a second time or
    more.  The outer form avoids that; the filter then sees the finished rows.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def present(df: DataFrame, keep: Sequence[str], value: Column, item: str) -> DataFrame:
    """Rows where ``value`` is not NULL, with it as ``item``.

    A plain filter on a computed column is pushed below the projection and
    computes the column twice; see ``each``.
    """
    return each(df, keep, F.array_compact(F.array(value)), item, "__pos").drop("__pos")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt out over all cores.

    For narrow rows that become pages, or whatever else is much work for each row: a small file, or one of few row groups, is
    read by as many tasks as it has splits, whatever that work is.  AQE merges what is too small.
    """
    return rows.hint("rebalance")


# Tasks for each core, so that a stage does not end with a few long ones.
TASKS_PER_CORE = 8


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by ``keys`` into several tasks for each core.

    As ``dealt``, for narrow rows that are minutes of work: AQE merges by size, to tasks of 64 MB or little more of them than there
    are cores, and the last few would then run by themselves.  ``keys`` should tell rows apart.
    """
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, *keys)
