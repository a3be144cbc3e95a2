"""The work table: items with a price and a waiting time, some done, some due.

State columns: ``domain`` (unique), ``price``, ``scraped_at``, ``wait_s``, ``done``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.dates import LEAD_SECONDS, due_bucket, remaining_seconds
from pagemill.operators.scan import ROWS_PER_BLOCK, neighbours, ordinal
from pagemill.operators.segment import keep_last

STATE_SCHEMA = "domain string, price decimal(12,2), scraped_at timestamp, wait_s double, done boolean"


def upsert_items(state: DataFrame, incoming: DataFrame, now: Column, order: Sequence[str]) -> DataFrame:
    """Insert new items; for known open ones take the new price and re-base the waiting time.

    ``incoming`` has ``domain, price, wait_s``; several rows for one item
    collapse to the last by ``order``.  Items already done stay as they are.
    Both sides then hold one row per item, so the outer join is not skewed.
    """
    fresh = keep_last(incoming, ["domain"], order).select("domain", F.col("price").alias("__price"), F.col("wait_s").alias("__wait"), F.lit(True).alias("__in"))
    at = now.cast("timestamp")
    joined = state.withColumn("__old", F.lit(True)).join(fresh, "domain", "full_outer")
    known = F.col("__old").isNotNull()
    # An item without a mark is open.
    touched = known & ~F.coalesce("done", F.lit(False)) & F.col("__in").isNotNull()
    return joined.select(
        "domain",
        F.when(known & ~touched, F.col("price")).otherwise(F.col("__price")).alias("price"),
        F.when(known & ~touched, F.col("scraped_at")).otherwise(at).alias("scraped_at"),
        F.when(touched, remaining_seconds(F.col("wait_s"), F.col("scraped_at"), at))
        .when(known, F.col("wait_s"))
        .otherwise(F.col("__wait").cast("double"))
        .alias("wait_s"),
        F.coalesce("done", F.lit(False)).alias("done"),
    )


def refresh_remaining(state: DataFrame, now: Column) -> DataFrame:
    """Re-base the waiting time of open items to ``now``."""
    at = now.cast("timestamp")
    return state.withColumns(
        {
            "wait_s": F.when(F.col("done"), F.col("wait_s")).otherwise(
                remaining_seconds(F.col("wait_s"), F.col("scraped_at"), at)
            ),
            "scraped_at": F.when(F.col("done"), F.col("scraped_at").cast("timestamp")).otherwise(at),
        }
    )


def mark_done(state: DataFrame, keys: DataFrame, key: str = "domain") -> DataFrame:
    """Set ``done`` for the listed items."""
    listed = keys.select(key).distinct().withColumn("__listed", F.lit(True))
    return (
        state.join(listed, key, "left")
        .withColumn("done", F.coalesce("done", F.lit(False)) | F.coalesce("__listed", F.lit(False)))
        .drop("__listed")
    )


def successive_delay(
    rows: DataFrame, wait: str, keys: Sequence[str] = (), tie: Sequence[str] = (), out: str = "delay_s",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Waiting time minus the one before it in ascending order; the first keeps its own."""
    moved = neighbours(rows, keys, [wait, *tie], {"__before": (wait, -1)}, rows_per_block=rows_per_block)
    return moved.withColumn(out, F.col(wait) - F.coalesce("__before", F.lit(0.0))).drop("__before")


def elapsed_correction(plan: DataFrame, measured_at: str, done_at: Column, wait: str = "wait_s") -> DataFrame:
    """Take the time between measuring and planning off the waiting time."""
    return plan.withColumn(wait, remaining_seconds(F.col(wait), F.col(measured_at), done_at))


def due_plan(state: DataFrame, now: Column, lead: int = LEAD_SECONDS, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """What to do with each open item: ``domain, price, action, left_s, delay_s``.

    Open are items not marked done, also those without a mark.  Items with less than ``lead``
    seconds left are for now (delay 0).  The
    others wait until ``lead`` seconds before their time, one after the other,
    each with the delay since the one before.
    """
    left = remaining_seconds(F.col("wait_s"), F.col("scraped_at"), now)
    open_items = (
        state.where(~F.coalesce("done", F.lit(False)))
        .withColumn("left_s", left)
        .withColumn("action", due_bucket(F.col("left_s"), lead))
        .select("domain", "price", "action", "left_s")
    )
    at_once = open_items.where("action = 'now'").withColumn("delay_s", F.lit(0.0))
    waiting = open_items.where("action = 'wait'").withColumn("__wait", F.col("left_s") - F.lit(float(lead)))
    planned = successive_delay(waiting, "__wait", tie=["domain"], rows_per_block=rows_per_block).drop("__wait")
    return at_once.unionByName(planned)


def order_by_wait(items: DataFrame, wait: str, tie: Sequence[str]) -> DataFrame:
    """Ascending by waiting time; a total order needs the tie-break."""
    return items.orderBy(wait, *tie)


def first_row(items: DataFrame, *order: str) -> DataFrame:
    """The single first row in an order: a top-1, not a sort."""
    return items.orderBy(*order).limit(1)


def even_split(rows: DataFrame, parts: int, order: Sequence[str], out: str = "part", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Number contiguous parts 1..``parts`` of equal size; the first ones take the remainder.

    Like ``ntile`` over the whole table, but without bringing it into one task.
    """
    total = rows.agg(F.count(F.lit(1))).scalar()
    at, size, extra = F.col("__at"), F.floor(total / parts), total % parts
    bound = extra * (size + 1)
    number = F.when(at < bound, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - bound) / F.nullif(size, F.lit(0))))
    placed = ordinal(rows, order, "__at", rows_per_block=rows_per_block)
    return placed.withColumn(out, (number + 1).cast("int")).drop("__at")
