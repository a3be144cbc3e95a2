"""One poll of the work table: load, plan, mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.dates import duration_seconds
from pagemill.operators.schedule import due_plan, elapsed_correction, refresh_remaining, upsert_items
from pagemill.sources.readers import pair_list


def load_items(state: DataFrame, requests: DataFrame, durations: DataFrame, now: Column) -> DataFrame:
    """Fold a request list (``pairs``: ``"domain,price …"``) into the state.

    ``durations`` (``domain, time_left``) holds the remaining time as text;
    an item without one has no time left.  Later pairs replace earlier ones.
    """
    wanted = pair_list(requests, "pairs", keep=["request_id"]).select(
        "request_id",
        "pos",
        F.col("item").alias("domain"),
        F.col("value").try_cast("decimal(12,2)").alias("price"),
    )
    incoming = wanted.join(durations, "domain", "left").withColumn(
        "wait_s", duration_seconds(F.coalesce("time_left", F.lit("0s")))
    )
    return upsert_items(state, incoming, now, order=["request_id", "pos"])


def poll(state: DataFrame, now: Column, planned_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan for all open items, and the state with those items done.

    Waiting times are measured at ``now``; what passes until ``planned_at`` is taken off in the plan.
    """
    current = refresh_remaining(state, now)
    at = now if planned_at is None else planned_at
    measured = elapsed_correction(current, "scraped_at", at).withColumn("scraped_at", at.cast("timestamp"))
    # Every open item is in the plan, so every item is done afterwards.
    return due_plan(measured, at), current.withColumn("done", F.lit(True))
