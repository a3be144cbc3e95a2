"""Lookups, fallbacks and existence tests as joins.

No broadcast hints here: a dimension is broadcast when Spark finds it below
``spark.sql.autoBroadcastJoinThreshold`` (at planning time or, under AQE, once
its size is known); otherwise the join shuffles and AQE splits skewed
partitions.  Sides that only decide something per key are reduced to one row
per key first, so they cannot be skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.rows import each
from pagemill.operators.scan import ROWS_PER_BLOCK, ordinal


def lookup_name(df: DataFrame, dim: DataFrame, key: str, dim_key: str, *names: str) -> DataFrame:
    """Add dimension columns, NULL where the id is unknown.  ``dim_key`` is unique."""
    side = dim.select(F.col(dim_key).alias("__k"), *names)
    return df.join(side, df[key] == side["__k"], "left").drop("__k")


def join_detail(records: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Keep every record; add what the detail with the same id offers."""
    return records.join(details, key, "left")


def first_usable(
    records: DataFrame,
    key: str,
    candidates: Column,
    pages: DataFrame,
    url: str,
    usable: Column,
    fields: Sequence[str],
) -> DataFrame:
    """For each record, the first of its candidate addresses whose page is usable.

    ``candidates`` is an array in order of preference; ``pages`` has one row
    per ``url``.  The choice is made on addresses alone, as a partial aggregate; the
    fields of the chosen page are joined once, at the end.  Records without a usable
    page keep NULL.
    """
    good = pages.where(usable)
    tried = each(records, [key], candidates, "__url", "__rank")
    chosen = (
        tried.join(good.select(F.col(url).alias("__url")), "__url")
        .groupBy(key)
        .agg(F.min_by("__url", "__rank").alias("chosen_url"))
    )
    side = good.select(F.col(url).alias("__url"), *fields)
    picked = records.join(chosen, key, "left")
    return picked.join(side, F.col("chosen_url") == F.col("__url"), "left").select(
        *records.columns, "chosen_url", *fields
    )


def attach_with_fallback(
    df: DataFrame, link: str, record_id: str, base: str, texts: DataFrame, text_key: str = "link"
) -> DataFrame:
    """Follow the link, or the address built from the id where there is none, to a text."""
    wanted = df.withColumn(
        "attachment", F.coalesce(F.col(link), F.concat(F.lit(base), F.col(record_id).cast("string")))
    )
    side = texts.withColumnRenamed(text_key, "attachment")
    return wanted.join(side, "attachment", "left")


def zip_by_position(
    left: DataFrame,
    right: DataFrame,
    left_order: Sequence[str],
    right_order: Sequence[str],
    position: str = "position",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Put the k-th row of one side beside the k-th row of the other; both sides stay whole."""
    a = ordinal(left, left_order, position, rows_per_block=rows_per_block)
    b = ordinal(right, right_order, position, rows_per_block=rows_per_block)
    return a.join(b, position, "full_outer")


def new_items(incoming: DataFrame, state: DataFrame, key: str, state_key: str | None = None) -> DataFrame:
    """Incoming rows whose key the state does not have."""
    known = state.select(F.col(state_key or key).alias("__k")).distinct()
    return incoming.join(known, incoming[key] == known["__k"], "left_anti")


def existing_items(incoming: DataFrame, state: DataFrame, key: str, state_key: str | None = None) -> DataFrame:
    """Incoming rows whose key the state has."""
    known = state.select(F.col(state_key or key).alias("__k")).distinct()
    return incoming.join(known, incoming[key] == known["__k"], "left_semi")


def lookup_value(df: DataFrame, values: DataFrame, key: str, value_key: str, *names: str) -> DataFrame:
    """Add values by key; rows without one are left out (see ``missing_values``)."""
    side = values.select(F.col(value_key).alias("__k"), *names)
    return df.join(side, df[key] == side["__k"]).drop("__k")


def missing_values(df: DataFrame, values: DataFrame, key: str, value_key: str) -> DataFrame:
    """The keys ``lookup_value`` left out."""
    return new_items(df.select(key).distinct(), values, key, value_key)
