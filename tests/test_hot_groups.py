"""The registered ordered queries give their results with every group treated as hot,
and on tables where one key holds a third of all rows."""

import inspect

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from pagemill.operators import frontier, lookup, scan, schedule, segment
from pagemill.plans import news
from pagemill.plans.catalogue import ORACLES, QUERIES
from pagemill.session import scratch_path

ORDERED = [
    "document_islands", "island_last_values", "next_sibling", "previous_siblings", "successive_delay", "ordered_concat",
    "even_split", "positional_zip", "cumulative_distinct", "due_plan", "poll_plan", "news_export_files",
]
KEYED = [
    "take_while_rows", "document_islands", "island_last_values", "successive_delay", "cumulative_distinct", "pagination_converge",
    "keep_last_per_key", "due_plan", "publication_links",
]


@pytest.fixture()
def small_blocks(monkeypatch):
    """Cut groups of more than 15 rows."""
    for module in (scan, segment, schedule, lookup, frontier, news):
        for _, f in inspect.getmembers(module, inspect.isfunction):
            if "rows_per_block" in inspect.signature(f).parameters and f.__module__ == module.__name__:
                for attribute in ("__defaults__", "__kwdefaults__"):
                    old = getattr(f, attribute)
                    if isinstance(old, tuple):
                        monkeypatch.setattr(f, attribute, tuple(15 if v == scan.ROWS_PER_BLOCK else v for v in old))
                    elif isinstance(old, dict):
                        monkeypatch.setattr(f, attribute, {k: 15 if v == scan.ROWS_PER_BLOCK else v for k, v in old.items()})


@pytest.mark.parametrize("name", ORDERED)
def test_cut_groups(spark, sf, small_blocks, name):
    df = QUERIES[name](spark, sf)
    assert differences(df, connect(sf), ORACLES[name]) == []


@pytest.fixture(scope="module")
def skewed_dir(spark, sf):
    """The tables with a third of all events on one user, many of them at the same time."""
    root = scratch_path(spark, "skewed")
    events = spark.read.parquet(f"{sf}/events.parquet")
    hot = F.col("event_id") % 3 == 0
    events.withColumns(
        {
            "user_id": F.when(hot, 1).otherwise(F.col("user_id")).cast("bigint"),
            "ts": F.when(hot & (F.col("event_id") % 2 == 0), F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts")),
            "value": F.when(F.col("event_id") % 6 == 1, 70.0).otherwise(F.col("value")),
        }
    ).coalesce(1).write.parquet(f"{root}/events.parquet")
    return root


@pytest.mark.parametrize("name", KEYED)
def test_one_key_holds_a_third(spark, skewed_dir, small_blocks, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{skewed_dir}/events.parquet/*.parquet'")
    try:
        df = QUERIES[name](spark, skewed_dir)
        assert differences(df, con, ORACLES[name]) == []
    finally:
        con.close()
