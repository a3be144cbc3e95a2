"""Ordered scans give the same result whether or not groups are cut into blocks."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.operators.scan import cut_into_blocks, neighbours, ordinal, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    """9000 rows: key 'hot' has a third of them, one order value of it a third of those; a NULL key and NULL order values."""
    n = F.col("id")
    key = F.when(n < 3000, F.lit("hot")).when(n < 4500, F.lit("warm")).when(n < 4600, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (n % 400).cast("string"))
    )
    at = F.when(n % 97 == 0, F.lit(None)).when(n < 1000, F.lit(500)).otherwise((n * 7919) % 5003)
    rows = spark.range(9000).select(
        "id", key.alias("key"), at.cast("int").alias("at"), F.timestamp_seconds(n * 13 % 1000).cast("timestamp_ntz").alias("ts"),
        (n % 5).alias("v"),
    )
    return rows.repartition(7, F.xxhash64("id")).cache()


def result(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


ORDERS = [["at", "id"], ["ts", "id"], ["id"]]


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("before", [False, True])
def test_running_total(skewed, keys, order, before):
    frame = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    frame = frame.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    wanted = skewed.withColumn("t", F.coalesce(F.sum("v").over(frame), F.lit(0)))
    got = running_total(skewed, keys, order, F.col("v"), "t", before=before, rows_per_block=300)
    assert result(got) == result(wanted)


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("keys", [["key"], []])
def test_neighbours(skewed, keys, order):
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    wanted = skewed.select("*", F.lag("id", 1).over(w).alias("a"), F.lag("v", 3).over(w).alias("b"), F.lead("id", 2).over(w).alias("c"))
    got = neighbours(skewed, keys, order, {"a": ("id", -1), "b": ("v", -3), "c": ("id", 2)}, rows_per_block=150)
    assert result(got) == result(wanted)


def test_neighbours_across_tiny_blocks(skewed):
    """Blocks shorter than the reach: a neighbour may lie several blocks away."""
    few = skewed.where("id < 60")
    w = Window.partitionBy("key").orderBy("id")
    wanted = few.withColumn("a", F.lag("id", 5).over(w))
    assert result(neighbours(few, ["key"], ["id"], {"a": ("id", -5)}, rows_per_block=2)) == result(wanted)


@pytest.mark.parametrize("order", ORDERS[:2])
@pytest.mark.parametrize("keys", [["key"], []])
def test_stretches_of_blocks(skewed, keys, order):
    """Rows, blocks and stretches: sums and neighbours come from all three levels."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    cut = {"rows_per_block": 20, "blocks_per_stretch": 6}
    blocks = cut_into_blocks(skewed, keys, order, 20, 6).rows
    stretches = blocks.groupBy(*keys, F.shiftright("__block", 32).alias("s")).agg(F.countDistinct("__block").alias("n"))
    assert stretches.count() > 20 and 5 < stretches.agg(F.max("n")).first()[0] < 100
    wanted = skewed.withColumn("t", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert result(running_total(skewed, keys, order, F.col("v"), "t", **cut)) == result(wanted)
    wanted = skewed.select("*", F.lag("id", 3).over(w).alias("a"), F.lead("v", 2).over(w).alias("b"))
    assert result(neighbours(skewed, keys, order, {"a": ("id", -3), "b": ("v", 2)}, **cut)) == result(wanted)


def test_every_row_a_stretch(skewed):
    few = skewed.where("id < 200")
    w = Window.partitionBy("key").orderBy("id")
    wanted = few.withColumn("a", F.lag("id", 4).over(w))
    got = neighbours(few, ["key"], ["id"], {"a": ("id", -4)}, rows_per_block=2, blocks_per_stretch=1)
    assert result(got) == result(wanted)


def test_ordinal_is_a_permutation(skewed):
    got = [r.p for r in ordinal(skewed, ["at", "id"], "p", rows_per_block=500).orderBy("p").collect()]
    assert got == list(range(9000))


@pytest.mark.parametrize("order", ORDERS)
def test_blocks_are_bounded(skewed, order):
    blocks = cut_into_blocks(skewed, ["key"], order, 100).rows
    sizes = [r["count"] for r in blocks.groupBy("key", "__block").count().collect()]
    assert sum(sizes) == 9000
    # A block ends with probability 1/100 at each row: none is many times as long.
    assert max(sizes) <= 1500
    assert blocks.where("key = 'hot'").select("__block").distinct().count() >= 10


def test_blocks_follow_the_order(skewed):
    blocks = cut_into_blocks(skewed, [], ["at", "id"], 300).rows
    spans = blocks.groupBy("__block").agg(F.min(F.struct("at", "id")).alias("lo"), F.max(F.struct("at", "id")).alias("hi"))
    w = Window.orderBy("__block")
    overlaps = spans.withColumn("next", F.lead("lo").over(w)).where("next <= hi")
    assert overlaps.count() == 0
    assert spans.count() > 5


def test_blocks_do_not_depend_on_the_other_rows(skewed):
    """Other groups, partitions and the size of the table make no difference."""
    whole = cut_into_blocks(skewed, ["key"], ["id"], 100).rows.where("key = 'warm'").select("id", "__block")
    alone = cut_into_blocks(skewed.where("key = 'warm'").coalesce(1), ["key"], ["id"], 100).rows.select("id", "__block")
    assert result(whole) == result(alone)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


@pytest.mark.parametrize("keys", [["key"], []])
def test_no_task_gets_a_whole_group(skewed, keys):
    lines = plan_of(running_total(skewed, keys, ["id"], F.col("v"), "t")).splitlines()
    windows = [line for line in lines if "Window [" in line]
    assert windows
    # A window runs over one block of rows, or over the sums of the blocks.
    assert all("__block" in line or "__sum" in line for line in windows)


def test_what_comes_before_is_read_once_for_neighbours(skewed):
    """All levels go on with the same dealt rows, the second read is that of the beginnings."""
    few = skewed.withColumn("v", F.expr("reflect('java.lang.Math', 'abs', cast(v as int))").cast("int"))
    plan = neighbours(few, ["key"], ["id"], {"a": ("v", 1)})
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("reflect", text)) == 1


def test_no_job_while_building(spark, skewed):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    running_total(skewed, ["key"], ["id"], F.col("v"), "t")
    neighbours(skewed, [], ["id"], {"a": ("id", 1)})
    ordinal(skewed, ["id"], "p")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_one_plan_at_every_size(spark):
    """Apart from Spark's own choice between a broadcast and a merge join."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def shape(n):
        df = spark.range(n).select("id", (F.col("id") % 7).alias("key"))
        plan = plan_of(running_total(df, ["key"], ["id"], F.col("id"), "t"))
        return re.findall(r"[A-Z][A-Za-z]+(?= |$)", re.sub(r"[#\d]+", "", plan))

    try:
        assert shape(5) == shape(10_000_000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_stretch_meets_its_beginnings_in_many_tasks(spark):
    """A table without keys is one stretch, which one task would join by key and stretch alone."""
    from pagemill.operators.scan import ordinal

    plan = ordinal(spark.range(1000), ["id"], "at")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line and "__in" in line and "__stretch" in line]
    assert joins and all("__dealt" in line and "__part" in line for line in joins)
