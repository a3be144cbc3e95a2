"""Queries for ordered scans and the work table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import schedule as C
from pagemill.operators import segment as S
from pagemill.plans.q_text import NOW, now
from pagemill.plans.registry import query

USER_ORDER = ["ts", "event_id"]


@query(
    "take_while_rows",
    """SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER
       (PARTITION BY user_id ORDER BY ts, event_id) AS stopped FROM events) WHERE stopped = 0""",
)
def _(t):
    rows = t.events.select("user_id", "ts", "event_id", "event_type")
    return S.take_while(rows, F.col("event_type") == "error", ["user_id"], USER_ORDER).select("user_id", "event_id")


ISLANDS_SQL = """
    SELECT *, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS doc_no FROM events
"""


def islands(t, *columns):
    rows = t.events.select("user_id", "ts", "event_id", "event_type", *columns)
    return S.segment(rows, F.col("event_type") == "purchase", ["user_id"], USER_ORDER)


@query("document_islands", f"SELECT user_id, event_id, doc_no FROM ({ISLANDS_SQL})")
def _(t):
    return islands(t).select("user_id", "event_id", "doc_no")


@query(
    "island_last_values",
    f"""SELECT user_id, doc_no, arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS last_click,
              arg_max(props, (ts, event_id)) FILTER (event_type = 'view') AS last_view,
              arg_max(event_type, (ts, event_id)) AS last_type FROM ({ISLANDS_SQL}) GROUP BY user_id, doc_no""",
)
def _(t):
    kind = F.col("event_type")
    return S.last_in_segment(
        islands(t, "value", "props"),
        ["user_id", "doc_no"],
        USER_ORDER,
        {"last_click": F.when(kind == "click", F.col("value")), "last_view": F.when(kind == "view", F.col("props")), "last_type": kind},
    )


@query(
    "next_sibling",
    "SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations",
)
def _(t):
    rows = t.conversations.select("conv_id", "turn", "role")
    return S.next_sibling(rows, "role", ["conv_id"], ["turn"], "next_role").drop("role")


@query(
    "previous_siblings",
    """SELECT conv_id, turn, lag(role, 1) OVER w AS location, lag(role, 2) OVER w AS school, lag(role, 3) OVER w AS designation
       FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def _(t):
    rows = t.conversations.select("conv_id", "turn", "role")
    return S.previous_siblings(rows, "role", ["conv_id"], ["turn"], ["location", "school", "designation"]).drop("role")


@query(
    "successive_delay",
    """SELECT event_id, wait_s - coalesce(lag(wait_s) OVER (PARTITION BY user_id ORDER BY wait_s, event_id), 0) AS delay_s
       FROM (SELECT *, epoch_us(ts) / 1e6 AS wait_s FROM events)""",
)
def _(t):
    rows = t.events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("wait_s"))
    return C.successive_delay(rows, "wait_s", ["user_id"], ["event_id"]).select("event_id", "delay_s")


@query("even_split", "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS INTEGER) AS part FROM orders")
def _(t):
    return C.even_split(t.orders.select("o_orderkey"), 7, ["o_orderkey"])


@query(
    "order_by_wait",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey",
)
def _(t):
    return C.order_by_wait(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])


@query("limit_one_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def _(t):
    return C.first_row(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


def event_state(t):
    """Events as work items: value = waiting time in ten hours, purchases are done."""
    return t.events.select(
        F.concat(F.lit("item-"), F.col("event_id").cast("string")).alias("domain"),
        F.col("value").cast("decimal(12,2)").alias("price"),
        F.col("ts").cast("timestamp").alias("scraped_at"),
        (F.col("value") * 36000.0).alias("wait_s"),
        (F.col("event_type") == "purchase").alias("done"),
    )


STATE_SQL = """SELECT 'item-' || event_id AS domain, value AS price, ts AS scraped_at, value * 36000.0 AS wait_s,
       event_type = 'purchase' AS done FROM events"""
LEFT_SQL = f"(wait_s - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(scraped_at)) / 1e6)"


@query("open_work_items", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def _(t):
    from pagemill.sources.readers import open_items

    return open_items(t.orders, F.col("o_orderstatus") != "O").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "refresh_state",
    f"""SELECT domain, CASE WHEN done THEN wait_s ELSE {LEFT_SQL} END AS wait_s,
              epoch_us(CASE WHEN done THEN scraped_at ELSE TIMESTAMP '{NOW}' END) AS scraped_us, done FROM ({STATE_SQL})""",
)
def _(t):
    fresh = C.refresh_remaining(event_state(t), now())
    return fresh.select("domain", "wait_s", F.unix_micros("scraped_at").alias("scraped_us"), "done")


@query(
    "mark_done",
    """SELECT 'o-' || o_orderkey AS domain, o_orderstatus = 'F' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) AS done
       FROM orders""",
)
def _(t):
    state = t.orders.select(
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("domain"), (F.col("o_orderstatus") == "F").alias("done")
    )
    acted = t.lineitem.where("l_quantity > 48").select(F.concat(F.lit("o-"), F.col("l_orderkey").cast("string")).alias("domain"))
    return C.mark_done(state, acted)


DUE_SQL = f"""
    WITH o AS (SELECT domain, price, {LEFT_SQL} AS left_s FROM ({STATE_SQL}) WHERE NOT done),
         a AS (SELECT *, CASE WHEN left_s < 300 THEN 'now' ELSE 'wait' END AS action FROM o)
    SELECT domain, price, action, left_s, 0.0::DOUBLE AS delay_s FROM a WHERE action = 'now'
    UNION ALL SELECT domain, price, action, left_s,
           (left_s - 300) - coalesce(lag(left_s - 300) OVER (ORDER BY left_s - 300, domain), 0) FROM a WHERE action = 'wait'
"""


@query("due_plan", DUE_SQL)
def _(t):
    return C.due_plan(event_state(t), now()).withColumn("price", F.col("price").cast("double"))


@query(
    "elapsed_correction",
    f"SELECT domain, wait_s - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(scraped_at)) / 1e6 AS wait_s FROM ({STATE_SQL})",
)
def _(t):
    plan = event_state(t).withColumnRenamed("scraped_at", "measured_at")
    return C.elapsed_correction(plan, "measured_at", now()).select("domain", "wait_s")


def customer_state(t, known="c_acctbal > 1000"):
    """Customers (those with a balance) are known since the first of the month; builders are done."""
    key = F.col("c_custkey")
    return t.customer.where(known).select(
        F.concat(F.lit("c-"), key.cast("string")).alias("domain"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("price"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("scraped_at"),
        (key * 10000.0).alias("wait_s"),
        (F.col("c_mktsegment") == "BUILDING").alias("done"),
    )


def order_requests(orders):
    return orders.select(
        "o_orderkey",
        F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("domain"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        (F.col("o_orderkey") * 60.0).alias("wait_s"),
    )


UPSERT_SQL = f"""
    WITH s AS (SELECT 'c-' || c_custkey AS domain, c_acctbal AS price, TIMESTAMP '2024-01-01' AS scraped_at, c_custkey * 10000.0 AS wait_s,
                      c_mktsegment = 'BUILDING' AS done FROM customer WHERE c_acctbal > 1000),
         i AS (SELECT 'c-' || o_custkey AS domain, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) * 60.0 AS wait_s
               FROM orders GROUP BY o_custkey)
    SELECT coalesce(s.domain, i.domain) AS domain,
           CAST(CASE WHEN s.domain IS NULL OR (NOT s.done AND i.domain IS NOT NULL) THEN i.price ELSE s.price END AS DOUBLE) AS price,
           epoch_us(CASE WHEN s.domain IS NULL OR (NOT s.done AND i.domain IS NOT NULL) THEN TIMESTAMP '{NOW}' ELSE s.scraped_at END) AS scraped_us,
           CAST(CASE WHEN s.domain IS NULL THEN i.wait_s WHEN NOT s.done AND i.domain IS NOT NULL
                THEN s.wait_s - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(s.scraped_at)) / 1e6 ELSE s.wait_s END AS DOUBLE) AS wait_s,
           coalesce(s.done, false) AS done
    FROM s FULL JOIN i ON s.domain = i.domain
"""


def plain_state(state):
    return state.select(
        "domain", F.col("price").cast("double").alias("price"), F.unix_micros("scraped_at").alias("scraped_us"), "wait_s", "done"
    )


@query("upsert_state", UPSERT_SQL)
def _(t):
    return plain_state(C.upsert_items(customer_state(t), order_requests(t.orders), now(), order=["o_orderkey"]))
