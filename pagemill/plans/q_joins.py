"""Queries for lookups, fallbacks, the link frontier and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import frontier as R
from pagemill.operators import lookup as L
from pagemill.operators import segment as S
from pagemill.operators.extract import extract_links
from pagemill.operators.records import outcome_counts, route_outcome
from pagemill.operators.sentiment import lexicon_frame, lexicon_sentiment
from pagemill.plans.q_pages import LINKS_SQL
from pagemill.plans.registry import query

HOST = r"^https?://([^/?#]+)"


def hosted_links(t):
    return extract_links(t.pages, keys=("page_id", "url")).withColumn("host", F.regexp_extract("url", HOST, 1))


HOSTED_SQL = f"SELECT *, regexp_extract(url, '{HOST}', 1) AS host FROM ({LINKS_SQL})"


@query("distinct_links_per_group", f"SELECT host, count(DISTINCT href) AS n_links FROM ({HOSTED_SQL}) WHERE href IS NOT NULL GROUP BY host")
def _(t):
    return R.distinct_links(hosted_links(t), ["host"], "href")


NEW_LINKS_SQL = f"""SELECT DISTINCT host, href FROM ({HOSTED_SQL}) a WHERE url LIKE 'https:%' AND href IS NOT NULL AND NOT EXISTS
        (SELECT 1 FROM ({HOSTED_SQL}) b WHERE b.url LIKE 'http:%' AND b.host = a.host AND b.href = a.href)"""


@query("frontier_new_links", NEW_LINKS_SQL)
def _(t):
    # Pages landed over http came first.
    links = hosted_links(t).where("href is not null")
    return R.unseen(links.where("url like 'https:%'"), links.where("url like 'http:%'"), ["host", "href"])


@query("frontier_new_links_sketch", NEW_LINKS_SQL)
def _(t):
    links = hosted_links(t).where("href is not null")
    return R.unseen_by_sketch(links.where("url like 'https:%'"), links.where("url like 'http:%'"), ["host", "href"])


@query(
    "frontier_cross",
    """SELECT c_custkey, CAST(p AS INTEGER) AS page_no, 'http://www.example.org/s?f=' || c_custkey || '&page=' || p AS url
       FROM customer, range(1, 6) r(p)""",
)
def _(t):
    seeds = t.customer.select("c_custkey")
    return R.frontier(seeds, "c_custkey", 5, "http://www.example.org/s?f={field}&page={page}")


def daily_types(t):
    """Events as search results: user = field, day = page number, type = link."""
    return t.events.select("user_id", F.dayofmonth("ts").alias("day"), "event_type")


@query(
    "pagination_converge",
    """WITH e AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS day, event_type FROM events),
            f AS (SELECT user_id, event_type, min(day) AS day FROM e GROUP BY ALL),
            n AS (SELECT e.user_id, e.day, count(f.event_type) AS n FROM (SELECT DISTINCT user_id, day FROM e) e
                  LEFT JOIN f USING (user_id, day) GROUP BY ALL),
            z AS (SELECT *, max(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM n)
       SELECT user_id, day FROM z WHERE coalesce(stopped, 0) = 0""",
)
def _(t):
    rows = daily_types(t)
    return R.converge_pages(rows, rows, ["user_id"], "event_type", "day")


@query(
    "cumulative_distinct",
    """WITH e AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS day, event_type FROM events),
            f AS (SELECT user_id, event_type, min(day) AS day FROM e GROUP BY ALL),
            n AS (SELECT e.user_id, e.day, count(f.event_type) AS n_new FROM (SELECT DISTINCT user_id, day FROM e) e
                  LEFT JOIN f USING (user_id, day) GROUP BY ALL)
       SELECT user_id, day, n_new, CAST(sum(n_new) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS n_known FROM n""",
)
def _(t):
    return R.cumulative_distinct(daily_types(t), ["user_id"], "event_type", "day")


@query(
    "stop_at_first_gap",
    """SELECT doc_id, quality FROM labels WHERE doc_id < (SELECT min(i) FROM range(0, (SELECT max(doc_id) + 2 FROM labels)) r(i)
       WHERE i NOT IN (SELECT doc_id FROM labels))""",
)
def _(t):
    return R.until_first_gap(t.labels, "doc_id", 0).select("doc_id", "quality")


@query(
    "lookup_broadcast",
    "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey + 3 = n_nationkey",
)
def _(t):
    wanted = t.customer.select("c_custkey", (F.col("c_nationkey") + 3).alias("nation_id"))
    return L.lookup_name(wanted, t.nation, "nation_id", "n_nationkey", "n_name").drop("nation_id")


@query(
    "record_detail_join",
    "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'MACHINERY'",
)
def _(t):
    details = t.customer.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return L.join_detail(t.orders.select("o_orderkey", "o_custkey"), details, "o_custkey")


@query(
    "first_usable_candidate",
    """SELECT d.doc_id, CASE WHEN a.quality = 1 THEN 'doc-' || a.doc_id WHEN b.quality = 1 THEN 'doc-' || b.doc_id END AS chosen_url,
              CASE WHEN a.quality = 1 THEN a.toxic WHEN b.quality = 1 THEN b.toxic END AS toxic
       FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id + 1""",
)
def _(t):
    landed = t.labels.withColumn("url", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).drop("doc_id")
    tries = F.array(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.concat(F.lit("doc-"), (F.col("doc_id") + 1).cast("string"))
    )
    return L.first_usable(t.documents.select("doc_id"), "doc_id", tries, landed, "url", F.col("quality") == 1, ["toxic"])


@query(
    "coalesce_fallback_join",
    """WITH o AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1)
       SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN 'key/' || (c_custkey // 2) END, 'key/' || c_custkey) AS attachment, n_orders
       FROM customer LEFT JOIN o ON o_custkey = CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey // 2 ELSE c_custkey END""",
)
def _(t):
    texts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders")).select(
        F.concat(F.lit("key/"), F.col("o_custkey").cast("string")).alias("link"), "n_orders"
    )
    half = F.concat(F.lit("key/"), F.floor(F.col("c_custkey") / 2).cast("string"))
    records = t.customer.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", half).alias("doi"))
    return L.attach_with_fallback(records, "doi", "c_custkey", "key/", texts).drop("doi")


@query(
    "positional_zip",
    """SELECT position, page_id, item_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS position FROM pages) p
       FULL JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS position FROM benchmark) b USING (position)""",
)
def _(t):
    return L.zip_by_position(t.pages.select("page_id"), t.benchmark.select("item_id"), ["page_id"], ["item_id"])


@query(
    "new_items_anti",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
)
def _(t):
    known = t.orders.where("o_orderstatus = 'P'")
    return L.new_items(t.customer.select("c_custkey", "c_name"), known, "c_custkey", "o_custkey")


@query(
    "existing_items_semi",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
)
def _(t):
    known = t.orders.where("o_orderstatus = 'P'")
    return L.existing_items(t.customer.select("c_custkey", "c_name"), known, "c_custkey", "o_custkey")


@query(
    "price_lookup",
    "SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size < 40",
)
def _(t):
    prices = t.part.where("p_size < 40")
    wanted = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return L.lookup_value(wanted, prices, "l_partkey", "p_partkey", "p_retailprice")


@query(
    "price_missing",
    "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)",
)
def _(t):
    return L.missing_values(t.lineitem, t.part.where("p_size < 40"), "l_partkey", "p_partkey")


@query(
    "ordered_concat",
    "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
)
def _(t):
    return S.ordered_concat(t.conversations, ["conv_id"], ["turn"], "text")


# The registered list and factors once more, as plain values of the checking SQL.
LISTED = """('awful', -0.9, 1.0), ('bad', -0.7, 0.7), ('best', 1.0, 0.3), ('better', 0.5, 0.5), ('clown', -0.4, 0.8), ('cheap', -0.2, 0.6),
    ('disgusting', -1.0, 1.0), ('fool', -0.6, 0.9), ('free', 0.4, 0.6), ('garbage', -0.8, 0.8), ('gain', 0.4, 0.3), ('good', 0.7, 0.6),
    ('great', 0.8, 0.75), ('happy', 0.8, 1.0), ('hate', -0.8, 0.9), ('idiot', -0.8, 0.9), ('loser', -0.6, 0.8), ('loss', -0.4, 0.3),
    ('love', 0.5, 0.6), ('nice', 0.6, 1.0), ('optimistic', 0.6, 0.7), ('pathetic', -1.0, 1.0), ('record', 0.2, 0.1), ('strong', 0.4, 0.7),
    ('stupid', -0.8, 1.0), ('ugly', -0.7, 1.0), ('weak', -0.4, 0.6), ('worst', -1.0, 1.0), ('worthless', -0.8, 0.9)"""


def _lexicon_sql(listed: str) -> str:
    return f"""
    WITH lex AS ({listed}),
         toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents),
         spoken AS (SELECT doc_id, unnest(ws) AS word, unnest(list_concat([''], ws[:-2])) AS before FROM toks),
         hits AS (SELECT s.doc_id, l.polarity * CASE WHEN before IN ('not', 'no', 'never') THEN -0.5 ELSE 1.0 END AS p, l.subjectivity AS s
                  FROM spoken s JOIN lex l USING (word))
    SELECT d.doc_id, round(coalesce(avg(p), 0), 6) AS polarity, round(coalesce(avg(s), 0), 6) AS subjectivity, count(p) AS n_hits
    FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id
    """


def rounded(scored):
    return scored.select(
        "doc_id", F.round("polarity", 6).alias("polarity"), F.round("subjectivity", 6).alias("subjectivity"), "n_hits"
    )


@query(
    "lexicon_sentiment",
    _lexicon_sql(f"SELECT word, polarity::DOUBLE AS polarity, subjectivity::DOUBLE AS subjectivity FROM (VALUES {LISTED}) v(word, polarity, subjectivity)"),
)
def _(t):
    return rounded(lexicon_sentiment(t.documents, lexicon_frame(t.spark)))


PHRASES = {"the": (0.1, 0.2), "of the": (0.6, 0.4), "is": (-0.2, 0.3), "and that is": (-0.9, 1.0), "that": (0.3, 0.5)}


@query(
    "phrase_sentiment",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS i FROM documents),
            n AS (SELECT *, lag(w) OVER o AS p1, lag(w, 2) OVER o AS p2, lead(w) OVER o AS n1, lead(w, 2) OVER o AS n2
                  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
            e AS (SELECT *, CASE WHEN w = 'and' AND n1 = 'that' AND n2 = 'is' THEN 'and that is' WHEN w = 'of' AND n1 = 'the' THEN 'of the'
                                 WHEN w = 'the' AND p1 = 'of' THEN NULL WHEN w = 'that' AND p1 = 'and' AND n1 = 'is' THEN NULL
                                 WHEN w = 'is' AND p1 = 'that' AND p2 = 'and' THEN NULL WHEN w IN ('the', 'is', 'that') THEN w END AS entry
                  FROM n),
            s AS (SELECT doc_id, CASE entry WHEN 'the' THEN 0.1 WHEN 'of the' THEN 0.6 WHEN 'is' THEN -0.2 WHEN 'and that is' THEN -0.9 WHEN 'that' THEN 0.3 END::DOUBLE
                         * CASE WHEN p1 IN ('in', 'not') THEN -0.5 WHEN p1 = 'a' AND p2 IN ('in', 'not') THEN -0.75 WHEN p1 = 'a' THEN 1.5 ELSE 1 END::DOUBLE AS p,
                         CASE entry WHEN 'the' THEN 0.2 WHEN 'of the' THEN 0.4 WHEN 'is' THEN 0.3 WHEN 'and that is' THEN 1.0 WHEN 'that' THEN 0.5 END::DOUBLE AS s
                  FROM e WHERE entry IS NOT NULL)
       SELECT doc_id, round(coalesce(avg(p), 0), 6) AS polarity, round(coalesce(avg(s), 0), 6) AS subjectivity, count(p) AS n_hits
       FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id""",
)
def _(t):
    rows = [(w, p, s) for w, (p, s) in PHRASES.items()]
    entries = t.spark.createDataFrame(rows, "word string, polarity double, subjectivity double")
    return rounded(lexicon_sentiment(t.documents, entries, negators=("in", "not"), intensifiers={"a": 1.5}))


@query(
    "lexicon_table_sentiment",
    _lexicon_sql(
        """SELECT DISTINCT word, (length(word) % 5 - 2) / 2.0::DOUBLE AS polarity, (length(word) % 3) / 2.0::DOUBLE AS subjectivity
           FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)"""
    ),
)
def _(t):
    # A list of any length: every word of the benchmark.
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    size = F.char_length("word")
    listed = words.select("word", ((size % 5 - 2) / F.lit(2.0)).alias("polarity"), ((size % 3) / F.lit(2.0)).alias("subjectivity"))
    return rounded(lexicon_sentiment(t.documents, listed))


@query(
    "keep_last_per_key",
    """SELECT user_id, event_type, event_id, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(t):
    rows = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    return S.keep_last(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "dict_last_wins",
    "SELECT l_partkey, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS price FROM lineitem GROUP BY 1",
)
def _(t):
    rows = t.lineitem.withColumn("price", F.col("l_extendedprice"))
    return S.dict_last_wins(rows, ["l_partkey"], "price", ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"])


@query(
    "first_per_group",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER
       (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) = 1""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return S.first_per(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


ROUTED_SQL = """
    SELECT d.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'success' ELSE 'failures' END AS outcome,
           CASE WHEN quality IS NULL THEN 'no_label' WHEN quality = 0 THEN 'low_quality' WHEN toxic = 1 THEN 'toxic' END AS reason
    FROM documents d LEFT JOIN labels l USING (doc_id)
"""


def labelled(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality", "toxic")


def by_label(rows):
    return route_outcome(
        rows,
        (F.col("quality") == 1) & (F.col("toxic") == 0),
        {"no_label": F.col("quality").isNull(), "low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1},
    ).select("doc_id", "outcome", "reason")


def routed(t):
    return by_label(labelled(t))


@query("route_outcome", ROUTED_SQL)
def _(t):
    from pagemill.session import scratch_path
    from pagemill.sources.sinks import write_routed

    path = scratch_path(t.spark, "routed")
    write_routed(routed(t), path)
    return t.spark.read.schema("doc_id bigint, reason string, outcome string").json(path).select("doc_id", "outcome", "reason")


@query("outcome_counts", f"SELECT outcome, reason, count(*) AS n FROM ({ROUTED_SQL}) GROUP BY ALL")
def _(t):
    return outcome_counts(routed(t), ["outcome", "reason"])


@query("stream_outcomes", f"SELECT outcome, count(*) AS n FROM ({ROUTED_SQL}) GROUP BY outcome")
def _(t):
    """Documents that land in several files, a batch for each; the counts are those kept beside the records."""
    from pagemill.session import scratch_path
    from pagemill.streaming import flows as T

    landed, out, metrics, checkpoint = (scratch_path(t.spark, n) for n in ("landed", "routed", "metrics", "checkpoint"))
    rows = labelled(t)
    rows.repartition(3, "doc_id").write.parquet(landed)
    T.stream_outcomes(T.read_landed(t.spark, landed, rows.schema, files_per_batch=1), by_label, out, metrics, checkpoint)
    counts = T.read_outcome_metrics(t.spark, metrics).agg(F.sum("success").alias("success"), F.sum("failures").alias("failures"))
    return counts.unpivot([], ["success", "failures"], "outcome", "n").where("n > 0")
