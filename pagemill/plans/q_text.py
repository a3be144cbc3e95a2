"""Queries for the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import dates as D
from pagemill.functions import text as X
from pagemill.plans.registry import query

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def fold_sql(c: str) -> str:
    """The letters of the test texts, as plain values."""
    c = f"translate({c}, 'éÉçÇäÄóÓèÈñÑêÊíÍüÜöÖ', 'eEcCaAoOeEnNeEiIuUoO')"
    return rf"regexp_replace(replace({c}, 'ß', 'ss'), '[^\x00-\x7F]', '[?]', 'g')"


@query("ws_collapse", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", X.ws_collapse(F.col("text")).alias("text"))


@query("space_collapse", r"SELECT doc_id, regexp_replace(regexp_replace(replace(text, 'e', '  '), ' +', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def _(t):
    spaced = F.replace(F.col("text"), F.lit("e"), F.lit("  "))
    return t.documents.select("doc_id", X.space_collapse(spaced).alias("text"))


@query(
    "newline_to_space",
    "SELECT doc_id, replace(replace(replace(text, '. ', chr(13) || chr(10)), chr(13) || chr(10), ' '), chr(10), ' ') AS text FROM documents",
)
def _(t):
    broken = F.replace(F.col("text"), F.lit(". "), F.lit("\r\n"))
    return t.documents.select("doc_id", X.newline_to_space(broken).alias("text"))


@query("ascii_fold", f"SELECT doc_id, {fold_sql('text')} AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", X.ascii_fold(F.col("text")).alias("text"))


@query(
    "slugify",
    r"SELECT p_partkey, regexp_replace(replace(p_name || ' (' || p_type || ')/é#' || p_size || '.json', ' ', '_'), '[^-_.() A-Za-z0-9]', '', 'g') AS file_name FROM part",
)
def _(t):
    title = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")/é#"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", X.slugify(title).alias("file_name"))


@query(
    "url_template",
    "SELECT o_orderkey, 'http://www.example.org/portal?field=' || o_custkey || '&sortBy=date&page=' || o_orderkey AS url FROM orders",
)
def _(t):
    template = "http://www.example.org/portal?field={field}&sortBy=date&page={page}"
    return t.orders.select("o_orderkey", X.url_template(template, field=F.col("o_custkey"), page=F.col("o_orderkey")).alias("url"))


@query(
    "url_candidates",
    """SELECT s_suppkey, k.kind, 'http://www.example.org/prizes/area' || s_nationkey || '/laureates/' || (1900 + s_suppkey % 100)
              || '/' || lower(s_name) || '-' || k.kind || '.html' AS url
       FROM supplier, (VALUES ('bio'), ('speech'), ('lecture'), ('facts')) k(kind)""",
)
def _(t):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("bio", "speech", "lecture", "facts")]))
    rows = t.supplier.withColumn("kind", kinds)
    url = X.page_kind_url(
        "http://www.example.org/prizes", F.concat(F.lit("area"), F.col("s_nationkey").cast("string")),
        1900 + F.col("s_suppkey") % 100, F.col("s_name"), F.concat(F.lit("-"), F.col("kind"), F.lit(".html")),
    )
    return rows.select("s_suppkey", "kind", url.alias("url"))


@query("external_id", "SELECT p_partkey, 'src_' || replace(p_name, ' ', '-') AS external_id FROM part")
def _(t):
    return t.part.select("p_partkey", X.external_id(F.col("p_name"), "src_").alias("external_id"))


@query("first_digits", r"SELECT page_id, nullif(regexp_extract(url, '\d+', 0), '') AS digits FROM pages")
def _(t):
    return t.pages.select("page_id", X.first_digits(F.col("url")).alias("digits"))


@query("strip_label", "SELECT o_orderkey, o_orderpriority AS value FROM orders")
def _(t):
    labelled = F.concat(F.lit(" LENGTH: "), F.col("o_orderpriority"), F.lit(" "))
    return t.orders.select("o_orderkey", X.strip_label(labelled, "LENGTH:").alias("value"))


@query("contains_ci", "SELECT doc_id, contains(lower(text), 'thes') AS found FROM documents")
def _(t):
    return t.documents.select("doc_id", X.contains_ci(F.col("text"), "Thes").alias("found"))


@query(
    "split_nth",
    "SELECT p_partkey, split_part(p_name, ' ', 2) AS second, split_part(p_brand, '#', 2) AS number, CAST(NULL AS VARCHAR) AS tenth FROM part",
)
def _(t):
    return t.part.select(
        "p_partkey",
        X.split_nth(F.col("p_name"), " ", 1).alias("second"),
        X.split_nth(F.col("p_brand"), "#", 1).alias("number"),
        X.split_nth(F.col("p_name"), " ", 9).alias("tenth"),
    )


@query(
    "share_label",
    """SELECT l_orderkey, l_linenumber, l_partkey, '1/' || l_linenumber AS share, l_linenumber AS denominator,
              CASE WHEN l_returnflag = 'A' THEN '1/' || l_linenumber END AS optional FROM lineitem""",
)
def _(t):
    label = X.share_label(F.col("l_linenumber"))
    either = F.when(F.col("l_returnflag") == "A", label).otherwise(F.col("l_linenumber").cast("string"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", label.alias("share"),
        X.share_denominator(either).alias("denominator"),
        X.share_label(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber"))).alias("optional"),
    )


@query(
    "recode_value",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'machines' ELSE c_mktsegment END AS segment FROM customer",
)
def _(t):
    return t.customer.select("c_custkey", X.recode_value(F.col("c_mktsegment"), {"MACHINERY": "machines"}).alias("segment"))


@query(
    "default_fill",
    """SELECT c_custkey, coalesce(max(o_orderpriority), '') AS priority, coalesce(max(o_orderstatus), ' ') AS status
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def _(t):
    per_customer = t.orders.groupBy("o_custkey").agg(
        F.max("o_orderpriority").alias("priority"), F.max("o_orderstatus").alias("status")
    )
    joined = t.customer.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        "c_custkey", X.default_fill(F.col("priority")).alias("priority"), X.default_fill(F.col("status"), " ").alias("status")
    )


@query(
    "sentinel_to_null",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    written = F.when(F.col("o_orderstatus") == "P", F.lit(D.NO_DATE)).otherwise(day)
    return t.orders.select("o_orderkey", D.sentinel_to_null(written).alias("day"))


@query(
    "parse_date_iso",
    r"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS iso,
              CASE WHEN o_orderkey % 5 = 4 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS range_start FROM orders""",
)
def _(t):
    day = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.date_format(day, "MMMM d, yyyy"))
        .when(kind == 1, F.date_format(day, "MMMM dd, yyyy"))
        .when(kind == 2, F.date_format(day, "d MMMM yyyy"))
        .when(kind == 3, F.date_format(day, "yyyy-MM-dd"))
        # A range is no date; only its first day can be told.
        .otherwise(F.concat(F.date_format(day, "MMMM d"), F.lit("-31, "), F.date_format(day, "yyyy")))
    )
    return t.orders.select("o_orderkey", D.parse_date_iso(text).alias("iso"), D.range_start(text).alias("range_start"))


@query(
    "extract_date_fuzzy",
    r"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS iso FROM orders""",
)
def _(t):
    day = F.col("o_orderdate")
    spoken = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Held on Thursday, "), F.date_format(day, "d MMMM yyyy"), F.lit(" in town")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.date_format(day, "MMMM d, yyyy"), F.lit(", Thursday, FINAL EDITION")))
        .otherwise(F.concat(F.lit("Some day in "), F.date_format(day, "MMMM yyyy")))
    )
    return t.orders.select("o_orderkey", D.extract_date_fuzzy(spoken).alias("iso"))


@query(
    "duration_seconds",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              CAST(604800 + l_quantity * 86400 + l_linenumber * 3600 + (l_partkey % 60) * 60 + 5 AS BIGINT) AS seconds FROM lineitem""",
)
def _(t):
    text = F.concat(
        F.lit("1w "), F.col("l_quantity").cast("int").cast("string"), F.lit("d "), F.col("l_linenumber").cast("string"),
        F.lit("h "), (F.col("l_partkey") % 60).cast("string"), F.lit("m 2s 3s"),
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", D.duration_seconds(text).alias("seconds"))


EVENT_LEFT_SQL = f"(value * 36000.0 - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6)"


def event_left():
    return D.remaining_seconds(F.col("value") * 36000.0, F.col("ts"), now())


@query("remaining_seconds", f"SELECT event_id, {EVENT_LEFT_SQL} AS left_s FROM events")
def _(t):
    return t.events.select("event_id", event_left().alias("left_s"))


@query(
    "due_bucket",
    f"SELECT event_id, CASE WHEN {EVENT_LEFT_SQL} < 300 THEN 'now' ELSE 'wait' END AS action FROM events",
)
def _(t):
    return t.events.select("event_id", D.due_bucket(event_left()).alias("action"))


@query("url_last_segment", "SELECT page_id, string_split(url, '/')[-1] AS segment FROM pages")
def _(t):
    return t.pages.select("page_id", X.url_last_segment(F.col("url")).alias("segment"))


@query(
    "entity_decode",
    """SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS html FROM pages""",
)
def _(t):
    return t.pages.select("page_id", X.entity_decode(F.col("html")).alias("html"))


# What names and quotations in old pages look like, and what they say.
WRITTEN = [
    ("M&ouml;ller &#8217;s", "Möller ’s"), ("&Eacute;cole d&#39;&eacute;t&#xE9;", "École d'été"), ("a&#160;b&nbsp;c", "a b c"),
    ("&amp;lt; &amp;amp;", "&lt; &amp;"), ("&#x2014;&mdash;&#151;", "———"), ("&#128512; &#x1F600;", "😀 😀"),
    ("AT&T; x & y &unknown; &; &#;", "AT&T; x & y &unknown; &; &#;"), ("&szlig;&AElig;&ntilde;&euro;&hellip;", "ßÆñ€…"), ("&lt;b&gt; &quot;q&quot; &apos;", "<b> \"q\" '"),
]
NAMES = [
    ("Wisława Szymborska", "Wislawa Szymborska"), ("Karel Čapek", "Karel Capek"), ("Doğan Şahin Iğdır", "Dogan Sahin Igdir"), ("Łódź Gdańsk", "Lodz Gdansk"),
    ("Ångström Sørensen Þór", "Angstrom Sorensen Thor"), ("Đoković Ħal", "Dokovic Hal"), ("Œuvre — “naïve” …", 'OEuvre -- "naive" ...'), ("Nguyễn Văn", "Nguyen Van"),
    ("Straße 東京", "Strasse [?][?]"),
]
DATES = [
    ("July 11, 1991, revised 3 May 2000", "1991-07-11T00:00:00"), ("sent 10 Dec 1998 by mail", "1998-12-10T00:00:00"), ("DECEMBER 10, 1998", "1998-12-10T00:00:00"),
    ("on the 2nd of May; 2nd May 2003", "2003-05-02T00:00:00"), ("Sept. 9th 2010 / Sep 1, 2011", "2010-09-09T00:00:00"), ("1 Jan. 2000", "2000-01-01T00:00:00"),
    ("31 February 2000", None), ("Maybe 12, 1999", None), ("June 1999", None), ("none", None),
]


def sql_string(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def literal_rows(table: list[tuple[str, str | None]]) -> str:
    """Every customer with one of the values, as the key says."""
    values = ", ".join(f"({i}, {sql_string(expected)})" for i, (_, expected) in enumerate(table))
    return f"SELECT c_custkey, v.text AS text FROM customer JOIN (VALUES {values}) v(i, text) ON c_custkey % {len(table)} = v.i"


def written(t, table: list[tuple[str, str | None]]):
    texts = F.array(*[F.lit(raw) for raw, _ in table])
    return t.customer.select("c_custkey", F.get(texts, (F.col("c_custkey") % len(table)).cast("int")).alias("raw"))


@query("entity_names", literal_rows(WRITTEN))
def _(t):
    return written(t, WRITTEN).select("c_custkey", X.entity_decode(F.col("raw")).alias("text"))


@query("ascii_fold_names", literal_rows(NAMES))
def _(t):
    return written(t, NAMES).select("c_custkey", X.ascii_fold(F.col("raw")).alias("text"))


@query("first_dates", literal_rows(DATES))
def _(t):
    return written(t, DATES).select("c_custkey", D.extract_date_fuzzy(F.col("raw")).alias("text"))


@query(
    "collection_to_json",
    """SELECT conv_id, turn, '["' || role || '","' || turn || '"]' AS list, '{"' || role || '":"' || turn || '"}' AS map FROM conversations""",
)
def _(t):
    from pagemill.operators.records import collection_to_json

    turn = F.col("turn").cast("string")
    return t.conversations.select(
        "conv_id", "turn",
        collection_to_json(F.array("role", turn)).alias("list"),
        collection_to_json(F.create_map("role", turn)).alias("map"),
    )
