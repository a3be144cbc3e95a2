"""Queries for sources, sinks, record generations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators.extract import extract_links
from pagemill.operators.records import FLAT_FIELDS, META_FIELDS, dedup_generations, record_to_json, union_generations
from pagemill.operators.schedule import STATE_SCHEMA, upsert_items
from pagemill.plans import publications
from pagemill.plans.q_flows import PDF_BASE, PUBLICATION_SQL, publication_columns, publication_inputs
from pagemill.plans.q_pages import LINKS_SQL
from pagemill.plans.q_text import NOW, now
from pagemill.plans.q_windows import UPSERT_SQL, customer_state, order_requests, plain_state
from pagemill.plans.registry import query
from pagemill.session import scratch_path, staged
from pagemill.sources import readers as R
from pagemill.sources import sinks as K
from pagemill.sources.state import create_state, expire, fold, read_state
from pagemill.streaming import flows as T


@query("scan_seed_csv", """SELECT CAST(c_custkey AS INTEGER) AS research_id, c_name || ', "' || c_nationkey || '" & more' AS research_name FROM customer""")
def _(t):
    seeds = t.customer.select(
        F.col("c_custkey").cast("int").alias("research_id"),
        F.concat("c_name", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('" & more')).alias("research_name"),
    )
    path = scratch_path(t.spark, "seed")
    K.write_csv(seeds, path)
    return R.read_seed(t.spark, path)


@query(
    "json_explode_nested",
    """SELECT l_orderkey, l_returnflag AS category, CAST(year(l_shipdate) AS VARCHAR) AS year, CAST(l_partkey AS VARCHAR) AS id,
              CAST(l_linenumber AS VARCHAR) AS share, 'part' AS firstname FROM lineitem
       UNION ALL SELECT l_orderkey, l_returnflag, CAST(year(l_shipdate) AS VARCHAR), CAST(l_suppkey AS VARCHAR), NULL, 'supplier' FROM lineitem
       UNION ALL SELECT l_orderkey, l_linestatus, NULL, CAST(l_suppkey AS VARCHAR), NULL, NULL FROM lineitem""",
)
def _(t):
    # Every row becomes a list document with two prizes and three people.
    def text(c):
        return F.col(c).cast("string")

    def prize(category, year, *people):
        return F.struct(category.alias("category"), year.alias("year"), F.array(*people).alias("laureates"))

    def person(pid, share, first):
        return F.struct(pid.alias("id"), share.alias("share"), first.alias("firstname"))

    none = F.lit(None).cast("string")
    doc = F.struct(
        "l_orderkey",
        F.array(
            prize(
                F.col("l_returnflag"), F.year("l_shipdate").cast("string"),
                person(text("l_partkey"), text("l_linenumber"), F.lit("part")),
                person(text("l_suppkey"), none, F.lit("supplier")),
            ),
            prize(F.col("l_linestatus"), none, person(text("l_suppkey"), none, none)),
        ).alias("prizes"),
    )
    path = scratch_path(t.spark, "lists")
    t.lineitem.select(F.to_json(doc)).write.text(path)
    landed = R.read_nested_json(t.spark, path, "l_orderkey bigint, " + R.LIST_SCHEMA, multi_line=False)
    return R.explode_list(landed, keep=["l_orderkey"]).select("l_orderkey", "category", "year", "id", "share", "firstname")


@query(
    "json_first_element",
    """SELECT c_custkey AS id, c_name AS gender, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS VARCHAR) END AS "bornCity",
              CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS affiliation FROM customer""",
)
def _(t):
    segment = F.col("c_mktsegment")
    affiliations = (
        F.when(segment == "BUILDING", F.lit("[[]]"))
        .when(segment == "MACHINERY", F.lit('""'))
        .otherwise(F.concat(F.lit('[{"name": "'), segment, F.lit('"}]')))
    )
    born = F.when(segment == "BUILDING", F.lit("")).otherwise(
        F.concat(F.lit('"bornCity": "'), F.col("c_nationkey").cast("string"), F.lit('", '))
    )
    doc = F.concat(
        F.lit('{"laureates": [{"gender": "'), F.col("c_name"), F.lit('", '), born,
        F.lit('"prizes": [{"affiliations": '), affiliations, F.lit('}]}, {"gender": "second"}]}'),
    )
    found = R.first_detail(t.customer.select(F.col("c_custkey").alias("id"), doc.alias("doc")), "doc", keep=["id"])
    return found.select("id", "gender", "bornCity", F.get("affiliations", F.lit(0))["name"].alias("affiliation"))


@query("event_props", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def _(t):
    return R.parse_json(t.events, "props", "k bigint", "p").select("event_id", "p.k")


@query(
    "attachment_inventory",
    """SELECT doc_id || '.v1.pdf' AS file_name, doc_id || '.v1' AS record_id, n_chars AS n_bytes, CASE WHEN doc_id % 3 <> 0 THEN text END AS text FROM documents""",
)
def _(t):
    """Documents as attachment files; every third was never turned into text."""
    key = F.col("doc_id").cast("string")
    files = t.documents.select(F.concat(F.lit("s3://landed/pdf/"), key, F.lit(".v1.pdf")).alias("path"), F.col("n_chars").alias("length"))
    texts = t.documents.where("doc_id % 3 <> 0").select(F.concat(key, F.lit(".v1")).alias("record_id"), "text")
    return R.attach_text(R.inventory(files), texts).select("file_name", "record_id", "n_bytes", "text")


@query(
    "pair_list_explode",
    """SELECT c_custkey, 0 AS pos, c_name AS item, CAST(c_acctbal AS VARCHAR) AS value FROM customer
       UNION ALL SELECT c_custkey, 1, c_mktsegment, CAST(c_nationkey AS VARCHAR) FROM customer
       UNION ALL SELECT c_custkey, 2, 'bare', NULL FROM customer""",
)
def _(t):
    pairs = F.concat(
        F.lit(" "), F.col("c_name"), F.lit(","), F.col("c_acctbal").cast("string"), F.lit("  "), F.col("c_mktsegment"),
        F.lit(","), F.col("c_nationkey").cast("string"), F.lit(" bare "),
    )
    return R.pair_list(t.customer.select("c_custkey", pairs.alias("pairs")), "pairs", keep=["c_custkey"])


def generations(t):
    """Orders as records: all in the flat shape, finished ones in the nested shape as well."""
    key = F.col("o_orderkey").cast("string")
    url = F.concat(F.lit("http://www.example.org/"), key)
    title = F.concat(F.lit("Order "), key)
    flat = {
        "url": url, "title": title, "published": F.date_format("o_orderdate", "MMMM d, yyyy"),
        "pdf_text": F.col("o_orderpriority"), "volume": F.col("o_orderstatus"),
    }
    old = t.orders.select(*[flat.get(f, F.lit("")).alias(f) for f in FLAT_FIELDS])
    meta = {"volume": F.col("o_orderstatus"), "pages": F.col("o_custkey").cast("string")}
    new = t.orders.where("o_orderstatus = 'F'").select(
        F.lit("").alias("abstract"),
        X.external_id(title, "src_").alias("external_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        url.alias("url"),
        F.concat(F.lit("new "), F.col("o_orderpriority")).alias("words"),
        F.struct(F.struct(*[meta.get(f, F.lit("")).alias(f) for f in META_FIELDS]).alias("source")).alias("meta"),
    )
    return old, new


OLD_SQL = """SELECT 'http://www.example.org/' || o_orderkey AS url, 'Order ' || o_orderkey AS title, strftime(o_orderdate, '%B %-d, %Y') AS published,
       o_orderpriority AS pdf_text, o_orderstatus AS volume, '' AS pages, 1 AS generation FROM orders"""
NEW_SQL = """SELECT 'http://www.example.org/' || o_orderkey AS url, 'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS published,
       'new ' || o_orderpriority AS pdf_text, o_orderstatus AS volume, CAST(o_custkey AS VARCHAR) AS pages, 2 AS generation
       FROM orders WHERE o_orderstatus = 'F'"""
RECORD_COLUMNS = ["url", "title", "published", "pdf_text", "volume", "pages", "generation"]


@query("records_union_generations", f"{OLD_SQL} UNION ALL {NEW_SQL}")
def _(t):
    return union_generations(*generations(t), "source", "src_").select(*RECORD_COLUMNS)


@query("read_mixed_records", f"{OLD_SQL} UNION ALL {NEW_SQL}")
def _(t):
    old, new = generations(t)
    folder = scratch_path(t.spark, "records")
    texts = [df.select(record_to_json(F.struct("*")).alias("value")) for df in (old, new)]
    texts[0].unionByName(texts[1]).write.text(folder)
    return R.read_records(t.spark, folder, "source", "src_").select(*RECORD_COLUMNS)


@query(
    "generation_dedup",
    f"""SELECT * FROM ({OLD_SQL} WHERE o_orderstatus <> 'F' UNION ALL {NEW_SQL}) WHERE url NOT LIKE '%7'
        UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS url) FROM ({OLD_SQL} UNION ALL {NEW_SQL}) WHERE url LIKE '%7'""",
)
def _(t):
    # Records of every tenth order have no address.
    both = union_generations(*generations(t), "source", "src_")
    some = both.withColumn("url", F.when(~F.col("url").endswith("7"), F.col("url")))
    return dedup_generations(some.unionByName(some.where("url is not null"))).select(*RECORD_COLUMNS)


@query(
    "record_to_json",
    """SELECT o_orderkey, '{"abstract":"' || o_orderpriority || '","external_id":"o-' || o_orderkey || '","date":' ||
              CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || strftime(o_orderdate, '%Y-%m-%d') || '"' END ||
              ',"meta":{"source":{"volume":' || o_custkey || '}}}' AS record FROM orders""",
)
def _(t):
    day = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    record = F.struct(
        F.col("o_orderpriority").alias("abstract"),
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("external_id"),
        day.alias("date"),
        F.struct(F.struct(F.col("o_custkey").alias("volume")).alias("source")).alias("meta"),
    )
    return t.orders.select("o_orderkey", record_to_json(record).alias("record"))


@query(
    "json_sink_compat",
    """SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE '' END AS segment,
              CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END END AS name,
              '["' || CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE '' END || '","x"]' AS list FROM customer""",
)
def _(t):
    path = scratch_path(t.spark, "compat")
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    inner = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    nested = F.struct(F.when(F.col("c_custkey") % 3 != 0, inner).alias("source"), F.array(segment, F.lit("x")).alias("list"))
    K.write_json(t.customer.select("c_custkey", segment.alias("segment"), nested.alias("meta")), path, compat=True)
    read = t.spark.read.schema(
        "c_custkey bigint, segment string, meta struct<source struct<name string>, list array<string>>"
    ).json(path)
    return read.select("c_custkey", "segment", "meta.source.name", F.to_json("meta.list").alias("list"))


@query(
    "csv_roundtrip",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '  ' || text || chr(10) || '"quoted", ' || lang || chr(9) WHEN 1 THEN '' WHEN 2 THEN NULL ELSE text END AS text,
              CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE source END AS source FROM documents""",
)
def _(t):
    key, nothing = F.col("doc_id"), F.lit(None).cast("string")
    padded = F.concat(F.lit("  "), F.col("text"), F.lit('\n"quoted", '), F.col("lang"), F.lit("\t"))
    rows = t.documents.select(
        "doc_id",
        F.when(key % 4 == 0, padded).when(key % 4 == 1, F.lit("")).when(key % 4 == 2, nothing).otherwise(F.col("text")).alias("text"),
        F.when(key % 5 == 0, F.lit("")).when(key % 5 == 1, nothing).when(key % 5 == 2, F.lit(" ")).otherwise(F.col("source")).alias("source"),
    )
    path = scratch_path(t.spark, "csv")
    K.write_csv(rows, path)
    return K.read_csv(t.spark, path, rows.schema)


@query("state_roundtrip", "SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' AS done FROM orders")
def _(t):
    state = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("done"))
    schema = "o_orderkey bigint, o_totalprice double, done boolean"
    root = scratch_path(t.spark, "state")
    before = R.read_work_table(t.spark, f"{root}/version=0", schema)
    path = K.write_work_table(before.unionByName(state), root, 1)
    return R.read_work_table(t.spark, path, schema)


def landed(t, name, **options):
    """A table as a stream, be it one file or a folder of them: of a folder every file counts, and a path with a pattern may be either."""
    return T.read_landed(t.spark, f"{t.dir}/{{{name}}}.parquet", getattr(t, name).schema, **options)


@query("stream_pages", f"SELECT page_id, pos, href, text FROM ({LINKS_SQL})")
def _(t):
    out = scratch_path(t.spark, "links")
    T.stream_rows(landed(t, "pages"), extract_links, out, scratch_path(t.spark, "checkpoint"))
    return t.spark.read.parquet(out)


@query("stream_dedup_links", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    timed = landed(t, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    # Events span a month, so nothing is forgotten within the delay.
    once = T.stream_dedup(timed, ["user_id", "event_type"], "ts", "40 days")
    out = scratch_path(t.spark, "once")
    T.stream_rows(once, lambda df: df.select("user_id", "event_type"), out, scratch_path(t.spark, "checkpoint"))
    return t.spark.read.parquet(out)


def folded(t, plans=None):
    """The work table after the orders that landed: the root of its state."""
    root = scratch_path(t.spark, "work")
    create_state(customer_state(t), root, "domain", 16)
    T.stream_upsert(order_requests(landed(t, "orders", files_per_batch=None)), root, scratch_path(t.spark, "checkpoint"), now(), ["o_orderkey"], plans)
    return root


@query("stream_upsert", UPSERT_SQL)
def _(t):
    return plain_state(read_state(t.spark, folded(t), STATE_SCHEMA))


@query("state_fold", UPSERT_SQL)
def _(t):
    """The same state by two folds, of the orders of every other customer each, into the buckets they touch."""
    root = scratch_path(t.spark, "work")
    create_state(customer_state(t), root, "domain", 16)
    requests = order_requests(t.orders)
    for part in range(2):
        some = requests.where(F.pmod(F.crc32("domain"), F.lit(2)) == part)
        fold(some, root, "domain", STATE_SCHEMA, lambda state, rows: upsert_items(state, rows, now(), ["o_orderkey"]))
    expire(t.spark, root, keep=1)
    return plain_state(read_state(t.spark, root, STATE_SCHEMA))


@query(
    "stream_due_plan",
    f"""WITH o AS (SELECT domain, price, wait_s - (epoch_us(TIMESTAMP '{NOW}') - scraped_us) / 1e6 AS left_s FROM ({UPSERT_SQL}) WHERE NOT done),
             a AS (SELECT *, CASE WHEN left_s < 300 THEN 'now' ELSE 'wait' END AS action FROM o)
        SELECT domain, price, action, left_s, 0.0::DOUBLE AS delay_s FROM a WHERE action = 'now'
        UNION ALL SELECT domain, price, action, left_s,
               (left_s - 300) - coalesce(lag(left_s - 300) OVER (ORDER BY left_s - 300, domain), 0) FROM a WHERE action = 'wait'""",
)
def _(t):
    plans = scratch_path(t.spark, "plans")
    folded(t, plans)
    written = t.spark.read.parquet(R.version_path(plans, 1))
    return written.withColumn("price", F.col("price").cast("double"))


@query("stream_records", PUBLICATION_SQL)
def _(t):
    """Publication pages as they land, with the whole record flow run on each batch."""
    _, texts = publication_inputs(t)

    def records(batch):
        pages, _ = publication_inputs(t, batch)
        fields = staged(publications.publication_fields(pages), "fields")
        return publication_columns(publications.publication_records(fields, texts, PDF_BASE, "source", "src_"))

    out = scratch_path(t.spark, "records")
    T.stream_records(landed(t, "part"), records, out, scratch_path(t.spark, "checkpoint"))
    return T.read_stream_records(t.spark, out)


@query(
    "stream_frontier",
    PUBLICATION_SQL.replace("FROM part)", "FROM part WHERE p_partkey IN (SELECT user_id FROM events WHERE event_type <> 'error'))"),
)
def _(t):
    """Result pages as they land, to links not seen before, to the records of the pages behind them."""
    shown = F.when(F.col("event_type") == "error", F.lit("broken")).otherwise(
        F.concat(F.lit("http://www.example.org/show?pub_id="), F.col("user_id").cast("string"))
    )
    page = F.concat(F.lit('<ul><li><a href="/help">Help</a></li><li><a href="/p">'), shown, F.lit("</a></li></ul>"))
    pages = landed(t, "events").select(page.alias("html"))
    seen, found, out = (scratch_path(t.spark, name) for name in ("seen", "found", "records"))

    def links(batch):
        return extract_links(batch, text_like=publications.LINK_MARK, keys=()).select(F.col("text").alias("link"))

    T.stream_frontier(pages, links, seen, found, scratch_path(t.spark, "checkpoint"), "link", "link string", 16)
    all_pages, texts = publication_inputs(t)

    def records(batch):
        fetched = all_pages.join(batch, F.col("url") == F.col("link")).drop("link")
        fields = staged(publications.publication_fields(fetched), "fields")
        return publication_columns(publications.publication_records(fields, texts, PDF_BASE, "source", "src_"))

    fresh = T.read_landed(t.spark, f"{found}/*", "link string")
    T.stream_records(fresh, records, out, scratch_path(t.spark, "checkpoint"))
    return T.read_stream_records(t.spark, out)
