"""Queries over pages, and over HTML rendered from the other tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.operators import extract as X
from pagemill.operators import nodes as N
from pagemill.operators.rows import dealt, each
from pagemill.plans.registry import query

# The same clean-up in DuckDB.
NOISE_SQL = r"""regexp_replace({c}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')"""


# The entities of the test pages and what they stand for; `&amp;` last, so that nothing is decoded twice.
DECODED = [
    ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]


def decode_sql(c: str) -> str:
    for entity, char in DECODED:
        c = f"replace({c}, '{entity}', '{char}')"
    return c


def clean_sql(c: str) -> str:
    """Tags out, entities decoded, whitespace collapsed."""
    return f"trim(regexp_replace({decode_sql(f"regexp_replace({c}, '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))"


NODES_SQL = f"""
    SELECT page_id, unnest(toks) AS tok, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos
    FROM (SELECT page_id, regexp_extract_all({NOISE_SQL.format(c='html')}, '<[^>]*>|[^<]+') AS toks FROM pages)
"""
LINKS_SQL = rf"""
    SELECT page_id, url, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos,
           nullif(regexp_extract(unnest(a), '(?i)<a\b[^>]*\bhref="([^"]*)"', 1), '') AS href,
           {clean_sql('unnest(a)')} AS text
    FROM (SELECT page_id, url, regexp_extract_all({NOISE_SQL.format(c='html')}, '(?is)<a\b[^>]*>.*?</a\s*>') AS a FROM pages)
"""


def map_rows(df, name: str):
    """Maps as ``page_id, key, value`` rows, to compare them."""
    return each(df, ["page_id"], F.map_entries(name), "e").select("page_id", "e.key", "e.value")


@query("scan_pages", "SELECT page_id, url, html, CAST(200 AS INTEGER) AS status FROM pages")
def _(t):
    from pagemill.sources.readers import read_corpus

    return read_corpus(t.spark, t.path("pages")).select("page_id", "url", "html", "status")


@query(
    "page_nodes",
    rf"""SELECT page_id, pos, tok,
           CASE WHEN tok NOT LIKE '<%' THEN 'text' WHEN tok LIKE '</%' THEN 'close'
                WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 'open' ELSE 'other' END AS kind,
           nullif(lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)), '') AS tag,
           nullif(regexp_extract(tok, '^<[^>]*\bclass="([^"]*)"', 1), '') AS class,
           nullif(regexp_extract(tok, '^<[^>]*\bhref="([^"]*)"', 1), '') AS href,
           CASE WHEN tok NOT LIKE '<%' THEN {decode_sql('tok')} END AS text
        FROM ({NODES_SQL})""",
)
def _(t):
    return N.page_nodes(t.pages)


@query(
    "nodes_by_tag",
    rf"""SELECT tag, count(*) AS n_nodes, count(DISTINCT page_id) AS n_pages FROM (
           SELECT page_id, lower(regexp_extract(tok, '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM ({NODES_SQL})
           WHERE regexp_matches(tok, '^<[A-Za-z]')) GROUP BY tag""",
)
def _(t):
    opened = N.select_nodes(N.page_nodes(t.pages))
    # Per page first: no page or tag is ever gathered in one task.
    per_page = opened.groupBy("tag", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("tag").agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_pages"))


@query(
    "nodes_by_class",
    rf"""SELECT page_id, pos, tok FROM ({NODES_SQL}) WHERE regexp_matches(tok, '^<div class="ad"')""",
)
def _(t):
    return N.select_nodes(N.page_nodes(t.pages), tag="div", cls="ad").select("page_id", "pos", "tok")


@query(
    "extract_links",
    f"SELECT page_id, pos, href, text FROM ({LINKS_SQL}) WHERE contains(text, 'th')",
)
def _(t):
    return X.extract_links(t.pages, text_like="th")


@query(
    "link_hrefs",
    rf"""SELECT page_id, pos, nullif(regexp_extract(tok, 'href="([^"]*)"', 1), '') AS href
        FROM ({NODES_SQL}) WHERE regexp_matches(tok, '(?i)^<a[\s>]')""",
)
def _(t):
    return N.link_target(N.page_nodes(t.pages))


@query("first_link_per_page", f"SELECT page_id, href, text FROM ({LINKS_SQL}) WHERE pos = 0")
def _(t):
    return X.first_link(t.pages)


@query(
    "options_dimension",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer",
)
def _(t):
    # Every customer is a page with one option in the wanted list and one in another.
    html = F.concat(
        F.lit('<form><select id="other"><option value="x">no</option></select><select name="f" id="researchfield"><option value="'),
        F.col("c_custkey").cast("string"), F.lit('">'), F.col("c_name"), F.lit("</option></select></form>"),
    )
    return X.options_dimension(dealt(t.customer).select(html.alias("html")), "researchfield")


def _row(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"<tr><th> {label} </th><td>"), value.cast("string"), F.lit("</td></tr>\n"))


def part_page() -> Column:
    """A label/value page with a row without header cell and a repeated label."""
    return F.concat(
        F.lit('<html><script>var x="</table>";</script><table class="x"><tr><th>Title:</th><td>no</td></tr></table>'),
        F.lit('<table border="0" class="wide pubDisplay"><tr><td>no header</td></tr>'),
        _row("Title:", F.col("p_name")),
        _row("Author(s):", F.col("p_brand")),
        _row("Keywords:", F.col("p_type")),
        _row("Pages:", F.col("p_size")),
        F.lit('<tr><th>DOI:</th><td> <a class="d" href="http://doi.example.org/'),
        F.col("p_partkey").cast("string"),
        F.lit('">link</a></td></tr>'),
        _row("Title:", F.lit("second title")),
        F.lit("</table></html>"),
    )


def part_pages(t):
    return dealt(t.part).select(F.col("p_partkey").alias("page_id"), part_page().alias("html"))


@query(
    "label_value_rows",
    """SELECT p_partkey AS page_id, 0 AS pos, 'Title:' AS label, p_name AS value, CAST(NULL AS VARCHAR) AS href FROM part
       UNION ALL SELECT p_partkey, 1, 'Author(s):', p_brand, NULL FROM part
       UNION ALL SELECT p_partkey, 2, 'Keywords:', p_type, NULL FROM part
       UNION ALL SELECT p_partkey, 3, 'Pages:', CAST(p_size AS VARCHAR), NULL FROM part
       UNION ALL SELECT p_partkey, 4, 'DOI:', 'link', 'http://doi.example.org/' || p_partkey FROM part""",
)
def _(t):
    return X.label_value_rows(part_pages(t))


@query(
    "label_value_pivot",
    """SELECT p_partkey AS page_id, p_name AS title, p_brand AS authors, p_type AS keywords,
              CAST(p_size AS VARCHAR) AS pages, 'http://doi.example.org/' || p_partkey AS doi,
              CAST(NULL AS VARCHAR) AS volume FROM part""",
)
def _(t):
    labels = {
        "title": "Title:", "authors": "Author(s):", "keywords": "Keywords:", "pages": "Pages:",
        "doi": "DOI:", "volume": "Volume:",
    }
    return X.label_value_pivot(part_pages(t), labels, link_labels=("DOI:",))


@query(
    "label_link_or_text",
    """SELECT p_partkey AS page_id, u.label, CASE WHEN u.label = 'DOI:' THEN 'http://doi.example.org/' || p_partkey
              WHEN u.label = 'Title:' THEN p_name WHEN u.label = 'Author(s):' THEN p_brand
              WHEN u.label = 'Keywords:' THEN p_type ELSE CAST(p_size AS VARCHAR) END AS value
       FROM part, (VALUES ('Title:'), ('Author(s):'), ('Keywords:'), ('Pages:'), ('DOI:')) u(label)""",
)
def _(t):
    return X.label_link(X.label_value_rows(part_pages(t))).drop("pos")


@query(
    "heading_fields",
    rf"""SELECT page_id, nullif({clean_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, '') AS title,
              nullif({clean_sql("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")}, '') AS name FROM pages""",
)
def _(t):
    return X.heading_fields(t.pages, {"title": "title", "name": "h1"})


def profile_page() -> Column:
    return F.concat(
        F.lit('<div class="top"><p>Age: 0</p></div><div class="box fellow-information"><h1>'),
        F.col("c_name"),
        F.lit("</h1><h3>Fellow</h3><h6>Published May 1, 2015</h6><p>"),
        F.col("c_mktsegment"),
        F.lit("</p><p>Nation "),
        F.col("c_nationkey").cast("string"),
        F.lit("<p>Town of "),
        F.col("c_custkey").cast("string"),
        F.lit("</p><p class='a'><b>Age:</b> "),
        F.col("c_custkey").cast("string"),
        F.lit(" years</p><p>more</p></div>"),
    )


@query(
    "anchor_neighbours",
    """SELECT c_custkey AS page_id, CAST(c_custkey AS VARCHAR) AS age, 'Town of ' || c_custkey AS location,
              'Nation ' || c_nationkey AS school, c_mktsegment AS designation FROM customer""",
)
def _(t):
    pages = t.customer.select(F.col("c_custkey").alias("page_id"), profile_page().alias("html"))
    inside = pages.withColumn("html", H.element_with(F.col("html"), "div", "class", "fellow-information"))
    return X.anchor_neighbours(inside, "Age", ["location", "school", "designation"], anchor="age")


@query(
    "enumerate_map",
    f"SELECT page_id, 'photo_' || pos AS key, 'https://www.example.org' || href AS value FROM ({LINKS_SQL})",
)
def _(t):
    hrefs = F.transform(X.link_array(H.strip_noise(F.col("html"))), lambda a: a["href"])
    mapped = t.pages.select("page_id", X.enumerate_map(hrefs, "photo_", "https://www.example.org").alias("m"))
    return map_rows(mapped, "m")


SECTION_SQL = rf"""
    SELECT page_id, array_to_string(list_filter(list_transform(
             list_filter(string_split(regexp_extract({NOISE_SQL.format(c='html')}, '(?s)</h1>(.*?)</article>', 1), '<p>')[2:],
                         lambda p: {{only}}),
             lambda p: {clean_sql('p')}), lambda p: p <> ''), ' ') AS section
    FROM pages
"""


@query("take_while_section", SECTION_SQL.replace("{only}", "true"))
def _(t):
    return X.take_while_section(t.pages)


@query("section_filtered", SECTION_SQL.replace("{only}", "starts_with(p, '<b>')"))
def _(t):
    return X.take_while_section(
        t.pages, through=("p", "img"), stop_class=None, stop_summaries=(), only=lambda p: p.rlike(r"(?i)^<p[^>]*><b>")
    )


def order_timeline() -> Column:
    def row(key: str, a: Column, b: Column) -> Column:
        return F.concat(
            F.lit(f"<tr><td>{key}</td><td> "), a.cast("string"), F.lit(" </td><td><i>"), b.cast("string"), F.lit("</i></td></tr>")
        )

    return F.concat(
        F.lit('<table summary="x"><tr><td>a</td><td>b</td><td>c</td></tr></table>'
              '<table summary="a brief autobiography of it"><tr><td>h</td><td>h</td><td>h</td></tr><tr><th>head</th></tr>'),
        row("status", F.lit("first"), F.lit("try")),
        row("customer", F.col("o_custkey"), F.col("o_orderkey")),
        F.lit("<tr><td>short</td></tr>"),
        row("status", F.col("o_orderstatus"), F.col("o_orderpriority")),
        F.lit("</table>"),
    )


@query(
    "table_to_map",
    """SELECT o_orderkey AS page_id, 'status' AS key, o_orderstatus || '; ' || o_orderpriority AS value FROM orders
       UNION ALL SELECT o_orderkey, 'customer', o_custkey || '; ' || o_orderkey FROM orders""",
)
def _(t):
    pages = t.orders.select(F.col("o_orderkey").alias("page_id"), order_timeline().alias("html"))
    return map_rows(X.table_to_map(pages, "brief autobiography"), "timeline")


@query(
    "colon_label",
    """SELECT s_suppkey AS page_id, s_name AS field, CAST(s_nationkey AS VARCHAR) AS contribution,
              CAST(NULL AS VARCHAR) AS absent FROM supplier""",
)
def _(t):
    html = F.concat(
        F.lit("<div><p>Field: no</p><p><strong> Field: </strong> "), F.col("s_name"),
        F.lit("<p><strong>Contribution:</strong>"), F.col("s_nationkey").cast("string"), F.lit(" : rest</p></div>"),
    )
    pages = t.supplier.select(F.col("s_suppkey").alias("page_id"), html.alias("html"))
    return pages.select(
        "page_id",
        X.colon_label(F.col("html"), "Field:").alias("field"),
        X.colon_label(F.col("html"), "Contribution:").alias("contribution"),
        X.colon_label(F.col("html"), "Absent:").alias("absent"),
    )


@query(
    "title_block",
    """SELECT s_suppkey AS page_id, s_name AS prize_title, 'with ' || s_nationkey AS co_winners FROM supplier""",
)
def _(t):
    html = F.concat(
        F.lit('<div class="a laureate_prize_title"><span>'), F.col("s_name"), F.lit("</span>\n  with "),
        F.col("s_nationkey").cast("string"), F.lit(" \nlast</div>"),
    )
    return t.supplier.select(F.col("s_suppkey").alias("page_id"), X.title_block(html).alias("b")).select("page_id", "b.*")


@query(
    "text_line_n",
    r"""SELECT doc_id, trim(string_split(text, chr(10))[2]) AS line FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", X.text_line(F.col("text"), 1).alias("line"))


@query(
    "article_extract",
    rf"""SELECT p.page_id, p.url,
              coalesce(nullif({clean_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, ''),
                       nullif({clean_sql("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")}, '')) AS title,
              nullif(regexp_extract(html, '<html lang="([A-Za-z-]+)"', 1), '') AS lang,
              s.section AS text, CAST(NULL AS VARCHAR) AS authors, CAST(NULL AS VARCHAR) AS published,
              CAST(NULL AS VARCHAR) AS top_image, '' AS images, '' AS keywords, coalesce(l.links, '') AS links, '' AS videos, '' AS tags
        FROM pages p JOIN ({SECTION_SQL.replace("{only}", "true")}) s USING (page_id)
        LEFT JOIN (SELECT page_id, string_agg(href, ' ' ORDER BY pos) AS links FROM ({LINKS_SQL}) GROUP BY page_id) l USING (page_id)""",
)
def _(t):
    found = X.article_extract(t.pages)
    lists = ("images", "keywords", "links", "videos", "tags")
    return found.select(*[F.array_join(c, " ").alias(c) if c in lists else F.col(c) for c in found.columns])


@query("html_table_rows", """SELECT s_suppkey AS page_id, s_name AS "Owner", CAST(s_suppkey AS VARCHAR) AS "Schema",
                                  CAST(NULL AS VARCHAR) AS "Absent" FROM supplier
       UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR), NULL FROM supplier""")
def _(t):
    html = F.concat(
        F.lit("<p>x</p><table><thead><tr><th> Schema</th><th>Owner </th><th>Comment</th></tr></thead><tbody><tr><td>"),
        F.col("s_suppkey").cast("string"), F.lit("</td><td>"), F.col("s_name"),
        F.lit("</td><td></td></tr><tr><td> "), F.col("s_nationkey").cast("string"),
        F.lit(" </td><td>nation</td><td>c</td></tr></tbody></table>"),
    )
    pages = t.supplier.select(F.col("s_suppkey").alias("page_id"), html.alias("html"))
    return X.html_table_rows(pages, ["Schema", "Owner", "Absent"], keep=["page_id"])


@query(
    "marker_status",
    """SELECT page_id, CASE WHEN contains(url, 'page=2') THEN 'missing' WHEN contains(html, 'Sorry') THEN 'end'
              WHEN contains(html, '&amp;') THEN 'escaped' WHEN contains(html, '<h1></h1>') THEN 'untitled'
              ELSE 'ok' END AS status,
              CASE WHEN NOT contains(url, 'page=2') AND NOT contains(html, 'Sorry') AND NOT contains(html, '&amp;')
                   AND NOT contains(html, '<h1></h1>') THEN url END AS usable_url FROM pages""",
)
def _(t):
    landed = t.pages.withColumn("code", F.when(F.contains("url", F.lit("page=2")), 404).otherwise(200))
    markers = {"Sorry": "end", "&amp;": "escaped", "<h1></h1>": "untitled"}
    judged = landed.withColumn("status", X.marker_status(F.col("html"), markers, F.col("code")))
    return judged.select("page_id", "status", F.when(F.col("status") == "ok", F.col("url")).alias("usable_url"))


@query(
    "tag_counts",
    rf"""SELECT page_id, count(*) FILTER (tag = 'p') AS n_p, count(*) FILTER (tag = 'b') AS n_b,
              count(*) FILTER (tag = 'a') AS n_a, count(*) FILTER (tag = 'div') AS n_div FROM (
           SELECT page_id, lower(regexp_extract(tok, '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM ({NODES_SQL}))
        GROUP BY page_id""",
)
def _(t):
    return N.tag_counts(t.pages, ["p", "b", "a", "div"])


@query(
    "tag_count_filter",
    rf"""SELECT * FROM (SELECT page_id, count(*) FILTER (tag = 'p') AS n_p, count(*) FILTER (tag = 'b') AS n_b,
              count(*) FILTER (tag = 'table') AS n_table FROM (
           SELECT page_id, lower(regexp_extract(tok, '^<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM ({NODES_SQL}))
        GROUP BY page_id) WHERE n_p >= 5 AND n_b >= 2 AND n_table = 0""",
)
def _(t):
    return N.tag_count_filter(t.pages, {"p": 5, "b": 2}, ["table"])


def mail_blocks(t):
    """Customers as pages of five nodes, in which the classes occur as often as the key says."""
    key = F.col("c_custkey")

    def spans(cls: str, n: Column) -> Column:
        return F.repeat(F.lit(f'<span class="x {cls} {cls}">t</span>'), n.cast("int"))

    html = F.concat(
        F.lit("<!-- <div class='c2'></div> --><div class='c2 c0'><p class=c10>"), spans("c2", key % 4), F.lit("</p></div> <i class='c4'>stray</i> <DIV class=\"c5\">"),
        spans("c4", key % 3), spans("c2", key % 5), F.lit("</DIV><table CLASS = 'c12'><tr><td class='c9'>"), spans("c9", key % 2),
        F.lit("</td></tr></table><div>"), F.repeat(F.lit("<p class='c10'>b</p>"), (key % 6).cast("int")), spans("c4", key % 2), F.lit("</div><div>none</div>"),
    )
    return t.customer.select(key.alias("page_id"), html.alias("html"))


CLASS_SQL = """
    SELECT page_id, node, CAST(n_c2 AS BIGINT) AS n_c2, CAST(n_c4 AS BIGINT) AS n_c4, CAST(n_c9 AS BIGINT) AS n_c9, CAST(n_c10 AS BIGINT) AS n_c10 FROM (
              SELECT c_custkey AS page_id, 0 AS node, 1 + c_custkey % 4 AS n_c2, 0 AS n_c4, 0 AS n_c9, 1 AS n_c10 FROM customer
    UNION ALL SELECT c_custkey, 1, c_custkey % 5, c_custkey % 3, 0, 0 FROM customer
    UNION ALL SELECT c_custkey, 2, 0, 0, 1 + c_custkey % 2, 0 FROM customer
    UNION ALL SELECT c_custkey, 3, 0, c_custkey % 2, 0, c_custkey % 6 FROM customer
    UNION ALL SELECT c_custkey, 4, 0, 0, 0, 0 FROM customer)
"""


@query("class_counts", CLASS_SQL)
def _(t):
    return N.class_counts(mail_blocks(t), ["c2", "c4", "c9", "c10"])


@query("class_count_filter", f"SELECT page_id, node, n_c4, n_c9 FROM ({CLASS_SQL}) WHERE n_c4 >= 1 AND n_c9 = 0")
def _(t):
    return N.class_count_filter(mail_blocks(t), {"c4": 1}, ["c9"])


@query(
    "attribute_values",
    """SELECT c_custkey AS page_id, 'real' || c_custkey AS href, CASE WHEN c_custkey % 2 = 0 THEN 'a > b' END AS title FROM customer""",
)
def _(t):
    key = F.col("c_custkey").cast("string")
    tag = F.concat(
        F.lit("<a data-href='no' disabled alt=\"see href=foo title='bar'\" hrefs=no HREF = real"), key,
        F.when(F.col("c_custkey") % 2 == 0, F.lit(' title="a > b">')).otherwise(F.lit(" title=''>")),
    )
    return t.customer.select(F.col("c_custkey").alias("page_id"), H.attr(tag, "href").alias("href"), H.attr(tag, "title").alias("title"))


@query(
    "zip_two_extracts",
    rf"""SELECT page_id, unnest(list_transform(list_zip(regexp_extract_all(html, 'href="([^"]*)"', 1),
              regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)), lambda x: x[1] || ':' || x[2])) AS pair FROM pages""",
)
def _(t):
    pairs = X.zip_extracts(F.col("html"), 'href="([^"]*)"', r"<a [^>]*>([^<]*)</a>")
    return each(t.pages, ["page_id"], pairs, "pair").drop("pos")


@query(
    "reconcile_counts",
    rf"""SELECT count(*) FILTER (tok = '<article>') AS n_bodies, count(*) FILTER (tok = '<h1>') AS n_titles,
              count(*) FILTER (tok LIKE '<a %') AS n_links FROM ({NODES_SQL})""",
)
def _(t):
    opened = F.col("kind") == "open"
    return N.reconcile_counts(
        N.page_nodes(t.pages),
        n_bodies=opened & (F.col("tag") == "article"),
        n_titles=opened & (F.col("tag") == "h1"),
        n_links=opened & (F.col("tag") == "a"),
    )


@query(
    "fanout_two_outputs",
    rf"""SELECT 'summary' AS output, page_id, nullif({clean_sql("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")}, '') AS title,
              CAST(NULL AS VARCHAR) AS link FROM pages
        UNION ALL SELECT 'media', page_id, text, href FROM ({LINKS_SQL}) WHERE pos = 0""",
)
def _(t):
    from pagemill.session import scratch_path
    from pagemill.sources.sinks import fan_out

    # A page is parsed once, then its fields are dealt out.
    anchor = F.get(X.link_array(H.strip_noise(F.col("html"))), F.lit(0))
    parsed = X.heading_fields(t.pages.withColumn("first", anchor), {"title": "h1"}, keep=("page_id", "first"))
    outputs = {
        "summary": F.struct("page_id", "title"),
        "media": F.when(F.col("first").isNotNull(), F.struct("page_id", F.col("first.text").alias("title"), F.col("first.href").alias("link"))),
    }
    root = scratch_path(t.spark, "fanout")
    fan_out(parsed, outputs, root)
    schema = "page_id bigint, title string, link string"
    return t.spark.read.schema(f"{schema}, output string").json(root).select("output", "page_id", "title", "link")
