"""Queries over elements as intervals, tables with spanned cells, and main texts by density."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import density as D
from pagemill.operators import grid as G
from pagemill.operators import intervals as I
from pagemill.plans.q_pages import NODES_SQL, NOISE_SQL, clean_sql
from pagemill.plans.registry import query

VOID_SQL = ", ".join(f"'{tag}'" for tag in I.VOID)
REPEATED_SQL = ", ".join(f"'{tag}'" for tag in I.REPEATED)

# The stack of open elements after every token, one step of the recursion for each position of a page.
STACKS_SQL = rf"""
    toks AS MATERIALIZED (SELECT page_id, pos, tok, nullif(lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)), '') AS tag FROM ({NODES_SQL})),
    marks AS MATERIALIZED (SELECT page_id, CAST(pos AS INTEGER) AS pos, tag, tok NOT LIKE '</%' AS opens,
                 row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k
              FROM toks WHERE tag IS NOT NULL AND tag NOT IN ({VOID_SQL})),
    sizes AS MATERIALIZED (SELECT page_id, CAST(count(*) AS INTEGER) AS n FROM toks GROUP BY page_id),
    stacks AS (
        SELECT page_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS INTEGER) AS here, CAST([] AS STRUCT(pos INTEGER, tag VARCHAR)[]) AS stack FROM sizes
      UNION ALL
        SELECT s.page_id, m.k, m.pos,
               CASE WHEN m.opens AND m.tag IN ({REPEATED_SQL}) AND len(s.stack) > 0 AND s.stack[len(s.stack)].tag = m.tag
                      THEN list_append(s.stack[1:len(s.stack) - 1], {{'pos': m.pos, 'tag': m.tag}})
                    WHEN m.opens THEN list_append(s.stack, {{'pos': m.pos, 'tag': m.tag}})
                    WHEN list_contains(list_transform(s.stack, lambda e: e.tag), m.tag)
                      THEN s.stack[1:len(s.stack) - list_position(list_reverse(list_transform(s.stack, lambda e: e.tag)), m.tag)]
                    ELSE s.stack END
        FROM stacks s JOIN marks m ON m.page_id = s.page_id AND m.k = s.k + 1),
    -- An element is open from the step that begins it to the step that no longer has it.
    spans AS (
        SELECT page_id, k, here, stack, lead(here) OVER (PARTITION BY page_id ORDER BY k) AS next FROM stacks),
    ends AS (
        SELECT page_id, e.pos AS pos, CASE WHEN count(*) FILTER (next IS NULL) = 0 THEN max(next) END AS end_pos
        FROM (SELECT page_id, next, unnest(stack) AS e FROM spans) GROUP BY ALL),
    open_elements AS (
        SELECT s.page_id, s.here AS pos, s.stack[len(s.stack)].tag AS tag, CAST(len(s.stack) - 1 AS INTEGER) AS depth,
               CASE WHEN len(s.stack) > 1 THEN s.stack[len(s.stack) - 1].pos END AS parent, coalesce(e.end_pos, n) AS end_pos
        FROM spans s JOIN ends e ON e.page_id = s.page_id AND e.pos = s.here JOIN sizes z ON z.page_id = s.page_id),
    void_elements AS (
        SELECT t.page_id, CAST(t.pos AS INTEGER) AS pos, t.tag, CAST(len(s.stack) AS INTEGER) AS depth,
               CASE WHEN len(s.stack) > 0 THEN s.stack[len(s.stack)].pos END AS parent, CAST(t.pos + 1 AS INTEGER) AS end_pos
        FROM toks t JOIN spans s ON s.page_id = t.page_id AND s.here < t.pos AND (s.next IS NULL OR s.next > t.pos)
        WHERE t.tag IN ({VOID_SQL}) AND t.tok NOT LIKE '</%'),
    found AS MATERIALIZED (SELECT * FROM open_elements UNION ALL SELECT * FROM void_elements)
"""


@query(
    "node_intervals",
    f"""WITH RECURSIVE {STACKS_SQL}
        SELECT page_id, pos, tag, depth, parent, end_pos, CAST((SELECT count(*) FROM found d
            WHERE d.page_id = f.page_id AND d.pos > f.pos AND d.pos < f.end_pos) AS INTEGER) AS n_inside FROM found f""",
)
def _(t):
    return I.node_intervals(t.pages)


@query(
    "descendants",
    f"""WITH RECURSIVE {STACKS_SQL}
        SELECT a.page_id, a.pos AS outer_pos, d.pos, d.tag, d.depth - a.depth AS level
        FROM found a JOIN found d ON d.page_id = a.page_id AND d.pos > a.pos AND d.pos < a.end_pos
        WHERE a.tag = 'article' AND d.tag = 'p'""",
)
def _(t):
    return I.descendants(t.pages, outer="article", inner="p")


@query(
    "element_texts",
    f"""WITH RECURSIVE {STACKS_SQL}
        SELECT f.page_id, f.pos, {clean_sql("coalesce(string_agg(t.tok, '' ORDER BY t.pos), '')")} AS text
        FROM found f LEFT JOIN toks t ON t.page_id = f.page_id AND t.pos > f.pos AND t.pos < f.end_pos
        WHERE f.tag = 'p' GROUP BY f.page_id, f.pos""",
)
def _(t):
    return I.element_texts(t.pages, "p")


def order_tables(t):
    """Every order as a page: its key spans the rows of its items, the total two columns, the headers two rows."""
    item = F.concat(
        F.lit("<td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td class='q'>"),
        F.col("l_partkey").cast("string"), F.lit("</td>"),
    )
    # Every second line holds its supplier for two rows, as far as there are two.
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("cells"), F.col("l_suppkey").alias("supplier")))),
        lambda r, i: F.struct(
            F.concat(r["cells"], F.when(i % 2 == 0, F.concat(F.lit("<td ROWSPAN = '2'>"), r["supplier"].cast("string"), F.lit("</td>"))).otherwise("")).alias("cells")
        ),
    )
    orders = t.lineitem.groupBy("l_orderkey").agg(rows.alias("rows"), F.count("*").alias("n"))
    key = F.col("l_orderkey").cast("string")
    body = F.array_join(
        F.transform(
            "rows",
            lambda r, i: F.concat(
                F.lit("<tr>"),
                F.when(i == 0, F.concat(F.lit('<td rowspan="'), F.col("n").cast("string"), F.lit('">'), key, F.lit("</td>"))).otherwise(""),
                r["cells"], F.lit("</tr>"),
            ),
        ),
        "",
    )
    # The last supplier of an odd number of rows would reach into the total, which then begins before it.
    html = F.concat(
        F.lit("<table><tr><th rowspan=2>Order</th><th colspan=2>Item</th><th rowspan='2'>Supplier</th></tr><tr><th>Line</th><th>Part</th></tr>"),
        body, F.lit("<tr><td>total</td><td colspan='2'>"), F.col("n").cast("string"), F.lit("</td></tr></table>"),
    )
    return orders.select(F.col("l_orderkey").alias("page_id"), html.alias("html"))


ORDER_LINES_SQL = """
    SELECT l_orderkey AS page_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, '<td>' || l_linenumber || '</td><td class=''q''>' || l_partkey || '</td>', l_suppkey) AS k,
           count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
"""
SUPPLIERS_SQL = f"SELECT a.*, b.supplier AS held FROM ({ORDER_LINES_SQL}) a JOIN ({ORDER_LINES_SQL}) b ON a.page_id = b.page_id AND b.k = a.k - (a.k + 1) % 2"


@query(
    "grid_cells",
    f"""WITH rows AS ({SUPPLIERS_SQL})
        SELECT page_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, text FROM (
            SELECT DISTINCT page_id, unnest([0, 0, 0, 0, 1, 1, 1, 1]) AS r, unnest([0, 1, 2, 3, 0, 1, 2, 3]) AS c,
                   unnest(['Order', 'Item', 'Item', 'Supplier', 'Order', 'Line', 'Part', 'Supplier']) AS text FROM rows
            UNION ALL SELECT page_id, k + 1, 0, CAST(page_id AS VARCHAR) FROM rows
            UNION ALL SELECT page_id, k + 1, 1, CAST(line AS VARCHAR) FROM rows
            UNION ALL SELECT page_id, k + 1, 2, CAST(part AS VARCHAR) FROM rows
            UNION ALL SELECT page_id, k + 1, 3, CAST(held AS VARCHAR) FROM rows
            UNION ALL SELECT page_id, n + 2, 0, 'total' FROM rows WHERE k = n
            UNION ALL SELECT page_id, n + 2, 1, CAST(n AS VARCHAR) FROM rows WHERE k = n
            UNION ALL SELECT page_id, n + 2, 2, CAST(n AS VARCHAR) FROM rows WHERE k = n
            UNION ALL SELECT page_id, n + 2, 3, CAST(held AS VARCHAR) FROM rows WHERE k = n AND n % 2 = 1)""",
)
def _(t):
    return G.grid_cells(order_tables(t))


@query(
    "grid_table_rows",
    f"""WITH rows AS ({SUPPLIERS_SQL})
        SELECT page_id, CAST(page_id AS VARCHAR) AS "Order", CAST(line AS VARCHAR) AS "Item", CAST(held AS VARCHAR) AS "Supplier" FROM rows
        UNION ALL SELECT page_id, 'total', CAST(n AS VARCHAR), CASE WHEN n % 2 = 1 THEN CAST(held AS VARCHAR) END FROM rows WHERE k = n""",
)
def _(t):
    return G.grid_table_rows(order_tables(t), ["Order", "Item", "Supplier"], keep=["page_id"])


UNMARKED = r"(?i)<(/?)(?:article|h1|nav|footer)\b[^>]*>"
LINKED_SQL = r"array_to_string(regexp_extract_all(piece, '(?is)<a\b[^>]*>.*?</a\s*>'), ' ')"


@query(
    "main_text",
    rf"""WITH pieces AS (
            SELECT page_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
                SELECT page_id, string_split_regex({NOISE_SQL.format(c=f"regexp_replace(html, '{UNMARKED}', '<{chr(92)}1div>', 'g')")}, '{D.BLOCK_BORDER}') AS p FROM pages)),
        counted AS (
            SELECT page_id, i, {clean_sql('piece')} AS text,
                   len(regexp_extract_all({clean_sql('piece')}, '\S+')) AS words,
                   len(regexp_extract_all({clean_sql(LINKED_SQL)}, '\S+')) AS linked FROM pieces),
        own AS (
            SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS b, text, words - {D.LINK_COST} * linked - {D.BLOCK_COST} AS s
            FROM counted WHERE words > 0),
        smooth AS (
            SELECT page_id, b, text, coalesce(lag(s) OVER w, 0) + 2 * s + coalesce(lead(s) OVER w, 0) AS s FROM own WINDOW w AS (PARTITION BY page_id ORDER BY b)),
        sums AS (
            SELECT page_id, b, sum(s) OVER (PARTITION BY page_id ORDER BY b) AS upto, sum(s) OVER (PARTITION BY page_id ORDER BY b) - s AS before FROM smooth),
        runs AS (
            SELECT x.page_id, y.b AS first, x.b AS last, x.upto - y.before AS score FROM sums x JOIN sums y ON x.page_id = y.page_id AND y.b <= x.b),
        best AS (
            SELECT * FROM runs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, last, first DESC) = 1)
        SELECT p.page_id, string_agg(m.text, chr(10) ORDER BY m.b) AS text, CAST(coalesce(any_value(best.score), 0) AS BIGINT) AS score,
               CAST(count(m.b) AS INTEGER) AS n_blocks
        FROM pages p LEFT JOIN best USING (page_id) LEFT JOIN smooth m ON m.page_id = best.page_id AND m.b BETWEEN best.first AND best.last
        GROUP BY p.page_id""",
)
def _(t):
    plain = F.regexp_replace("html", UNMARKED, "<$1div>")
    return D.main_text(t.pages.select("page_id", plain.alias("html")))
