"""Elements as intervals, spanned cells and main texts, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.operators import density as D
from pagemill.operators import grid as G
from pagemill.operators import intervals as I


def pages(spark, *htmls):
    return spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id int, html string")


def intervals_of(tokens):
    """``pos, tag, depth, parent, end_pos, n_inside`` of tokens like ``<p>``, ``</p>`` or text."""
    stack, done = [], []
    for pos, tok in enumerate(tokens):
        if not tok.startswith("<"):
            continue
        tag, kept = tok.strip("</>"), len(stack)
        if tok.startswith("</"):
            for i in reversed(range(len(stack))):
                if stack[i][1] == tag:
                    kept = i
                    break
        elif stack and stack[-1][1] == tag and tag in I.REPEATED:
            kept -= 1
        done += [(*e, pos) for e in stack[kept:]]
        del stack[kept:]
        if not tok.startswith("</"):
            element = (pos, tag, len(stack), stack[-1][0] if stack else None)
            if tag in I.VOID:
                done.append((*element, pos + 1))
            else:
                stack.append(element)
    done += [(*e, len(tokens)) for e in stack]
    return sorted(((*e, sum(e[0] < d[0] < e[4] for d in done)) for e in done), key=lambda e: e[0])


@pytest.fixture(scope="module")
def tangled():
    """Tags in any order: unclosed, closed twice, void and repeated ones."""
    rng = random.Random(7)
    tags = ["div", "p", "b", "br", "li", "td"]
    made = []
    for n in [*range(25), 300, 700]:
        toks = []
        while len(toks) < n:
            toks.append(rng.choice(["<%s>", "<%s>", "</%s>"]) % rng.choice(tags))
            if rng.random() < 0.3:
                toks.append("text")
        made.append(toks)
    return made


def test_intervals(spark, tangled):
    got = I.node_intervals(pages(spark, *map("".join, tangled))).orderBy("page_id", "pos").collect()
    wanted = [(i, *e) for i, toks in enumerate(tangled) for e in intervals_of(toks)]
    assert [tuple(r) for r in got] == wanted
    assert len(wanted) > 500


def test_descendants(spark, tangled):
    got = I.descendants(pages(spark, *map("".join, tangled)), outer="div", inner="p").collect()
    wanted = []
    for i, toks in enumerate(tangled):
        found = intervals_of(toks)
        wanted += [
            (i, a[0], d[0], "p", d[2] - a[2]) for a in found for d in found if a[1] == "div" and d[1] == "p" and a[0] < d[0] < a[4]
        ]
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert wanted


def test_elements_by_class(spark):
    df = pages(spark, '<div class="a x"><p>1<p class=y>2</div><div class="ax"><p class="y">3</p></div>', None, "", "text only")
    assert [tuple(r) for r in I.element_texts(df, cls="x").collect()] == [(0, 0, "12")]
    got = I.descendants(df, outer="DIV", outer_class="x", inner_class="y").collect()
    assert [tuple(r) for r in got] == [(0, 0, 3, "p", 1)]
    assert {r.page_id for r in I.node_intervals(df).collect()} == {0}


def test_intervals_agree_with_element_with(spark):
    html = "<div><div class='a box'>x<div>y</div>z<br></div>w</div>"
    df = pages(spark, html)
    assert I.element_texts(df, "div", "box").first().text == "xyz"
    assert df.select(H.clean_text(H.element_with(F.col("html"), "div", "class", "box")).alias("t")).first().t == "xyz"


def test_intervals_need_no_shuffle(spark):
    plan = I.descendants(pages(spark, "<p>"), "div", "p")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def grid_of(rows):
    """Texts at (row, col) of rows of ``(text, rowspan, colspan)``."""
    held, cells = {}, {}
    for r, row in enumerate(rows):
        at = 0
        for text, down, right in row:
            while (r, at) in held:
                at += 1
            for c in range(at, at + right):
                if (r, c) not in held:
                    for below in range(r, min(r + (down or 10**6), len(rows))):
                        held[below, c] = text
            at += right
    for (r, c), text in held.items():
        if r < len(rows):
            cells[r, c] = text
    return cells


def test_spans(spark):
    rng = random.Random(3)
    tables = []
    for _ in range(40):
        tables.append(
            [[(f"t{rng.random():.6f}", rng.choice([1, 1, 2, 3, 0]), rng.choice([1, 1, 2, 3])) for _ in range(rng.randrange(5))]
             for _ in range(rng.randrange(1, 7))]
        )
    htmls = [
        "<table>" + "".join(
            "<tr>" + "".join(f"<td rowspan={down} colspan='{right}'>{text}</td>" for text, down, right in row) + "</tr>"
            for row in table
        ) + "</table>"
        for table in tables
    ]
    got = {(r.page_id, r.row, r.col): r.text for r in G.grid_cells(pages(spark, *htmls)).collect()}
    assert got == {(i, *at): text for i, table in enumerate(tables) for at, text in grid_of(table).items()}


@pytest.mark.parametrize(
    "attribute, n",
    [("", 1), ("colspan", 1), ("colspan=x", 1), ("colspan=''", 1), ("colspan='2x'", 2), ("colspan=0", 1), ("colspan=+3", 3),
     ("colspan=-3", 1), ("colspan=99999999999999999999", 1000), ("COLSPAN = '002'", 2)],
)
def test_span_values(spark, attribute, n):
    df = pages(spark, f"<table><tr><td {attribute}>x</td></tr></table>")
    assert G.grid_cells(df).count() == n


def test_cells_cleaned_together(spark):
    """Empty cells, rows without cells, entities, the marks between cells, and texts with spans in them."""
    def grid(html):
        return {(r.row, r.col): r.text for r in G.grid_cells(pages(spark, html)).collect()}

    start = "<table><tr><th>  a\n b </th><th></th></tr><tr></tr><tr><td> </td><td> x < y </td></tr>"
    cells = {(0, 0): "a b", (0, 1): "", (2, 0): "", (2, 1): "x"}
    assert grid(f"{start}</table>") == cells
    assert grid(f"{start}<tr><td>&lt;&#1;&amp;</td><td>rowspan=2</td></tr></table>") == cells | {(3, 0): "<\x01&", (3, 1): "rowspan=2"}
    assert grid(f"{start}<tr><td>m\x01n</td><td>\x02</td></tr></table>") == cells | {(3, 0): "m\x01n", (3, 1): "\x02"}


def test_cells_of_plain_rows_are_not_searched_for_spans(spark):
    """Fast ways for rows: the text of all cells at once, spans only where a row names one, columns at once."""
    plan = G.with_grid(pages(spark, "<table></table>"), ["page_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i)(?:row|col)span" in plan


def test_grid_without_tables(spark):
    df = pages(spark, None, "", "<p>none</p>", "<table></table>", "<table><tr></tr></table>")
    assert G.grid_cells(df).count() == 0
    assert G.grid_table_rows(df, ["A"], keep=["page_id"]).count() == 0


def test_spanned_headers(spark):
    df = pages(
        spark,
        "<table><tr><th colspan=2>A</th><th>B</th></tr><tr><td rowspan=2>1</td><td>2</td><td>3</td></tr>"
        "<tr><td>4</td><td>5</td></tr><tr><td>6</td></tr></table>",
    )
    got = G.grid_table_rows(df, ["A", "B", "C"]).collect()
    assert [tuple(r) for r in got] == [("1", "3", None), ("1", "5", None), ("6", None, None)]


def run_of(scores):
    best = (0, 0, -1)
    for last in range(len(scores)):
        for first in reversed(range(last + 1)):
            total = sum(scores[first : last + 1])
            if total > best[0]:
                best = (total, first, last)
    return best


def test_best_run(spark):
    rng = random.Random(5)
    lists = [[], [0], [-1, -2], [3], [2, -2, 2], *([rng.randrange(-4, 5) for _ in range(n)] for n in range(40))]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lists)], "i int, s array<bigint>")
    got = df.select("i", D.best_run(F.col("s")).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) for r in got] == [run_of(s) for s in lists]


def test_main_text(spark):
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>to page {i}</a></li>" for i in range(9)) + "</ul>"
    body = ["word " * 30 + f"part {i}" for i in range(3)]
    text = "".join(f"<div>{b} <a href='/x'>link</a> <script>no</script></div>" for b in body)
    df = pages(spark, f"<body>{menu}<div>{text}<div>Ad.</div>{text}</div>{menu}<div>Imprint</div></body>", menu, None, "")
    rows = D.main_text(df).orderBy("page_id").collect()
    lines = [f"{b} link" for b in body]
    assert rows[0].text == "\n".join([*lines, "Ad.", *lines])
    assert rows[0].n_blocks == 7
    assert [(r.text, r.score, r.n_blocks) for r in rows[1:]] == [(None, 0, 0)] * 3
