"""Pieces of pages cut by one pattern, and steps that look at a text or make a row once."""

import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.text import let, non_empty, space_collapse, ws_collapse
from pagemill.operators.extract import take_while_section
from pagemill.plans import q_flows
from pagemill.plans.catalogue import QUERIES


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


PAGES = [
    "", "text", "<p>a<p b>c</p >d</P>e<P>", "<p", "<p <p>x</p>", "a<pre>x</pre><p\n>y", "<p>é\U0001f600<b>z</b", "<p>\n</p>\n<P class='x'>q",
    "<div><table x>y</table> out <div >in</DIV\n>z<divx>n</divx><table>", "<!-- <div>a</div> --><div>b", "<DIV>a<script>'</div>'</script>c</div>",
]


@pytest.mark.parametrize("page", PAGES)
def test_pieces_are_those_of_a_split(spark, page):
    opened = [p for p in re.split(r"(?i)(?=<p[\s>])", page) if re.match(r"(?i)<p[\s>]", p)]
    assert one(spark, page, H.paragraphs) == [re.split(r"(?i)</p\s*>", p, maxsplit=1)[0] for p in opened]
    cleaned = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "", page)
    opened = [b for b in re.split(r"(?i)(?=<(?:div|table)[\s>])", cleaned) if re.match(r"(?i)<(?:div|table)[\s>]", b)]
    assert one(spark, page, H.blocks_of) == [re.split(r"(?i)</(?:div|table)\s*>", b, maxsplit=1)[0] for b in opened]


def test_long_pages_need_no_deep_stack(spark):
    page = "<h1>t</h1>" + "<p>a <b>b</b> <i>c</i></p>\n" * 50_000
    assert one(spark, page, lambda v: F.size(H.paragraphs(v))) == 50_000
    assert one(spark, "<p>" + "<b>x</b>" * 200_000, lambda v: F.size(H.paragraphs(v))) == 1
    text = take_while_section(spark.createDataFrame([(1, page)], "page_id int, html string")).first().section
    assert text == " ".join(["a b c"] * 50_000)


@pytest.mark.parametrize(
    ("html", "through", "expected"),
    [
        ("<h1>t</h1>", ("p", "img", "table"), ""),
        ("<h1>t</h1>lead<p>a</p>tail<p>b", ("p", "img", "table"), "a b"),
        ("<h1>t</h1>lead<b>x</b><p>a</p>", ("p", "img", "table"), ""),
        ("<h1>t</h1><p>a</p><b>x</b><p>b</p>", ("p", "img", "table"), "a"),
        ("<h1>t</h1><p>a<P CLASS=\"y smalltext\">b</p><p>c</p>", ("p", "img", "table"), "a"),
        ("<h1>t</h1><p>a</p><TABLE summary='References'><p>no</p></TABLE><p>b</p>", ("p", "img", "table"), "a"),
        ("<h1>t</h1><p>a</p><table title='References'><p>no</p></table><p>b</p>", ("p", "img", "table"), "a b"),
        ("<h1>t</h1><p>a</p><table><tr></tr></table><p>b</p>", ("p", "img"), "a"),
        ("<h1>t</h1><p>a</p><img src='x'><p>b</p><pre>c</pre><p>d</p>", ("p", "img"), "a b"),
        ("<h1>t</h1><img><p>a</p>", ("img",), ""),
        ("<p>a</p>", ("p",), None),
        (None, ("p",), None),
    ],
)
def test_a_section_ends_at_its_first_other_sibling(spark, html, through, expected):
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert take_while_section(pages, through=through).first().section == expected


@pytest.mark.parametrize("text", ["", " ", "a b", " a\t\tb \n", "a  b", "a\x0bb\r\nc   d", None])
def test_white_space(spark, text):
    wanted = None if text is None else re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")
    assert one(spark, text, ws_collapse) == wanted
    assert one(spark, text, space_collapse) == (None if text is None else re.sub(" +", " ", text).strip(" \t\n\r\x0b\x0c"))
    assert one(spark, text, non_empty) == (text or None)


def test_let_makes_no_array(spark):
    plan = spark.range(1).select(let(F.col("id").cast("string"), lambda v: F.concat(v, v)).alias("x"))
    assert [r.x for r in plan.collect()] == ["00"]
    assert "transform(" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_prize_pages_are_made_in_one_pass(spark, sf, monkeypatch):
    """All pages of a host come from one row of it, dealt out into several tasks for each core."""
    found = {}

    def caught(lists, details, pages, talks, base):
        found["pages"] = pages
        return wanted(lists, details, pages, talks, base)

    wanted = q_flows.prizes.prize_records
    monkeypatch.setattr(q_flows.prizes, "prize_records", caught)
    QUERIES["prize_records"](spark, sf)
    plan = found["pages"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan
    assert found["pages"].rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_exports_are_parsed_once(spark, sf):
    """The scans go on with written tables: neither the files nor the classes of a block are read again for a field."""
    plan = QUERIES["news_export_files"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan.replace("regexp_extract_all(lower(", "")
    assert "Relation [value" not in plan and "class" not in plan
