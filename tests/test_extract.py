"""Page extraction on small pages with the awkward shapes that occur in practice."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions import text as TX
from pagemill.operators import extract as X
from pagemill.operators import nodes as N
from pagemill.operators.sentiment import lexicon_frame
from pagemill.plans import fellows, news


def pages(spark, *htmls):
    return spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id int, html string")


def one(df, *cols):
    row = df.select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


def expr(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first().r


def test_nodes_skip_hidden_markup(spark):
    df = pages(spark, "<p class='a b' >x<script>'</p><p>'</script><!-- <p> --><style>p{}</style>y&amp;z</P><br/>")
    rows = [tuple(r) for r in N.page_nodes(df).select("pos", "kind", "tag", "class", "text").orderBy("pos").collect()]
    assert rows == [
        (0, "open", "p", "a b", None), (1, "text", None, None, "xy&z"), (2, "close", "p", None, None), (3, "open", "br", None, None),
    ]
    assert N.select_nodes(N.page_nodes(df), tag="P", cls="b").count() == 1
    assert N.select_nodes(N.page_nodes(df), cls="c").count() == 0


@pytest.mark.parametrize(
    "tag, value",
    [('<a href="x y">', "x y"), ("<a href='it\"s'>", 'it"s'), ("<a class=c href=/p/1>", "/p/1"), ('<a href="">', None), ("<a data-href='n'>", None),
     ("<A HREF = 'up'>", "up")],
)
def test_attributes(spark, tag, value):
    assert expr(spark, tag, lambda c: H.attr(c, "href")) == value


def test_links_keep_order_and_marker(spark):
    df = pages(spark, '<a href="/1">pub_id=1</a><a name="x">pub_id=2</a><a href="/3"> other </a>', "no links", None)
    assert [tuple(r) for r in X.extract_links(df, "pub_id").collect()] == [(0, 0, "/1", "pub_id=1"), (0, 1, None, "pub_id=2")]
    assert [tuple(r) for r in X.first_link(df).collect()] == [(0, "/1", "pub_id=1")]


@pytest.mark.parametrize(
    "page, inside",
    [
        ('<div><div class="a box">x<div>y</div>z</div>w</div>', '<div class="a box">x<div>y</div>z'),
        ("<div class='box'>x<DIV >y</DIV><div/></div>", "<div class='box'>x<DIV >y</DIV><div/></div>"),
        ('<div class="box"><p>open', '<div class="box"><p>open'),
        ('<div class="boxed">no</div><divx class="box">no</divx>', None),
        (None, None),
    ],
)
def test_container_ends_at_its_own_end_tag(spark, page, inside):
    assert expr(spark, page, lambda c: H.element_with(c, "div", "class", "box")) == inside


def test_label_rows_survive_rows_without_header(spark):
    df = pages(
        spark,
        '<table class="pubDisplay"><tr><td>spacer</td></tr><tr><th>\n Title: </th><td> A  b </td></tr>'
        '<tr><th>Títle:</th><td>later</td></tr><tr><th>DOI:</th><td><a href="http://d">see</a></td></tr><tr><th>Empty:</th><td></td></tr></table>',
    )
    rows = [tuple(r) for r in X.label_value_rows(df).orderBy("pos").collect()]
    assert rows == [(0, 0, "Title:", "A  b", None), (0, 2, "DOI:", "see", "http://d"), (0, 3, "Empty:", "", None)]
    wide = X.label_value_pivot(df, {"t": "Title:", "d": "DOI:", "none": "Volume:"}, link_labels=["DOI:"])
    assert one(wide, "t", "d", "none") == ("A  b", "http://d", None)


SECTION = "<h1>T</h1>lead {} <p>one<br>more</p>\n<img src='x'><table summary='x'><tr><td><p>cell</p></td></tr></table><p class='k'>two{}"


@pytest.mark.parametrize(
    "page, text",
    [
        (SECTION.format("", "</p><h2>x</h2><p>no</p>"), "onemore two"),
        # Running out of siblings is a normal end, also inside an unclosed paragraph.
        (SECTION.format("", ""), "onemore two"),
        (SECTION.format("", "<p>three"), "onemore two three"),
        (SECTION.format("", "</p><br><p>no</p>"), "onemore two"),
        (SECTION.format("", "</p><p><span class='a smalltext'>s</span></p><p>no</p>"), "onemore two"),
        (SECTION.format("", "</p><table summary='References'></table><p>no</p>"), "onemore two"),
        (SECTION.format("<b>x</b>", "</p>"), ""),
        ("<p>no heading</p>", None),
    ],
)
def test_section(spark, page, text):
    assert one(X.take_while_section(pages(spark, page)), "section") == text


def test_section_options(spark):
    df = pages(spark, SECTION.format("", "</p><p class='smalltext'>s</p><p>end</p>"))
    speech = dict(through=("p", "img"), stop_class=None, stop_summaries=())
    assert one(X.take_while_section(df, **speech), "section") == "onemore"
    all_of_it = dict(stop_class=None, stop_summaries=())
    assert one(X.take_while_section(df, **all_of_it), "section") == "onemore two s end"
    assert one(X.take_while_section(df, only=X.has_class_attribute, **all_of_it), "section") == "two s"
    assert one(X.take_while_section(df, sep="", **all_of_it), "section") == "onemoretwosend"


def test_long_pages_do_not_overflow(spark):
    """Regular expressions over long texts must not recurse."""
    body = "".join(f"<p>word{i} <b>x</b>" for i in range(20000))
    df = pages(spark, "<h1>T</h1>" + body, "<h1>T</h1><p>" + "y" * 3_000_000 + "</p>", "<p>" + "<" * 100_000)
    got = X.take_while_section(df).orderBy("page_id").collect()
    assert len(got[0].section.split()) == 40000 and len(got[1].section) == 3_000_000 and got[2].section is None
    assert N.page_nodes(df).where("page_id = 0").count() == 20000 * 5 + 3
    assert X.article_extract(df.withColumn("url", F.lit("u"))).count() == 3
    assert X.anchor_neighbours(df, "word19999", ["a", "b"]).where("page_id = 0").first().a == "word19998 x"


def test_neighbours_of_the_first_paragraph_are_missing(spark):
    df = pages(spark, "<p>Age: 41</p><p>x</p>", "<p>a</p><p>b<p>Age 7 or 8</p>", "<p>none</p>")
    rows = [tuple(r) for r in X.anchor_neighbours(df, "Age", ["l", "s"]).orderBy("page_id").collect()]
    assert rows == [(0, "41", None, None), (1, "7", "b", "a"), (2, None, None, None)]


def test_timeline_last_row_wins(spark):
    df = pages(
        spark,
        "<table summary='a brief autobiography'><tr><td>1</td></tr><tr><td>2</td></tr><tr><td>1901</td><td>b</td><td>é</td></tr>"
        "<tr><td>x</td><td>y</td></tr><tr><td>1901</td><td>c</td><td>d</td></tr></table>",
        "<p>none</p>",
    )
    rows = [r.timeline for r in X.table_to_map(df, "brief autobiography").orderBy("page_id").collect()]
    assert rows == [{"1901": "c; d"}, None]


def test_colon_label(spark):
    page = "<p>Field: no</p><p><strong>Field:</strong> a : b</p>"
    assert expr(spark, page, lambda c: X.colon_label(c, "Field:")) == "a"
    assert expr(spark, page, lambda c: X.colon_label(c, "Other:")) is None


def test_table_without_header(spark):
    df = pages(spark, "<table><tr><td>1</td></tr></table>", "<table><tr><th>A</th></tr><tr><td>1</td></tr></table>")
    got = X.html_table_rows(df, ["A"], keep=["page_id"]).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(0, None), (1, "1")]


def test_options(spark):
    df = pages(spark, '<select id="f"><option value="1">A, "b" &amp; c<option value="2"> D </option></select>')
    assert sorted(map(tuple, X.options_dimension(df, "f").collect())) == [("1", 'A, "b" & c'), ("2", "D")]


def test_zip_extracts_pairs_by_position(spark):
    page = "<tr><td>1.2.3.4</td><td>8080</td><td>x</td></tr><tr><td>5.6.7.8</td><td>3</td><td>y</td></tr>"
    got = expr(spark, page, lambda c: X.zip_extracts(c, r"<tr><td>(.*?)</td><td>", r"</td><td>(\d{1,5})</td><td>"))
    assert got == ["1.2.3.4:8080", "5.6.7.8:3"]


@pytest.mark.parametrize(
    "text, ascii_text",
    [("plain", "plain"), ("Ångström façade", "Angstrom facade"), ("Straße “Œuvre” – naïve…", 'Strasse "OEuvre" - naive...'), ("x 中 y", "x [?] y"), ("a b", "a b"), (None, None)],
)
def test_ascii_fold(spark, text, ascii_text):
    assert expr(spark, text, TX.ascii_fold) == ascii_text


def test_entities_are_decoded_once(spark):
    assert expr(spark, "&lt;b&gt; &amp;lt; &quot;x&quot;&nbsp;&copy;", TX.entity_decode) == '<b> &lt; "x" ©'


def test_fellow_pages_end_at_the_first_gap(spark):
    rows = [(i, f"u{i}", "Sorry" if i == 4 else "<p>x</p>") for i in (1, 2, 3, 4, 5, 7)]
    df = spark.createDataFrame(rows, "fellow_id int, url string, html string")
    assert sorted(r.fellow_id for r in fellows.profiles_until_end(df).collect()) == [1, 2, 3]
    assert fellows.profiles_until_end(df, start=6).count() == 0


def news_export(*parts):
    return "".join(parts)


def block(cls, *spans, tag="div"):
    return f'<{tag} class="{cls}"><p class="c1">' + "".join(f'<span class="{c}">{t}</span>' for c, t in spans) + f"</p></{tag}>\n<br>"


def test_news_segmentation(spark):
    first = news_export(
        "<!-- Hide <div class='c5'>x</div> -->", block("c0", ("c2", "73 of 998 DOCUMENTS")), block("c0", ("c2", "74 of 998 DOCUMENTS")),
        "<table class='c12'><tr><td>before</td></tr></table>", block("c3", ("c2", "Daily")), block("c3", ("c4", "July"), ("c2", " 11, 1991, Thursday")),
        block("c3", ("c4", "no date")), block("c5", ("c7", "Old")), block("c5", ("c7", "Earnings: "), ("c8", "up")), block("c5", ("c9", "LENGTH: "), ("c2", "317 words")),
        block("c5", ("c2", "only c2")), block("c5", ("c4", "not good"), ("c2", ", best.")), block("c11", ("c2", "end")),
    )
    open_end = news_export(block("c0", ("c2", "75 of 998 DOCUMENTS")), block("c5", ("c4", "a"), ("c2", "b")))
    df = spark.createDataFrame([("f", first + open_end), ("closed", first), ("empty", "<p>none</p>")], "file_id string, html string")
    got = {(r.file_id, r.doc_no): r for r in news.news_documents(df, lexicon_frame(spark)).collect()}
    assert sorted(got) == [("closed", 0), ("f", 0), ("f", 1)]
    doc = got["f", 0]
    assert (doc.num_words, doc.email_title, doc.date_time, doc.document_idx, doc.newspaper_title) == (
        317, "Earnings: up", "1991-07-11T00:00:00", "74 of 998 DOCUMENTS", "Daily",
    )
    assert doc.body == "before not good, best."
    assert doc.polarity == pytest.approx((0.7 * -0.5 + 1.0) / 2) and doc.subjectivity == pytest.approx((0.6 + 0.3) / 2)
    assert (got["f", 1].newspaper_title, got["f", 1].body, got["f", 1].polarity) == ("ab", "ab", 0.0)


def test_paper_title_far_from_its_header(spark):
    tables = "".join(f"<table class='c1'><tr><td>{i}</td></tr></table>" for i in range(30))
    df = spark.createDataFrame([("f", block("c0", ("c2", "1 of 2 DOCUMENTS")) + tables + block("c3", ("c2", "Far")))], "file_id string, html string")
    assert news.news_documents(df, lexicon_frame(spark)).first().newspaper_title == "Far"


def test_both_news_readers_agree(spark):
    """Files read as a row each, and files read by many tasks with hot files cut into blocks."""
    from pagemill.session import scratch_path
    from pagemill.sources.readers import read_export, read_export_blocks

    def doc(i):
        return news_export(
            block("c0", ("c2", f"{i} of 998 DOCUMENTS")), block("c3", ("c2", f"Paper {i % 7}")), block("c3", ("c4", "July"), ("c2", f" {i % 28 + 1}, 1991")),
            block("c5", ("c7", f"Title {i}")), block("c5", ("c9", "LENGTH: "), ("c2", f"{i} words")),
            *[block("c5", ("c4", f"no good {i}"), ("c2", f" part {k} é")) for k in range(i % 4)],
            f"<table class='c12'><tr><td>cell &amp; {i}</td></tr></table> worst stray <b>{i}</b>" if i % 3 else " worst stray", block("c11", ("c2", "end")) if i % 50 else "",
        )

    path = scratch_path(spark, "exports")
    big = [("".join(doc(i) for i in range(1, 240)),)]
    small = [(doc(i),) for i in range(300, 306)]
    spark.createDataFrame(big + small, "value string").repartition(7, "value").write.option("maxRecordsPerFile", 1).text(path)
    whole = news.news_documents(read_export(spark, path), lexicon_frame(spark))
    blocks = scratch_path(spark, "blocks")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 9000)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        pieces = read_export_blocks(spark, path)
        assert pieces.rdd.getNumPartitions() > 10
        pieces.write.parquet(blocks)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert spark.read.parquet(blocks).select("file_id", "file_start").distinct().count() > 10
    cut = news.news_documents_from_blocks(spark.read.parquet(blocks), lexicon_frame(spark), rows_per_block=200)
    columns = [c for c in whole.columns if c not in ("polarity", "subjectivity")]
    # Four documents of the long file are not closed and run into the next.
    assert whole.count() == 239 - 4 + 6
    assert sorted(map(repr, cut.select(columns).collect())) == sorted(map(repr, whole.select(columns).collect()))
    scores = [F.round("polarity", 9), F.round("subjectivity", 9)]
    assert sorted(map(tuple, cut.select(scores).collect())) == sorted(map(tuple, whole.select(scores).collect()))
