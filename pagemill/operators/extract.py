"""Fields out of pages.

A page is one row, so all of this works on arrays inside the row and never
shuffles.  Only the results are exploded, where rows are what is wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.text import ascii_fold, entity_decode, first_digits, let, non_empty, strip, strip_label
from pagemill.operators.rows import each, present

LINK = r"(?is)<a\b[^>]*>.*?</a\s*>"


def link_array(cleaned: Column) -> Column:
    """Links of a cleaned page in order: ``array<struct<href, text>>``."""
    return F.transform(
        F.regexp_extract_all(cleaned, F.lit(LINK), F.lit(0)),
        lambda a: F.struct(H.attr(a, "href").alias("href"), H.clean_text(a).alias("text")),
    )


def extract_links(
    pages: DataFrame, text_like: str | None = None, keys: Sequence[str] = ("page_id",), html: str = "html"
) -> DataFrame:
    """One row per link, ``keys, pos, href, text``; optionally only texts containing a marker."""
    links = each(pages, keys, link_array(H.strip_noise(F.col(html))), "link").select(
        *keys, "pos", "link.href", "link.text"
    )
    return links if text_like is None else links.where(F.contains("text", F.lit(text_like)))


def first_link(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Only the first link of each page that has one."""
    anchor = F.nullif(F.regexp_extract(H.strip_noise(F.col(html)), LINK, 0), F.lit(""))
    return present(pages, [key], anchor, "a").select(
        key, H.attr(F.col("a"), "href").alias("href"), H.clean_text(F.col("a")).alias("text")
    )


def options_dimension(pages: DataFrame, select_id: str, html: str = "html") -> DataFrame:
    """``<option value=…>name`` pairs of one ``<select>`` as ``id, name`` rows."""
    box = H.element_with(F.col(html), "select", "id", select_id)
    options = F.regexp_extract_all(box, F.lit(r"(?is)<option\b[^>]*>[^<]*"), F.lit(0))
    return each(pages, [], options, "o").select(
        H.attr(F.col("o"), "value").alias("id"), H.clean_text(F.col("o")).alias("name")
    )


def label_entries(html: Column, table_class: str) -> Column:
    """Rows of a label/value table in order: ``array<struct<label, value, href>>``.

    Any row with a header cell and a data cell counts; a row without a header
    cell does not end the search.
    """
    table = H.element_with(html, "table", "class", table_class)
    rows = F.filter(H.elements(table, "tr"), lambda r: r.rlike(r"(?i)<th[\s>]"))

    def entry(row: Column) -> Column:
        label = F.regexp_extract(row, r"(?is)<th\b[^>]*>(.*?)</th\s*>", 1)
        cell = F.regexp_extract(row, r"(?is)<td\b[^>]*>(.*?)</td\s*>", 1)
        anchor = F.regexp_extract(cell, r"(?is)<a\b[^>]*>", 0)
        return F.struct(
            strip(ascii_fold(H.inner_text(label))).alias("label"),
            strip(H.inner_text(cell)).alias("value"),
            H.attr(anchor, "href").alias("href"),
        )

    return F.transform(rows, entry)


def label_value_rows(
    pages: DataFrame, table_class: str = "pubDisplay", key: str = "page_id", html: str = "html"
) -> DataFrame:
    """One row per label: ``key, pos, label, value, href``; the first of equal labels wins."""
    with_labels = pages.select(key, label_entries(F.col(html), table_class).alias("e")).withColumn(
        "labels", F.transform("e", lambda x: x["label"])
    )
    return (
        each(with_labels, [key, "labels"], "e", "x")
        # The coalesce keeps Spark from testing `labels` for NULL below the explode,
        # where it would have to be computed once more.
        .where(F.coalesce(F.array_position("labels", F.col("x.label")), F.lit(0)) == F.col("pos") + 1)
        .select(key, "pos", "x.label", "x.value", "x.href")
    )


def lookup_label(entries: Column, label: str, field: str = "value") -> Column:
    """The field of the first entry with this label, NULL if there is none."""
    return F.get(F.filter(entries, lambda e: e["label"] == label), F.lit(0))[field]


def label_value_pivot(
    pages: DataFrame,
    labels: Mapping[str, str],
    link_labels: Sequence[str] = (),
    folded: Sequence[str] = (),
    table_class: str = "pubDisplay",
    keep: Sequence[str] = ("page_id",),
    html: str = "html",
) -> DataFrame:
    """One column per label (output name -> label).

    For ``link_labels`` it is the link, not the text; for ``folded`` ones the
    text in ASCII.
    """
    entries = label_entries(F.col(html), table_class)
    if folded:
        entries = F.transform(entries, lambda e: e.withField("plain", ascii_fold(e["value"])))

    def field(label: str) -> str:
        return "href" if label in link_labels else "plain" if label in folded else "value"

    return pages.select(*keep, entries.alias("__e")).select(
        *keep, *[lookup_label(F.col("__e"), label, field(label)).alias(name) for name, label in labels.items()]
    )


def label_link(rows: DataFrame, link_label: str = "DOI:") -> DataFrame:
    """Label rows with the link as value for one label, the text for the others."""
    return rows.withColumn(
        "value", F.when(F.col("label") == link_label, F.col("href")).otherwise(F.col("value"))
    ).drop("href")


def heading_fields(
    pages: DataFrame,
    fields: Mapping[str, str],
    container: Callable[[Column], Column] | None = None,
    keep: Sequence[str] = ("page_id",),
    html: str = "html",
) -> DataFrame:
    """Text of the first heading of each kind (output name -> tag), optionally inside a container."""
    cleaned = H.strip_noise(F.col(html))
    inside = container(cleaned) if container else cleaned
    return pages.select(*keep, inside.alias("__html")).select(
        *keep,
        *[
            H.text_of(F.col("__html"), tag).alias(name)
            for name, tag in fields.items()
        ],
    )


def anchor_neighbours(
    pages: DataFrame,
    marker: str,
    before: Sequence[str],
    anchor: str = "anchor",
    keep: Sequence[str] = ("page_id",),
    html: str = "html",
) -> DataFrame:
    """The last paragraph that holds ``marker``, and the paragraphs 1, 2, … before it.

    ``anchor`` is the first number in the marked paragraph; ``before`` names
    the columns for its predecessors, nearest first, NULL before the start.
    """
    texts = F.transform(H.paragraphs(H.strip_noise(F.col(html))), H.clean_text)
    found = F.transform(F.col("__p"), lambda p: F.contains(p, F.lit(marker)))
    # Searching the reversed array gives the last match.
    from_end = F.array_position(F.reverse(found), F.lit(True))
    at = F.when(from_end > 0, F.size("__p") - from_end).cast("int")
    return (
        pages.select(*keep, texts.alias("__p"))
        .withColumn("__at", at)
        .select(
            *keep,
            first_digits(F.get("__p", F.col("__at"))).alias(anchor),
            *[F.get("__p", F.col("__at") - k).alias(name) for k, name in enumerate(before, start=1)],
        )
    )


def enumerate_map(hrefs: Column, prefix: str, base: str) -> Column:
    """``{prefix0: base+first, prefix1: base+second, …}``."""
    return F.map_from_entries(
        F.transform(
            hrefs,
            lambda h, i: F.struct(F.concat(F.lit(prefix), i.cast("string")), F.concat(F.lit(base), h)),
        )
    )


# Elements that end a run of sibling paragraphs, plus those that belong to one.
# Each of them starts a piece.
_BLOCKS = (
    r"(?:/?(?:p|div|article|section|footer|header|main|nav|aside|body|html|td|ul|ol|dl|h[1-6]"
    r"|blockquote|form|pre|hr)|img|table)\b"
)


def section_pieces(cleaned: Column, start: str) -> Column:
    """What follows the first ``</start>``, cut at block boundaries; tables shrunk to their tag."""
    after = F.regexp_extract(cleaned, rf"(?is)</{start}\s*>(.*)\z", 1)
    flat = F.regexp_replace(after, r"(?is)(<table\b[^>]*>).*?</table\s*>", "$1")
    return H.pieces_of(flat, "(?is).", _BLOCKS)


def take_while_section(
    pages: DataFrame,
    out: str = "section",
    start: str = "h1",
    through: Sequence[str] = ("p", "img", "table"),
    stop_class: str | None = "smalltext",
    stop_summaries: Sequence[str] = ("References", "Bibliography"),
    only: Callable[[Column], Column] | None = None,
    sep: str = " ",
    keep: Sequence[str] = ("page_id",),
    html: str = "html",
    cleaned: bool = False,
) -> DataFrame:
    """Paragraph texts after a heading, up to the first sibling that is something else.

    ``through`` lists the siblings that do not end the section; of them only
    paragraphs contribute text.  A paragraph that holds ``stop_class``, or a
    table whose summary is one of ``stop_summaries``, ends it as well.  Running
    out of siblings is a normal end.  ``only`` picks among the paragraphs.  The
    result is NULL on pages without the heading.  ``cleaned`` says that scripts
    and comments are gone already.
    """
    others = [*[tag for tag in through if tag != "p"], *(["/p"] if "p" in through else [])]
    # Text may precede the first block, another tag may not.
    ways = [r"[^<]*\z"]
    if "p" in through:
        ways.append("<p(?![a-z0-9])" + (f"(?!.*?{H.class_mention(stop_class)})" if stop_class is not None else ""))
    if others:
        # A further tag behind a closed paragraph, an image or a table is a sibling too.
        ways.append(rf"(?!<[^>]*>[^<]*<)<(?:{'|'.join(others)})(?![a-z0-9])")

    def goes_on(piece: Column) -> Column:
        allowed = piece.rlike(f"(?is)^(?:{'|'.join(ways)})")
        if not stop_summaries:
            return allowed
        # Few pieces hold one of the words at all.
        named = reduce(or_, [F.contains(piece, F.lit(s)) for s in stop_summaries]) & piece.rlike("(?i)^<table(?![a-z0-9])")
        return allowed & ~(named & F.coalesce(H.attr(piece, "summary").isin(list(stop_summaries)), F.lit(False)))

    # The pieces before the first that does not go on; negative from there, and no further piece is looked at.
    before = F.aggregate(
        "__pieces", F.lit(0), lambda n, piece: F.when(n < 0, n).when(goes_on(piece), n + 1).otherwise(-n - 1),
        lambda n: F.when(n < 0, -n - 1).otherwise(n),
    )
    kept = F.filter(F.slice("__pieces", 1, before), lambda p: p.rlike(r"(?i)^<p[\s>]"))
    if only is not None:
        kept = F.filter(kept, only)
    texts = F.filter(F.transform(kept, H.clean_text), lambda t: t != "")
    page = F.col(html) if cleaned else H.strip_noise(F.col(html))
    return (
        pages.select(*keep, page.alias("__page"))
        .select(*keep, F.col("__page").rlike(rf"(?is)</{start}\s*>").alias("__has"),
                section_pieces(F.col("__page"), start).alias("__pieces"))
        .select(*keep, F.when(F.col("__has"), F.array_join(texts, sep)).alias(out))
    )


def has_class_attribute(piece: Column) -> Column:
    """Whether the paragraph's own tag carries a class."""
    return H.attr(piece, "class").isNotNull()


def table_pairs(cleaned: Column, summary_like: str, skip: int = 2) -> Column:
    """Entries ``<key, value>`` of the first table whose summary contains a phrase.

    The first ``skip`` rows are headers; the key is the first cell and the value
    the second and third joined by ``"; "``.  Rows with fewer cells are left
    out; of equal keys the last one stays.
    """
    table = F.filter(
        H.elements(cleaned, "table"),
        # Only a table that holds the phrase at all can have it in its summary.
        lambda t: F.contains(t, F.lit(summary_like)) & F.coalesce(F.contains(H.attr(t, "summary"), F.lit(summary_like)), F.lit(False)),
    )
    rows = F.slice(H.elements(F.get(table, F.lit(0)), "tr"), skip + 1, 1_000_000_000)
    cells = F.filter(
        F.transform(rows, lambda r: F.transform(H.elements(r, "td"), H.clean_text)), lambda c: F.size(c) >= 3
    )
    return F.transform(
        cells,
        lambda c: F.struct(
            F.get(c, F.lit(0)).alias("key"),
            strip(ascii_fold(F.concat(F.get(c, F.lit(1)), F.lit("; "), F.get(c, F.lit(2))))).alias("value"),
        ),
    )


def table_to_map(
    pages: DataFrame,
    summary_like: str,
    out: str = "timeline",
    skip: int = 2,
    keep: Sequence[str] = ("page_id",),
    html: str = "html",
    cleaned: bool = False,
) -> DataFrame:
    """``table_pairs`` as a map; a later row replaces an earlier one with the same key."""
    page = F.col(html) if cleaned else H.strip_noise(F.col(html))
    pairs = table_pairs(page, summary_like, skip)
    # Sorted by key, then from the last row to the first: each key's first entry stays.
    ranked = F.array_sort(
        F.transform("__pairs", lambda e, i: F.struct(e["key"].alias("key"), (-i).alias("back"), e["value"].alias("value")))
    )
    last = F.filter(
        "__ranked", lambda e, i: (i == 0) | (F.get("__ranked", i - 1)["key"] != e["key"])
    )
    entries = F.transform(last, lambda e: F.struct(e["key"], e["value"]))
    return (
        pages.select(*keep, pairs.alias("__pairs"))
        .select(*keep, ranked.alias("__ranked"))
        .select(*keep, F.map_from_entries(entries).alias(out))
    )


def colon_label(html: Column, label: str) -> Column:
    """``<p><strong>label</strong>value`` -> what follows the first colon (up to a second one)."""
    found = F.filter(
        H.paragraphs(html),
        lambda p: H.clean_text(F.regexp_extract(p, r"(?is)<strong\b[^>]*>(.*?)</strong\s*>", 1)) == label,
    )
    return strip(F.get(F.split(H.inner_text(F.get(found, F.lit(0))), ":"), F.lit(1)))


def title_block(html: Column, cls: str = "laureate_prize_title") -> Column:
    """Title (inner span) and the second line of a block: ``struct<prize_title, co_winners>``."""
    return let(
        H.element_with(html, "div", "class", cls),
        lambda block: F.struct(
            H.text_of(block, "span").alias("prize_title"), text_line(H.inner_text(block), 1).alias("co_winners")
        ),
    )


def text_line(c: Column, n: int) -> Column:
    """The n-th line (0-based), trimmed; NULL past the end."""
    return strip(F.get(F.split(c, "\n"), F.lit(n)))


def article_extract(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """Title, language, text, links, images, videos, authors, date, keywords and tags of an article page."""
    page = F.col("__html")
    metas = F.regexp_extract_all(page, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def meta(name: str) -> Column:
        named = F.filter(F.col("__metas"), lambda m: F.lower(H.attr(m, "name")) == name)
        return entity_decode(H.attr(F.get(named, F.lit(0)), "content"))

    images = F.transform(
        F.regexp_extract_all(page, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0)), lambda i: H.attr(i, "src")
    )
    # Films are `video`, `source` and `embed` elements, and frames whose address says so.
    films = F.transform(
        F.regexp_extract_all(page, F.lit(r"(?is)<(?:video|source|embed|iframe)\b[^>]*>"), F.lit(0)),
        lambda v: F.when(~v.rlike("(?i)^<iframe") | H.attr(v, "src").rlike("(?i)video|vimeo|youtu|embed"), H.attr(v, "src")),
    )
    tags = F.filter(
        F.regexp_extract_all(page, F.lit(LINK), F.lit(0)),
        lambda a: F.array_contains(F.split(F.lower(F.coalesce(H.attr(a, "rel"), F.lit(""))), r"\s+"), "tag"),
    )
    base = pages.select(*keep, H.strip_noise(F.col(html)).alias("__html"))
    body = take_while_section(
        base.withColumn("__metas", metas), out="text", html="__html", cleaned=True, stop_class=None,
        stop_summaries=(), keep=(*keep, "__html", "__metas"),
    )
    words = F.transform(F.split(meta("keywords"), ","), strip)
    return body.select(
        *keep,
        F.coalesce(H.text_of(page, "title"), H.text_of(page, "h1")).alias("title"),
        non_empty(F.regexp_extract(page, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1)).alias("lang"),
        F.col("text"),
        meta("author").alias("authors"),
        meta("date").alias("published"),
        F.get(images, F.lit(0)).alias("top_image"),
        images.alias("images"),
        F.coalesce(words, F.array().cast("array<string>")).alias("keywords"),
        F.transform(link_array(page), lambda a: a["href"]).alias("links"),
        F.array_compact(films).alias("videos"),
        F.transform(tags, lambda a: H.clean_text(a)).alias("tags"),
    )


def html_table_rows(pages: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), html: str = "html") -> DataFrame:
    """Body rows of the first table with a header row, one column per wanted header."""
    rows = H.elements(H.first_element(H.strip_noise(F.col(html)), "table"), "tr")

    def cells(row: Column, tag: str) -> Column:
        return F.transform(H.elements(row, tag), H.clean_text)

    headed = pages.select(*keep, rows.alias("__rows")).withColumn(
        "__head", F.get(F.filter(F.transform("__rows", lambda r: cells(r, "th")), lambda c: F.size(c) > 0), F.lit(0))
    )
    parsed = (
        each(headed, [*keep, "__head"], "__rows", "__row")
        .select(*keep, "__head", cells(F.col("__row"), "td").alias("__cells"))
        .where(F.size("__cells") > 0)
    )
    return parsed.select(
        *keep,
        *[
            F.get("__cells", F.nullif(F.array_position("__head", F.lit(c)), F.lit(0)).cast("int") - 1).alias(c)
            for c in columns
        ],
    )


def marker_status(html: Column, markers: Mapping[str, str], status: Column | None = None) -> Column:
    """First marker phrase a page holds (phrase -> outcome); ``missing`` on status 404; else ``ok``."""
    out = F.when(html.isNull(), F.lit("missing"))
    if status is not None:
        out = out.when(status == 404, F.lit("missing"))
    for phrase, outcome in markers.items():
        out = out.when(F.contains(html, F.lit(phrase)), F.lit(outcome))
    return out.otherwise(F.lit("ok"))


def zip_extracts(html: Column, first: str, second: str, sep: str = ":") -> Column:
    """Matches of two patterns paired by position and joined; the shorter list decides the length."""
    a, b = F.regexp_extract_all(html, F.lit(first), F.lit(1)), F.regexp_extract_all(html, F.lit(second), F.lit(1))
    joined = F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(sep), y))
    return F.filter(joined, lambda x: x.isNotNull())


def published_text(html: Column) -> Column:
    """Text of the first ``h6`` without its ``Published`` label."""
    return strip_label(H.clean_text(H.first_element(html, "h6")), "Published")
