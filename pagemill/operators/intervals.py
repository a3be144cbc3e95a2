"""Elements of a page as intervals of its tokens, without a tree.

One fold over the tokens of a row gives each element the token where it ends, the element around it and
how many elements it holds.  What lies inside an element is then a slice: of the tokens, and
of the elements in the order they begin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.fold import fold_emit
from pagemill.functions.text import let
from pagemill.operators.rows import each

# Fixed values of the HTML standard: elements that have no content, and those that end an open one of their name.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
REPEATED = ("dd", "dt", "li", "option", "p", "td", "th", "tr")

ELEMENT = "struct<pos:int,tag:string,depth:int,parent:int,end_pos:int,n_inside:int>"
_OPEN = "array<struct<pos:int,tag:string,depth:int,parent:int,nth:int>>"


def _ended(element: Column, end: Column, opened: Column) -> Column:
    """An open element as a result; ``opened`` elements have begun so far."""
    return F.struct(
        element["pos"].alias("pos"), element["tag"].alias("tag"), element["depth"].alias("depth"),
        element["parent"].alias("parent"), end.cast("int").alias("end_pos"), (opened - element["nth"] - 1).alias("n_inside"),
    )


def _kept(stack: Column, mark: Column) -> Column:
    """How many of the open elements stay open at this tag."""
    size = F.size(stack)
    same = F.array_position(F.reverse(F.transform(stack, lambda e: e["tag"])), mark["tag"]).cast("int")
    repeated = mark["tag"].isin(*REPEATED) & (same == 1)
    return F.when(mark["open"], F.when(repeated, size - 1).otherwise(size)).when(same > 0, size - same).otherwise(size)


def _step(state: Column, mark: Column) -> Column:
    stack, opened = state["stack"], state["opened"]
    count = opened + mark["open"].cast("int")

    def beginning(kept: Column) -> Column:
        return F.struct(
            mark["pos"].alias("pos"), mark["tag"].alias("tag"), kept.alias("depth"),
            F.when(kept > 0, F.get(stack, kept - 1)["pos"]).alias("parent"), opened.alias("nth"),
        )

    def done(kept: Column) -> Column:
        left = F.slice(stack, 1, kept)
        pushed = F.when(mark["open"], F.concat(left, F.array(beginning(kept)))).otherwise(left)
        gone = F.transform(
            F.slice(stack, kept + 1, F.size(stack) - kept), lambda e: _ended(e, mark["pos"], opened)
        )
        return F.struct(F.struct(pushed.alias("stack"), count.alias("opened")).alias("state"), gone.alias("out"))

    # An element without content ends where it begins.
    at_once = F.struct(
        F.struct(stack.alias("stack"), count.alias("opened")).alias("state"),
        F.array(_ended(beginning(F.size(stack)), mark["pos"] + 1, count)).alias("out"),
    )
    return F.when(mark["open"] & mark["tag"].isin(*VOID), at_once).otherwise(let(_kept(stack, mark), done))


def with_intervals(pages: DataFrame, keep: Sequence[str], html: str = "html") -> DataFrame:
    """``keep, tokens, elements``: the tokens of each page and its elements in the order they begin.

    An element holds the tokens from ``pos + 1`` to before ``end_pos``.  An end tag closes the nearest open element of
    its name and all that began within; without such an element it means nothing.  A paragraph, list item,
    table row or cell ends when another one begins directly inside it.  What is still open at the end of the page ends
    there.  The state is the stack of open elements, so a step takes time in proportion to the depth; a NULL page has
    NULL for both.
    """
    tags = F.filter(
        F.transform(
            "tokens",
            lambda tok, i: F.struct(i.alias("pos"), H.tag_name(tok).alias("tag"), (~tok.startswith("</")).alias("open")),
        ),
        lambda m: m["tag"].isNotNull(),
    )
    start = F.struct(F.array().cast(_OPEN).alias("stack"), F.lit(0).alias("opened"))
    folded = fold_emit(F.col("__marks"), start, ELEMENT, _step)
    whole = F.concat(
        F.col("__folded")["out"],
        F.transform(
            F.col("__folded")["state"]["stack"],
            lambda e: _ended(e, F.size("tokens"), F.col("__folded")["state"]["opened"]),
        ),
    )
    return (
        pages.select(*keep, H.tokens(F.col(html)).alias("tokens"))
        .select(*keep, "tokens", tags.alias("__marks"))
        .select(*keep, "tokens", folded.alias("__folded"))
        .select(*keep, "tokens", F.array_sort(whole).alias("elements"))
    )


def node_intervals(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, pos, tag, depth, parent, end_pos, n_inside``: a row for each element; no shuffle."""
    return each(with_intervals(pages, [key], html), [key], "elements", "e", "__nth").select(key, "e.*")


def _chosen(tag: str | None, cls: str | None):
    """Whether an element has this name and its opening tag this class."""

    def test(element: Column) -> Column:
        found = F.lit(True)
        if tag is not None:
            found &= element["tag"] == tag.lower()
        if cls is not None:
            found &= H.has_class(F.get("tokens", element["pos"]), cls)
        return found

    return test


def descendants(
    pages: DataFrame,
    outer: str | None = None,
    inner: str | None = None,
    outer_class: str | None = None,
    inner_class: str | None = None,
    key: str = "page_id",
    html: str = "html",
) -> DataFrame:
    """``key, outer_pos, pos, tag, level``: elements at any depth inside others; ``level`` 1 is a child.

    What an element holds follows it in the list of elements, so it is a slice and the work is in proportion to
    what is found inside.
    """
    is_outer, is_inner = _chosen(outer, outer_class), _chosen(inner, inner_class)

    def inside(element: Column, i: Column) -> Column:
        held = F.filter(F.slice("elements", i + 2, element["n_inside"]), is_inner)
        return F.transform(
            held,
            lambda d: F.struct(
                element["pos"].alias("outer_pos"), d["pos"].alias("pos"), d["tag"].alias("tag"),
                (d["depth"] - element["depth"]).alias("level"),
            ),
        )

    nothing = F.array().cast("array<struct<outer_pos:int,pos:int,tag:string,level:int>>")
    found = F.flatten(F.transform("elements", lambda e, i: F.when(is_outer(e), inside(e, i)).otherwise(nothing)))
    return each(with_intervals(pages, [key], html), [key], found, "d", "__nth").select(key, "d.*")


def element_texts(
    pages: DataFrame, tag: str | None = None, cls: str | None = None, key: str = "page_id", html: str = "html"
) -> DataFrame:
    """``key, pos, text``: clean text of the chosen elements, whatever lies inside them."""
    chosen = F.filter("elements", _chosen(tag, cls))
    found = each(with_intervals(pages, [key], html), [key, "tokens"], chosen, "e", "__nth")
    inner = F.slice("tokens", F.col("e.pos") + 2, F.col("e.end_pos") - F.col("e.pos") - 1)
    return found.select(key, F.col("e.pos").alias("pos"), H.clean_text(F.array_join(inner, "")).alias("text"))
