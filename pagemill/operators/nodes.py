"""The node table: one row per tag or text run of a page, in document order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.text import entity_decode, let
from pagemill.operators.rows import each, present


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Explode pages into ``key, pos, tok, kind, tag, class, href, text``.

    A generator followed by projections: no shuffle, and columns that are not
    used later are never computed.
    """
    tok = F.col("tok")
    return each(pages, [key], H.tokens(F.col(html)), "tok").select(
        key,
        "pos",
        "tok",
        H.token_kind(tok).alias("kind"),
        H.tag_name(tok).alias("tag"),
        H.attr(tok, "class").alias("class"),
        H.attr(tok, "href").alias("href"),
        F.when(~tok.startswith("<"), entity_decode(tok)).alias("text"),
    )


def select_nodes(nodes: DataFrame, tag: str | None = None, cls: str | None = None) -> DataFrame:
    """Opening tags of one element name and/or one class."""
    found = F.col("kind") == "open"
    if tag is not None:
        found &= F.col("tag") == tag.lower()
    if cls is not None:
        found &= F.array_contains(F.split("class", r"\s+"), cls)
    return nodes.where(found)


def link_target(nodes: DataFrame) -> DataFrame:
    """Links with the attribute rather than the text; NULL when it is empty."""
    return select_nodes(nodes, tag="a").select(*[c for c in nodes.columns if c in ("page_id", "pos", "href")])


def tag_counts(pages: DataFrame, tags: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """Per page, how many opening tags of each name.  Counted inside the row, in one pass over the page."""
    names = F.regexp_extract_all(F.lower(H.strip_noise(F.col(html))), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return pages.select(key, names.alias("__names")).select(key, *_counts(tags))


def tag_count_filter(pages: DataFrame, at_least: dict[str, int], none_of: list[str], **cols) -> DataFrame:
    """Pages with at least so many of some elements and none of others."""
    return _enough(tag_counts(pages, [*at_least, *none_of], **cols), 1, at_least, none_of)


def class_counts(pages: DataFrame, classes: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, node, n_<class>…``: per ``div`` or table, how many of its tags, itself included, have each class."""
    nodes = each(pages, [key], H.blocks_of(F.col(html)), "block", "node")
    return nodes.select(key, "node", H.class_list(F.col("block")).alias("__names")).select(key, "node", *_counts(classes))


def class_count_filter(pages: DataFrame, at_least: dict[str, int], none_of: list[str], **cols) -> DataFrame:
    """The nodes with at least so many tags of some classes and none of others."""
    return _enough(class_counts(pages, [*at_least, *none_of], **cols), 2, at_least, none_of)


def _counts(names: list[str]) -> list[Column]:
    """Occurrences of each name in ``__names``."""
    return [
        (F.size("__names") - F.size(F.array_remove("__names", name))).cast("bigint").alias(f"n_{name}") for name in names
    ]


def _enough(counted: DataFrame, n_keys: int, at_least: dict[str, int], none_of: list[str]) -> DataFrame:
    keys, counts = counted.columns[:n_keys], counted.columns[n_keys:]

    def wanted(row: Column) -> Column:
        enough = [row[f"n_{name}"] >= least for name, least in at_least.items()]
        none = [row[f"n_{name}"] == 0 for name in none_of]
        return F.when(reduce(lambda a, b: a & b, enough + none), row)

    return present(counted, keys, let(F.struct(*counts), wanted), "n").select(*keys, "n.*")


def reconcile_counts(nodes: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of nodes that meet each condition."""
    return nodes.agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])
