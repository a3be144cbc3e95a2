"""The main text of a page by density: the run of blocks that has most text and fewest links.

For pages that mark their text by no heading, ``article`` or class.  A page is cut into blocks, every block gets points for its
words and loses some for words in links, neighbours smooth each other, and the run of blocks with the largest
sum is the text.  All of it stays in the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H

# Elements that begin and end a block.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main"
    "|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
BLOCK_BORDER = rf"(?i)</?(?:{BLOCK_TAGS})(?:[\s/][^>]*)?>"
# A word in a link costs so many words, every block so many from the start.
LINK_COST = 3
BLOCK_COST = 8


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def text_blocks(html: Column) -> Column:
    """``array<struct<text, words, linked>>``: blocks with any words, in order."""
    pieces = F.split(H.strip_noise(html), BLOCK_BORDER)

    def block(piece: Column) -> Column:
        text = H.clean_text(piece)
        links = H.clean_text(F.array_join(H.elements(piece, "a"), " "))
        return F.struct(text.alias("text"), _words(text).alias("words"), _words(links).alias("linked"))

    return F.filter(F.transform(pieces, block), lambda b: b["words"] > 0)


def block_scores(blocks: Column, link_cost: int = LINK_COST, block_cost: int = BLOCK_COST) -> Column:
    """Points of every block: its own twice and those of the blocks before and after it."""

    def own(i: Column) -> Column:
        b = F.get(blocks, i)
        return F.coalesce((b["words"] - b["linked"] * link_cost - block_cost).cast("bigint"), F.lit(0).cast("bigint"))

    return F.transform(blocks, lambda _, i: F.when(i > 0, own(i - 1)).otherwise(0) + own(i) * 2 + own(i + 1))


def best_run(scores: Column) -> Column:
    """``struct<score, first, last>`` of the consecutive scores with the largest sum (0-based).

    Of equal sums the run that ends first, and of those the shortest; ``score`` is 0 where no sum is above zero.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        zero.alias("run"), F.lit(0).alias("begin"), F.lit(0).alias("at"),
        zero.alias("score"), F.lit(0).alias("first"), F.lit(-1).alias("last"),
    )

    def step(s: Column, score: Column) -> Column:
        run = F.greatest(s["run"], zero) + score
        begin = F.when(s["run"] > 0, s["begin"]).otherwise(s["at"])
        better = run > s["score"]
        return F.struct(
            run.alias("run"), begin.alias("begin"), (s["at"] + 1).alias("at"),
            F.when(better, run).otherwise(s["score"]).alias("score"),
            F.when(better, begin).otherwise(s["first"]).alias("first"),
            F.when(better, s["at"]).otherwise(s["last"]).alias("last"),
        )

    return F.aggregate(
        scores, start, step, lambda s: F.struct(s["score"].alias("score"), s["first"].alias("first"), s["last"].alias("last"))
    )


def main_text(
    pages: DataFrame,
    keep: Sequence[str] = ("page_id",),
    html: str = "html",
    link_cost: int = LINK_COST,
    block_cost: int = BLOCK_COST,
) -> DataFrame:
    """``keep, text, score, n_blocks``: the blocks of the best run, a line each.

    A page without a run above zero (and a NULL page) has text NULL, score 0 and no blocks.
    """
    blocks = pages.select(*keep, text_blocks(F.col(html)).alias("__blocks"))
    scored = blocks.select(*keep, "__blocks", block_scores(F.col("__blocks"), link_cost, block_cost).alias("__scores"))
    run = scored.select(*keep, "__blocks", best_run(F.col("__scores")).alias("__run"))
    n = F.col("__run.last") - F.col("__run.first") + 1
    lines = F.transform(F.slice("__blocks", F.col("__run.first") + 1, n), lambda b: b["text"])
    return run.select(
        *keep,
        F.when(F.col("__run.score") > 0, F.array_join(lines, "\n")).alias("text"),
        F.coalesce("__run.score", F.lit(0).cast("bigint")).alias("score"),
        F.coalesce(n, F.lit(0)).alias("n_blocks"),
    )
