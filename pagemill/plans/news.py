"""News exports: long HTML files to documents with fields and sentiment.

Two ways to the same documents.  ``news_documents`` takes a file as one row and
cuts it up inside that row, without any shuffle.  ``news_documents_from_blocks``
takes files of any size, read by many tasks, and finds the documents with
ordered scans over the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.dates import extract_date_fuzzy
from pagemill.functions.text import first_digits, strip_label
from pagemill.operators.rows import each
from pagemill.operators.scan import ROWS_PER_BLOCK
from pagemill.operators.segment import last_in_segment, next_sibling, ordered_concat, segment
from pagemill.operators.sentiment import lexicon_sentiment, listed, present_scores
from pagemill.session import staged

# How far to look for the next div before searching the rest of the file.
_NEAR = 8


def _read(block: Column) -> Column:
    return F.struct(
        block.rlike(r"(?i)^<table[\s>]").alias("is_table"),
        H.clean_text(block).alias("text"),
        H.classes_in(block).alias("classes"),
    )


def _judge(block: Column) -> Column:
    """What the classes of a block say it is.

    Fixed values: c5 with c4 and c2, or a c12 table, is body text; c7 or c8 is
    the title; c1 with c4 holds the date; c11 closes a document.
    """

    def has(cls: str) -> Column:
        return F.contains(block["classes"], F.lit(f" {cls} "))

    is_table = block["is_table"]
    return F.struct(
        is_table.alias("is_table"),
        block["text"].alias("text"),
        ((has("c5") & has("c4") & has("c2")) | (is_table & has("c12"))).alias("is_body"),
        (has("c7") | has("c8")).alias("is_title"),
        (has("c1") & has("c4")).alias("is_date"),
        has("c11").alias("is_end"),
    )


def _is_header(block: Column) -> Column:
    text = block["text"]
    return ~block["is_table"] & F.contains(text, F.lit("DOCUMENT")) & F.contains(text, F.lit("of"))


def _is_length(block: Column) -> Column:
    return ~block["is_table"] & F.contains(block["text"], F.lit("LENGTH:"))


def _number_of_words(text: Column) -> Column:
    return first_digits(strip_label(text, "LENGTH:")).try_cast("int")


def export_blocks(html: Column) -> Column:
    """The ``div`` and table blocks of an export in order, with what their classes say."""
    return F.transform(F.transform(H.blocks_of(html), _read), _judge)


def split_documents(blocks: str) -> Column:
    """Blocks to an array of documents: a closing mark ends one, what follows the last is one too."""
    marks = F.transform(blocks, lambda b, i: F.when(b["is_end"], i + 1))
    ends = F.array_distinct(F.concat(F.array_compact(marks), F.array(F.size(blocks))))
    starts = F.concat(F.array(F.lit(0)), ends)
    spans = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), (e - s).alias("n"))), lambda x: x["n"] > 0)
    return F.transform(
        spans,
        lambda x: F.struct(F.slice(blocks, x["s"] + 1, x["n"]).alias("blocks"), (x["s"] + x["n"]).alias("end")),
    )


def _last(blocks: Column, found) -> Column:
    return F.try_element_at(F.filter(blocks, found), F.lit(-1))


def news_documents(exports: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``file_id, html`` to one row per document; ``lexicon`` as for ``lexicon_sentiment``.

    A field that occurs several times keeps its last value.  The title of the
    paper is the next div after the header, whichever document that is in.
    """
    blocks = exports.select("file_id", export_blocks(F.col("html")).alias("all"))

    def next_div(i: Column) -> Column:
        def among(rest: Column) -> Column:
            return F.get(F.filter(rest, lambda b: ~b["is_table"]), F.lit(0))["text"]

        return F.coalesce(among(F.slice("all", i + 2, _NEAR)), among(F.slice("all", i + 2 + _NEAR, F.size("all"))))

    titled = blocks.withColumn(
        "all",
        F.transform(
            "all",
            lambda b, i: F.when(_is_header(b), b.withField("document_idx", b["text"]).withField("paper", next_div(i))).otherwise(
                b.withField("document_idx", F.lit(None).cast("string")).withField("paper", F.lit(None).cast("string"))
            ),
        ),
    )
    docs = each(titled.withColumn("docs", split_documents("all")), ["file_id"], "docs", "doc", "doc_no")
    own = F.col("doc.blocks")
    header = _last(own, lambda b: b["document_idx"].isNotNull())
    length = _last(own, _is_length)
    dates = F.transform(F.filter(own, lambda b: b["is_date"]), lambda b: extract_date_fuzzy(b["text"]))
    bodies = F.transform(F.filter(own, lambda b: b["is_body"]), lambda b: b["text"])
    fields = docs.select(
        "file_id",
        F.col("doc_no").cast("bigint").alias("doc_no"),
        _number_of_words(length["text"]).alias("num_words"),
        _last(own, lambda b: b["is_title"])["text"].alias("email_title"),
        _last(dates, lambda d: d.isNotNull()).alias("date_time"),
        header["document_idx"].alias("document_idx"),
        header["paper"].alias("newspaper_title"),
        F.array_join(bodies, " ").alias("body"),
    )
    return _with_sentiment(fields, lexicon)


def _with_sentiment(fields: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add the polarity and subjectivity of ``body``, in the row for a list that fits in the plan."""
    entries = listed(lexicon)
    if entries is not None:
        return present_scores(fields, F.col("body"), entries).drop("n_hits")
    doc = ["file_id", "doc_no"]
    return fields.join(lexicon_sentiment(fields, lexicon, doc, "body").drop("n_hits"), doc)


def news_documents_from_blocks(
    blocks: DataFrame,
    lexicon: DataFrame,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Block rows (see ``read_export_blocks``) to one row per document.

    ``blocks`` is read once: what the scans go on with is written to the shared folder, first the judged blocks,
    then the numbered ones, so that no text is parsed or numbered again for each of the fields.
    """
    order, doc = ["file_start", "line", "part"], ["file_id", "doc_no"]
    judged = blocks.select(
        "file_id", *order, F.transform(F.array("block"), lambda b: _read(b))[0].alias("b")
    ).select("file_id", *order, _judge(F.col("b")).alias("b"))
    read = judged.select("file_id", *order, "b.*", _is_header(F.col("b")).alias("is_header"), _is_length(F.col("b")).alias("is_length"))
    flat = staged(read, "judged")
    numbered = staged(segment(flat, F.col("is_end"), ["file_id"], order, rows_per_block=rows_per_block), "numbered")
    # The title of the paper is in the next div, whichever document that is in.
    titled = next_sibling(numbered.where(~F.col("is_table")), "text", ["file_id"], order, "next_text", rows_per_block)
    text = F.col("text")
    headers = last_in_segment(
        titled,
        doc,
        order,
        {
            "document_idx": F.when(F.col("is_header"), text),
            "newspaper_title": F.when(F.col("is_header"), F.coalesce("next_text", F.lit(""))),
        },
    )
    fields = last_in_segment(
        numbered,
        doc,
        order,
        {
            "num_words": F.when(F.col("is_length"), text),
            "email_title": F.when(F.col("is_title"), text),
            "date_time": F.when(F.col("is_date"), extract_date_fuzzy(text)),
        },
    )
    bodies = ordered_concat(
        numbered.where("is_body").select(*doc, *order, "text"), doc, order, "text", " ", "body", rows_per_block
    )
    joined = fields.join(headers, doc, "left").join(bodies, doc, "left").fillna({"body": ""})
    shaped = joined.select(
        *doc,
        _number_of_words(F.col("num_words")).alias("num_words"),
        "email_title",
        "date_time",
        "document_idx",
        F.nullif("newspaper_title", F.lit("")).alias("newspaper_title"),
        "body",
    )
    return _with_sentiment(shaped, lexicon)
