"""Publication pages: search results to links, label/value pages to records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.dates import parse_date_iso
from pagemill.functions.text import ascii_fold, external_id, first_digits, slugify, ws_collapse
from pagemill.operators.extract import extract_links, label_value_pivot
from pagemill.operators.frontier import first_seen
from pagemill.operators.lookup import first_usable
from pagemill.operators.records import META_FIELDS, route_outcome

# Output name -> label on the page.
LABELS = {
    "authors": "Author(s):",
    "title": "Title:",
    "published": "Published:",
    "abstract": "Abstract:",
    "citation": "Citation:",
    "keywords": "Keywords:",
    "volume": "Volume:",
    "issue": "Issue:",
    "pages": "Pages:",
    "dates": "Dates:",
    "proceedings": "Proceedings:",
    "location": "Location:",
    "research_areas": "Research Areas:",
    "doi": "DOI:",
    "pdf_version": "PDF version:",
}
NOT_FOLDED = ("published", "doi", "pdf_version")
# Fixed value: texts of wanted links contain this.
LINK_MARK = "pub_id"


def publication_links(result_pages: DataFrame, mark: str = LINK_MARK) -> DataFrame:
    """Result pages (``field, page_no, html``) to the distinct ``link, field`` pairs.

    Only pages up to the first one without a new link count, per field: a link counts if the first
    page it is on does.  The pairs stay rows, since one link may be listed by very many fields.
    """
    links = extract_links(result_pages, text_like=mark, keys=("field", "page_no")).withColumnRenamed("text", "link")
    first = first_seen(links, ["field"], "link", "page_no")
    visited = result_pages.select("field", "page_no").distinct()
    last = (
        visited.join(first.select("field", "page_no").distinct(), ["field", "page_no"], "left_anti")
        .groupBy("field")
        .agg(F.min("page_no").alias("__last"))
    )
    reached = first.join(last, "field", "left").where(F.col("__last").isNull() | (F.col("page_no") <= F.col("__last")))
    return reached.select("link", "field")


def publication_queue(link_fields: DataFrame) -> DataFrame:
    """Each link once, however many fields list it, with their number."""
    return link_fields.groupBy("link").agg(F.count("*").alias("n_fields"))


def publication_fields(pages: DataFrame) -> DataFrame:
    """The labelled fields of publication pages (``url, html``), nothing but projections."""
    folded = [label for name, label in LABELS.items() if name not in NOT_FOLDED]
    fields = label_value_pivot(pages, LABELS, link_labels=("DOI:",), folded=folded, keep=("url",))
    return fields.select(
        "url",
        first_digits(F.col("url")).alias("pub_id"),
        *[n for n in LABELS if n not in NOT_FOLDED],
        ws_collapse(F.col("published")).alias("published"),
        "doi",
        "pdf_version",
    )


def publication_records(
    tidy: DataFrame, texts: DataFrame, base: str, origin: str, id_prefix: str
) -> DataFrame:
    """``publication_fields`` and attachment texts (``link, file_name, text``) to records.

    The attachment is the one behind the DOI link, else the one at ``base`` plus
    the publication id.  Success needs an attachment and one of the two link labels.
    ``tidy`` is read twice: hand over a written table, so that pages are parsed once.
    """
    places = F.filter(F.array("doi", F.concat(F.lit(base), F.col("pub_id"))), lambda x: x.isNotNull())
    attached = first_usable(
        tidy, "url", places, texts, "link", F.col("text").isNotNull(), ["file_name", "text"]
    )
    shaped = attached.select(
        "url",
        F.coalesce("title", F.lit(" ")).alias("title"),
        "abstract",
        "research_areas",
        parse_date_iso(F.col("published")).alias("date"),
        ascii_fold(ws_collapse(F.col("text"))).alias("words"),
        *[F.col(n) for n in META_FIELDS if n not in ("pdf_filename", "dates")],
        F.col("file_name").alias("pdf_filename"),
        parse_date_iso(F.col("dates")).alias("dates"),
        F.coalesce(F.nullif("doi", F.lit("")), F.nullif("pdf_version", F.lit(""))).alias("__link"),
    )
    has_file = F.col("pdf_filename").isNotNull()
    routed = route_outcome(
        shaped,
        has_file & F.col("__link").isNotNull(),
        {
            "attachment_missing": ~has_file,
            "no_link_label": F.col("__link").isNull(),
            "attachment_empty": F.col("words") == "",
        },
    )
    return routed.select(
        "url",
        "title",
        slugify(F.col("title")).alias("file_name"),
        "research_areas",
        "abstract",
        external_id(F.col("title"), id_prefix).alias("external_id"),
        "date",
        "words",
        F.struct(F.struct(*META_FIELDS).alias(origin)).alias("meta"),
        "outcome",
        "reason",
    )
