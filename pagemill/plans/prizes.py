"""Prize list, detail documents and four kinds of pages to one record per prize and person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.dates import extract_date_fuzzy, sentinel_to_null
from pagemill.functions.text import ascii_fold, let, page_kind_url, recode_value, share_label, space_collapse, strip
from pagemill.operators.extract import (
    colon_label,
    marker_status,
    table_to_map,
    take_while_section,
    title_block,
)
from pagemill.sources.readers import affiliations, explode_list, first_detail

AREAS = {"economics": "economic-sciences"}
# Page kind -> address endings, in order of preference.
# The plain ending comes before the one with `_en`; biographies have the plain one only.
PAGE_ENDING = r"-(bio(?!_en)|speech|lecture|facts)(?:_en)?\.html$"
TALK_ENDING = r"-lecture(?:_en)?\.pdf$"
KINDS = ("bio", "speech", "lecture", "talk", "facts")
# Classes the wanted parts carry are `smalltext`, `video_main`,
# `laureate_prize_title` and `laureate_info_wrapper`; labels are `Field:` and
# `Contribution:`.
# Phrases that mark a page as unusable.
MARKERS = {"Page Not Found": "missing", "Read the Banquet Speech": "pointer"}
PERSON = ["category", "year", "id"]


def page_fields(pages: DataFrame) -> DataFrame:
    """What each landed page (``url, status, html``) offers, before any shuffle.

    ``stem`` is the address up to the kind of page, ``rank`` its place among the addresses of the kind;
    ``text`` is the biography or the speech, by kind of page.
    """
    page = F.col("html")
    kind = F.regexp_extract("url", PAGE_ENDING, 1)
    usable = pages.where((kind != "") & (marker_status(page, MARKERS, F.col("status")) == "ok"))
    known = usable.select("url", kind.alias("kind"), H.strip_noise(page).alias("page"))

    def only(*kinds: str) -> Column:
        """The page if it is of one of these kinds; work on other pages ends at the NULL."""
        return F.when(F.col("kind").isin(*kinds), F.col("page"))

    split = known.select(
        "url", "kind", "page", only("bio").alias("__bio_page"), only("speech").alias("__speech_page")
    )
    bio = take_while_section(split, out="__bio", html="__bio_page", cleaned=True, keep=split.columns)
    speech = take_while_section(
        bio, out="__speech", html="__speech_page", cleaned=True, through=("p", "img"), stop_class=None,
        stop_summaries=(), keep=bio.columns,
    )
    facts = H.element_with(only("facts"), "div", "class", "laureate_info_wrapper")
    timeline = table_to_map(speech, "brief autobiography", html="__bio_page", cleaned=True, keep=speech.columns)
    small = F.filter(H.paragraphs(F.col("__speech_page")), lambda p: H.mentions_class(p, "smalltext"))
    place = F.coalesce(
        H.inner_text(F.get(small, F.lit(0))), H.inner_text(H.element_with(only("lecture"), "div", "class", "video_main"))
    )
    told = let(
        facts,
        lambda f: F.struct(
            colon_label(f, "Field:").alias("field"), colon_label(f, "Contribution:").alias("contribution")
        ),
    )
    return timeline.withColumn("__facts", told).select(
        "url",
        F.regexp_replace("url", PAGE_ENDING, "").alias("stem"),
        _rank(F.col("url")).alias("rank"),
        "kind",
        H.clean_text(H.first_element(only("bio"), "h1")).alias("title"),
        ascii_fold(space_collapse(F.coalesce("__bio", "__speech"))).alias("text"),
        let(place, extract_date_fuzzy).alias("date"),
        title_block(only("bio", "speech", "lecture")).alias("block"),
        "timeline",
        F.col("__facts.field").alias("field"),
        F.col("__facts.contribution").alias("contribution"),
    )


def _rank(url: Column) -> Column:
    return url.rlike(r"_en\.[a-z]+$").cast("int")


def people(list_docs: DataFrame, details: DataFrame, first_prize_only: bool = False) -> DataFrame:
    """List rows with their details (``id, detail``: JSON text).

    Motivation and affiliations are those of the prize of this year; where there is none, the motivation is
    the one in the list.  With ``first_prize_only`` both are those of the person's first prize.
    """
    listed = explode_list(list_docs).select(
        recode_value(F.col("category"), AREAS).alias("category"),
        "year",
        "id",
        share_label(F.col("share")).alias("share"),
        F.col("motivation").alias("list_motivation"),
        ascii_fold(F.col("firstname")).alias("first_name"),
        F.col("surname"),
    )
    known = first_detail(details, "detail", keep=["id"])
    joined = listed.join(known, "id", "left")
    this_year = F.get(F.filter("prizes", lambda p: p["year"] == F.col("year")), F.lit(0))
    motivation: Column = F.coalesce(this_year["motivation"], F.col("list_motivation"))
    places: Column = affiliations(this_year["affiliations"])
    if first_prize_only:
        motivation, places = F.col("first_motivation"), F.col("affiliations")
    return joined.select(
        *PERSON,
        "share",
        "first_name",
        ascii_fold(F.col("surname")).alias("last_name"),
        "surname",
        "gender",
        strip(ascii_fold(motivation)).alias("motivation"),
        places.alias("affiliations"),
        F.col("bornCountry").alias("birth_country"),
        "bornCountryCode",
        F.col("bornCity").alias("birth_city"),
        F.col("born").alias("birth_date"),
        F.col("diedCountry").alias("death_country"),
        F.col("diedCity").alias("death_city"),
        "diedCountryCode",
        sentinel_to_null(F.col("died")).alias("death_date"),
    )


def prize_records(
    list_docs: DataFrame,
    details: DataFrame,
    pages: DataFrame,
    lecture_texts: DataFrame,
    base: str,
    location: str = "Stockholm",
) -> DataFrame:
    """Nested records.  ``lecture_texts`` (``url, words``) holds the text of lecture files by address."""
    listed = people(list_docs, details)
    talks = lecture_texts.where(F.col("url").rlike(TALK_ENDING)).select(
        "url",
        F.regexp_replace("url", TALK_ENDING, "").alias("stem"),
        _rank(F.col("url")).alias("rank"),
        F.lit("talk").alias("kind"),
        ascii_fold(space_collapse(F.col("words"))).alias("text"),
    )
    landed = page_fields(pages).unionByName(talks, allowMissingColumns=True)
    # One aggregate brings the pages of a person together and picks the best of each kind.
    offered = F.struct("url", "title", "text", "date", "block", "timeline", "field", "contribution")
    best = landed.groupBy("stem").agg(
        *[F.min_by(offered, F.when(F.col("kind") == kind, F.col("rank"))).alias(kind) for kind in KINDS]
    )
    person = page_kind_url(base, F.col("category"), F.col("year"), F.col("surname"), F.lit(""))
    joined = listed.withColumn("__stem", person).join(best, F.col("__stem") == F.col("stem"), "left")

    def of_block(name: str) -> Column:
        return F.coalesce(*[F.col(f"{kind}.block.{name}") for kind in ("lecture", "speech", "bio")])

    def at(kind: str) -> Column:
        return F.when(F.col(kind).isNotNull(), F.lit(location))

    return joined.select(
        *[c for c in listed.columns if c not in ("category", "surname")],
        F.col("category").alias("area"),
        of_block("prize_title").alias("prize_title"),
        of_block("co_winners").alias("co_winners"),
        F.col("facts.field").alias("field"),
        F.col("facts.contribution").alias("contribution"),
        F.struct(
            F.col("bio.text").alias("words"), F.col("bio.url").alias("url"), F.col("bio.title").alias("title")
        ).alias("bio"),
        F.struct(
            F.col("speech.text").alias("words"), F.col("speech.date").alias("date"),
            at("speech").alias("location"), F.col("speech.url").alias("url"),
        ).alias("speech"),
        F.struct(
            F.col("talk.text").alias("words"), F.col("lecture.date").alias("date"),
            at("lecture").alias("location"), F.col("talk.url").alias("url"),
        ).alias("lecture"),
        F.col("bio.timeline").alias("timeline"),
    )
