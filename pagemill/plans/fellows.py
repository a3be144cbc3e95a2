"""Profile pages to a summary record and a media record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.text import ascii_fold, slugify, strip_label
from pagemill.operators.extract import anchor_neighbours, article_extract, enumerate_map, heading_fields, published_text
from pagemill.operators.frontier import until_first_gap

# Fixed value: a page with this text is past the last profile.
END_MARK = "Sorry"


def profiles_until_end(pages: DataFrame, start: int = 1) -> DataFrame:
    """Profiles with ids ``start, start+1, …`` before the first missing or sorry page."""
    return until_first_gap(pages.where(~F.contains("html", F.lit(END_MARK))), "fellow_id", start)


def fellow_summaries(pages: DataFrame, base: str) -> DataFrame:
    """``fellow_id, url, html`` to one summary per profile."""
    keep = ("fellow_id", "url")
    cleaned = pages.select(*keep, H.strip_noise(F.col("html")).alias("html")).withColumn(
        "info", H.element_with(F.col("html"), "div", "class", "fellow-information")
    )
    named = heading_fields(
        cleaned, {"fellow_name": "h1", "fellow_title": "h3"}, keep=(*keep, "html", "info"), html="info"
    ).withColumn("pub_date", published_text(F.col("info")))
    placed = anchor_neighbours(
        named, "Age", ["fellow_location", "fellow_school", "fellow_designation"], "fellow_age",
        keep=named.columns, html="info",
    )
    gone = F.filter(H.paragraphs(F.col("info")), lambda p: F.contains(p, F.lit("Deceased")))
    photos = F.transform(
        F.filter(H.elements(F.col("html"), "li"), lambda x: H.has_class(x, "media")),
        lambda x: H.attr(F.regexp_extract(x, r"(?is)<a\b[^>]*>", 0), "href"),
    )
    extra = H.element_with(F.col("html"), "div", "class", "fellow-additional-information")
    bio = H.element_with(F.col("html"), "div", "class", "fellow-profile-bio")
    return placed.select(
        "fellow_id",
        ascii_fold(F.col("fellow_name")).alias("fellow_name"),
        ascii_fold(F.col("fellow_title")).alias("fellow_title"),
        "pub_date",
        "fellow_designation",
        "fellow_school",
        "fellow_location",
        "fellow_age",
        strip_label(H.clean_text(F.element_at(gone, F.when(F.size(gone) > 0, F.size(gone)))), "Deceased:").alias("fellow_deceased"),
        enumerate_map(photos, "photo_", base).alias("fellow_photos"),
        H.attr(F.regexp_extract(extra, r"(?is)<a\b[^>]*>", 0), "href").alias("fellow_additional_information"),
        F.col("url").alias("fellow_url"),
        ascii_fold(H.clean_text(bio)).alias("fellow_article_body"),
        slugify(F.col("fellow_name"), "_summary.json").alias("file_name"),
    )


def fellow_media(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """First related block of each profile with what the article behind its link (``url, html``) offers.

    The article's fields are NULL where it was not landed.
    """
    cleaned = pages.select("fellow_id", H.strip_noise(F.col("html")).alias("html")).withColumn(
        "block", H.element_with(F.col("html"), "div", "class", "in-the-media")
    )
    icon = F.get(
        F.filter(
            F.regexp_extract_all("block", F.lit(r"(?is)<a\b[^>]*>"), F.lit(0)), lambda a: H.has_class(a, "icon")
        ),
        F.lit(0),
    )
    name = H.clean_text(H.first_element(F.col("html"), "h1"))
    title = ascii_fold(H.clean_text(H.first_element(F.col("block"), "h3")))
    related = cleaned.where("block is not null").select(
        "fellow_id",
        H.attr(icon, "href").alias("article_link"),
        title.alias("title"),
        slugify(F.concat(name, F.lit("_media_"), title)).alias("file_name"),
    )
    read = article_extract(articles, keep=("url",)).select(
        F.col("url").alias("__url"),
        F.col("authors").alias("article_authors"),
        F.col("published").alias("article_publish_date"),
        ascii_fold(F.col("text")).alias("article_text"),
        F.col("top_image").alias("article_top_image"),
        F.col("videos").alias("article_videos"),
        F.col("title").alias("article_title"),
        F.col("images").alias("article_all_images"),
        F.col("keywords").alias("article_keywords"),
        F.col("tags").alias("article_tags"),
    )
    return related.join(read, F.col("article_link") == F.col("__url"), "left").drop("__url")
