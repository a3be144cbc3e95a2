"""Queries for the end-to-end flows, on pages rendered from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators.rows import dealt, each, spread
from pagemill.operators.sentiment import lexicon_frame
from pagemill.plans import fellows, news, prizes, publications, worktable
from pagemill.plans.q_joins import LISTED
from pagemill.plans.q_text import NOW, now
from pagemill.plans.q_windows import customer_state, plain_state
from pagemill.plans.registry import query
from pagemill.session import scratch_path, staged
from pagemill.sources.readers import read_export_blocks


def text(c: str):
    return F.col(c).cast("string")


def join_text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


LINK_FIELDS_SQL = """WITH e AS (SELECT user_id AS field, CAST(day(ts) AS INTEGER) AS page_no, 'http://www.example.org/pub_id=' || event_type AS link,
                         event_type <> 'error' AS wanted FROM events),
            l AS (SELECT * FROM e WHERE wanted),
            f AS (SELECT field, link, min(page_no) AS page_no FROM l GROUP BY ALL),
            n AS (SELECT e.field, e.page_no, count(f.link) AS n FROM (SELECT DISTINCT field, page_no FROM e) e
                  LEFT JOIN f USING (field, page_no) GROUP BY ALL),
            z AS (SELECT field, coalesce(min(page_no) FILTER (n = 0), 99) AS last FROM n GROUP BY field)
       SELECT DISTINCT link, l.field FROM l JOIN z ON l.field = z.field AND page_no <= last"""


def link_fields(t):
    # One result page per event; a user is a field, a day a page number.
    shown = F.when(F.col("event_type") == "error", F.lit("broken")).otherwise(
        join_text("http://www.example.org/pub_id=", F.col("event_type"))
    )
    page = join_text('<ul><li><a href="/help">Help</a></li><li><a href="/p">', shown, "</a></li></ul>")
    pages = t.events.select(F.col("user_id").alias("field"), F.dayofmonth("ts").alias("page_no"), page.alias("html"))
    return publications.publication_links(pages)


@query("publication_links", LINK_FIELDS_SQL)
def _(t):
    return link_fields(t)


@query("publication_queue", f"SELECT link, count(*) AS n_fields FROM ({LINK_FIELDS_SQL}) GROUP BY link")
def _(t):
    return publications.publication_queue(link_fields(t))


PUBLICATION_SQL = r"""WITH p AS (SELECT *, 'http://www.example.org/show?pub_id=' || p_partkey AS url, p_size < 25 AS has_doi,
                         p_type IN ('PROMO', 'LARGE') AS doi_text, p_type IN ('LARGE', 'SMALL') AS own_text FROM part)
        SELECT url, p_name || ' e' AS title, replace(p_name, ' ', '_') || '_e.json' AS file_name, 'src_' || replace(p_name, ' ', '-') || '-e' AS external_id,
               '1998-03-0' || (1 + p_size % 9) || 'T00:00:00' AS date, CAST(NULL AS VARCHAR) AS dates, p_brand || ';' AS authors,
               CASE WHEN has_doi AND doi_text THEN 'doi.pdf' WHEN own_text THEN p_partkey || '.pdf' END AS pdf_filename,
               CASE WHEN has_doi AND doi_text THEN 'doi ' || p_type WHEN own_text THEN 'own ' || p_type END AS words,
               CASE WHEN has_doi AND (doi_text OR own_text) THEN 'success' ELSE 'failures' END AS outcome,
               CASE WHEN NOT ((has_doi AND doi_text) OR own_text) THEN 'attachment_missing' WHEN NOT has_doi THEN 'no_link_label' END AS reason
        FROM p"""


@query("publication_records", PUBLICATION_SQL)
def _(t):
    pages, texts = publication_inputs(t)
    return publication_columns(publications.publication_records(staged(publications.publication_fields(pages), "fields"), texts, PDF_BASE, "source", "src_"))


PDF_BASE = "http://www.example.org/pdf?pub_id="


def publication_inputs(t, parts=None):
    """Parts as publication pages, and the attachments that were landed."""
    parts = t.part if parts is None else parts
    size = F.col("p_size")
    doi = F.when(
        size < 25, join_text('<tr><th>DOI:</th><td><a href="http://doi.example.org/', text("p_partkey"), '">d</a></td></tr>')
    ).otherwise(F.lit(""))
    html = join_text(
        '<table class="pubDisplay"><tr><td>x</td></tr><tr><th>Title:</th><td> ', F.col("p_name"), " é</td></tr>",
        "<tr><th>Author(s):</th><td>", F.col("p_brand"), ";</td></tr>", doi,
        "<tr><th>Dates: </th><td></td></tr><tr><th>Published:</th><td>March\n ", (1 + size % 9).cast("string"),
        ", 1998</td></tr></table>",
    )
    pages = dealt(parts).select(join_text("http://www.example.org/show?pub_id=", text("p_partkey")).alias("url"), html.alias("html"))
    texts = t.part.where("p_type in ('PROMO', 'LARGE')").select(
        join_text("http://doi.example.org/", text("p_partkey")).alias("link"), F.lit("doi.pdf").alias("file_name"),
        join_text(" doi\n", F.col("p_type"), "\n").alias("text"),
    ).unionByName(
        t.part.where("p_type in ('LARGE', 'SMALL')").select(
            join_text("http://www.example.org/pdf?pub_id=", text("p_partkey")).alias("link"),
            join_text(text("p_partkey"), ".pdf").alias("file_name"), join_text("own  ", F.col("p_type")).alias("text"),
        )
    )
    return pages, texts


def publication_columns(records):
    return records.select(
        "url", "title", "file_name", "external_id", "date", "meta.source.dates", "meta.source.authors",
        "meta.source.pdf_filename", "words", "outcome", "reason",
    )


BASE = "http://www.example.org/prizes"


def award_rows(t):
    """One row per customer, order status and year, as person, category and year."""
    return t.orders.select(
        F.col("o_custkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("economics")).otherwise(F.col("o_orderstatus")).alias("category"),
        F.year("o_orderdate").cast("string").alias("year"),
    ).distinct()


@query(
    "prize_records",
    f"""WITH a AS (SELECT DISTINCT o_custkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'economic-sciences' ELSE o_orderstatus END AS area,
                          CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders),
             u AS (SELECT *, '{BASE}/' || area || '/laureates/' || year || '/person' || id AS stem, area = 'O' AS is_o, area = 'P' AS is_p FROM a)
        SELECT CAST(id AS VARCHAR) AS id, area, year, 'Rene' AS first_name, 'Person' || id AS last_name, '1/2' AS share,
               c_mktsegment AS gender, CASE year WHEN '1996' THEN 'for 1996' WHEN '1997' THEN 'for 1997' ELSE 'for it' END AS motivation,
               CASE year WHEN '1996' THEN 'Nation ' || c_nationkey WHEN '1997' THEN 'Other ' || c_nationkey END AS affiliation, CAST(NULL AS VARCHAR) AS death_date,
               'bio of ' || id || ' more' AS bio_words, stem || '-bio.html' AS bio_url, 'Person ' || id AS bio_title,
               CASE WHEN is_o THEN 'speech ' || id WHEN is_p THEN 'other ' || id END AS speech_words,
               CASE WHEN is_o THEN '1998-12-10T00:00:00' END AS speech_date,
               CASE WHEN is_o THEN stem || '-speech.html' WHEN is_p THEN stem || '-speech_en.html' END AS speech_url,
               CASE WHEN is_p THEN 'talk ' || id END AS lecture_words, CASE WHEN is_p THEN stem || '-lecture_en.pdf' END AS lecture_url,
               CASE WHEN is_o THEN 'field ' || c_nationkey END AS field, CASE WHEN is_o THEN 'Prize by speech' ELSE 'Prize by bio' END AS prize_title,
               CASE WHEN is_o THEN 'second' ELSE 'winners' END AS co_winners, 'born; as ' || c_name AS timeline_1900
        FROM u JOIN customer ON c_custkey = id""",
)
def _(t):
    awards = award_rows(t)
    pid = text("id")
    person = F.struct(
        pid.alias("id"), F.lit("2").alias("share"), F.lit("for it").alias("motivation"), F.lit("René").alias("firstname"),
        join_text("Person", pid).alias("surname"),
    )
    prize = F.struct("category", "year", F.array(person).alias("laureates"))
    lists = awards.select(F.array(prize).alias("prizes"))
    detail = F.struct(
        F.array(
            F.struct(
                F.col("c_mktsegment").alias("gender"),
                F.lit("0000-00-00").alias("died"),
                F.array(
                    *[
                        F.struct(
                            F.lit(year).alias("year"), F.lit(f" for {year} ").alias("motivation"),
                            F.array(F.struct(join_text(where, text("c_nationkey")).alias("name"))).alias("affiliations"),
                        )
                        for year, where in (("1996", "Nation "), ("1997", "Other "))
                    ]
                ).alias("prizes"),
            )
        ).alias("laureates")
    )
    details = dealt(t.customer).select(text("c_custkey").alias("id"), F.to_json(detail).alias("detail"))
    area = F.when(F.col("category") == "economics", F.lit("economic-sciences")).otherwise(F.col("category"))
    hosts = (
        awards.join(t.customer, F.col("id") == F.col("c_custkey"))
        .withColumn("area", area)
        .withColumn("stem", join_text(BASE + "/", area, "/laureates/", F.col("year"), "/person", pid))
    )

    def page(where, ending, status, *html):
        made = F.struct(join_text(F.col("stem"), ending).alias("url"), F.lit(status).alias("status"), join_text(*html).alias("html"))
        return F.when(F.expr(where), made)

    bio = page(
        "true", "-bio.html", 200,
        '<h1>Person ', pid, '</h1><p>bio  of ', pid, "</p>\n<img src='a'><table summary='x'><tr><td><p>no</p></td></tr></table>",
        '<p>more</p><p><span class="smalltext">From</span></p><p>after</p>',
        '<div class="laureate_prize_title"><span>Prize by bio</span>\nwinners</div>',
        '<table summary="A brief autobiography"><tr><td>1</td></tr><tr><td>2</td></tr><tr><td>1900</td><td>born</td><td>as ',
        F.col("c_name"), "</td></tr></table>",
    )
    speech = page(
        "area = 'O'", "-speech.html", 200, '<h1>Speech</h1><p>speech ', pid, "</p><table><tr><td>x</td></tr></table>",
        '<p class="smalltext">in town, December 10, 1998</p><div class="laureate_prize_title"><span>Prize by speech</span>\n second \n</div>',
    )
    pointer = page("area = 'P'", "-speech.html", 200, "<h1>See</h1><p>Read the Banquet Speech</p>")
    other = page("area = 'P'", "-speech_en.html", 200, "<h1>Speech</h1><p>other ", pid, "</p>")
    gone = page("area = 'P'", "-facts.html", 404, "<h1>x</h1>")
    facts = page(
        "area = 'O'", "-facts_en.html", 200, "<h1>Facts</h1><div class='laureate_info_wrapper'><p><strong>Field:</strong> field ",
        text("c_nationkey"), "</p></div>",
    )
    # One pass makes the pages of a host; six would join the hosts six times.
    landed = F.array_compact(F.array(bio, speech, pointer, other, gone, facts))
    pages = each(spread(hosts, "stem"), [], landed, "page").select("page.*")
    talks = hosts.where("area = 'P'").select(
        join_text(F.col("stem"), "-lecture_en.pdf").alias("url"), join_text("talk  ", pid).alias("words")
    )
    r = prizes.prize_records(lists, details, pages, talks, BASE)
    return r.select(
        "id", "area", "year", "first_name", "last_name", "share", "gender", "motivation",
        F.get("affiliations", F.lit(0))["name"].alias("affiliation"), "death_date",
        F.col("bio.words").alias("bio_words"), F.col("bio.url").alias("bio_url"), F.col("bio.title").alias("bio_title"),
        F.col("speech.words").alias("speech_words"), F.col("speech.date").alias("speech_date"), F.col("speech.url").alias("speech_url"),
        F.col("lecture.words").alias("lecture_words"), F.col("lecture.url").alias("lecture_url"),
        "field", "prize_title", "co_winners", F.try_element_at("timeline", F.lit("1900")).alias("timeline_1900"),
    )


def profile_pages(t):
    key = text("c_custkey")
    html = join_text(
        '<div class="fellow-information"><h1>', F.col("c_name"), "</h1><h3>Fellow of ", F.col("c_mktsegment"),
        "</h3><h6>Published May 1, 2015</h6><p>Designer</p><p>School ", text("c_nationkey"), "</p><p>Town ", key,
        "</p><p>Age: ", (20 + F.col("c_custkey") % 60).cast("string"), "</p><p>Deceased: June 1, 2016</p></div>",
        '<div class="fellow-profile-bio user-generated clearfix"><p>Body é of ', key, "</p></div>",
        '<ul><li class="media"><a href="/a/', key, '">a</a></li><li class="other"><a href="/no">b</a></li>',
        '<li class="media"><a href="/b/', key, '">c</a></li></ul>',
        '<div class="fellow-additional-information"><a href="/more/', key, '">More</a></div>',
        '<div class="promo default in-the-media "><a href="/x">x</a><a class="icon" href="http://m.example.org/', key,
        '"><h3>News on ', F.col("c_mktsegment"), "</h3></a></div>",
        '<div class="promo default in-the-media "><a class="icon" href="/second"><h3>Second</h3></a></div>',
    )
    return dealt(t.customer).select(
        F.col("c_custkey").alias("fellow_id"), join_text("http://www.example.org/fellows/", key, "/").alias("url"), html.alias("html")
    )


@query(
    "fellow_summaries",
    """SELECT c_custkey AS fellow_id, c_name AS fellow_name, 'Fellow of ' || c_mktsegment AS fellow_title, 'May 1, 2015' AS pub_date,
              'Designer' AS fellow_designation, 'School ' || c_nationkey AS fellow_school, 'Town ' || c_custkey AS fellow_location,
              CAST(20 + c_custkey % 60 AS VARCHAR) AS fellow_age, 'June 1, 2016' AS fellow_deceased,
              '{"photo_0":"https://www.example.org/a/' || c_custkey || '","photo_1":"https://www.example.org/b/' || c_custkey || '"}' AS fellow_photos,
              '/more/' || c_custkey AS fellow_additional_information, 'http://www.example.org/fellows/' || c_custkey || '/' AS fellow_url,
              'Body e of ' || c_custkey AS fellow_article_body, replace(c_name, '#', '') || '_summary.json' AS file_name FROM customer""",
)
def _(t):
    pages = fellows.profiles_until_end(profile_pages(t), start=0)
    found = fellows.fellow_summaries(pages, "https://www.example.org")
    return found.withColumn("fellow_photos", F.to_json("fellow_photos"))


def article_pages(t):
    """The related articles; those of every third profile were not landed."""
    key = text("c_custkey")
    html = join_text(
        "<html lang=en><head><title>Story &amp; ", key, '</title><meta name="author" content="A. Nother, ', F.col("c_mktsegment"),
        '"><meta name="date" content="2015-05-', F.lpad((1 + F.col("c_custkey") % 28).cast("string"), 2, "0"),
        '"><meta name="keywords" content="news, ', F.col("c_mktsegment"), '"></head><body><img src="/top', key, '.png"><h1>Headline</h1><p>First é</p>\n<p>second</p>',
        '<img src="/b.png"><video src="/v', key, '.mp4"></video><iframe src="https://video.example.org/embed/', key,
        '"></iframe><iframe src="/ads"></iframe><a rel="tag" href="/t/1">Tag 1</a><a rel="nofollow tag">Tag ', key, "</a><a href='/x'>x</a></body></html>",
    )
    return dealt(t.customer.where("c_custkey % 3 <> 0")).select(join_text("http://m.example.org/", key).alias("url"), html.alias("html"))


@query(
    "fellow_media",
    """WITH c AS (SELECT *, c_custkey % 3 <> 0 AS landed FROM customer)
       SELECT c_custkey AS fellow_id, 'http://m.example.org/' || c_custkey AS article_link, 'News on ' || c_mktsegment AS title,
              CASE WHEN landed THEN 'A. Nother, ' || c_mktsegment END AS article_authors,
              CASE WHEN landed THEN '2015-05-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') END AS article_publish_date,
              CASE WHEN landed THEN 'First e second' END AS article_text, CASE WHEN landed THEN '/top' || c_custkey || '.png' END AS article_top_image,
              CASE WHEN landed THEN '/v' || c_custkey || '.mp4 https://video.example.org/embed/' || c_custkey END AS article_videos,
              CASE WHEN landed THEN 'Story & ' || c_custkey END AS article_title,
              CASE WHEN landed THEN '/top' || c_custkey || '.png /b.png' END AS article_all_images,
              CASE WHEN landed THEN 'news ' || c_mktsegment END AS article_keywords, CASE WHEN landed THEN 'Tag 1 Tag ' || c_custkey END AS article_tags,
              replace(c_name, '#', '') || '_media_News_on_' || c_mktsegment || '.json' AS file_name FROM c""",
)
def _(t):
    media = fellows.fellow_media(profile_pages(t), article_pages(t))
    lists = ("article_videos", "article_all_images", "article_keywords", "article_tags")
    return media.select(
        *[F.array_join(c, " ").alias(c) if c in lists else F.regexp_replace(c, r"\s+", " ").alias(c) if c == "article_text" else F.col(c) for c in media.columns]
    )


def _news_sql() -> str:
    return rf"""
    WITH lex AS (SELECT word, polarity::DOUBLE AS polarity, subjectivity::DOUBLE AS subjectivity FROM (VALUES {LISTED}) v(word, polarity, subjectivity)),
         d AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, 0 AS doc_no, trim(regexp_replace(text, '\s+', ' ', 'g')) || ' table of ' || lang || ' stupid end' AS body,
                      '12' AS num_words, 'Title ' || doc_id AS email_title, '1991-07-11T00:00:00' AS date_time, '1 of 2 DOCUMENTS' AS document_idx,
                      'Paper ' || source AS newspaper_title FROM documents
               UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'a best day', NULL, NULL, NULL, '2 of 2 DOCUMENTS', 'no closing mark' FROM documents),
         w AS (SELECT file_id, doc_no, unnest(regexp_extract_all(lower(body), '[a-z]+')) AS word FROM d),
         s AS (SELECT file_id, doc_no, avg(polarity) AS p, avg(subjectivity) AS s FROM w JOIN lex USING (word) GROUP BY ALL)
    SELECT d.file_id, CAST(d.doc_no AS BIGINT) AS doc_no, body, CAST(num_words AS INTEGER) AS num_words, email_title, date_time,
           document_idx, newspaper_title, round(p, 6) AS polarity, round(s, 6) AS subjectivity FROM d JOIN s USING (file_id, doc_no)
    """


def news_export(*ending):
    """A document row as an export."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return join_text(
        "<!-- <DOC NUMBER=28> -->\n<br>\n",
        '<div class="c0"><p class="c1"><span class="c2">1 of 2 DOCUMENTS</span></p>\n</div>\n<br>',
        '<div class="c0"><p class="c1"><span class="c2">Paper ', F.col("source"), "</span></p></div>",
        '<div class="c3"><p class="c1"><span class="c4">July</span><span class="c2"> 11, 1991, Thursday</span></p></div>',
        '<div class="c5"><p class="c6"><span class="c7">Title </span><span class="c8">', text("doc_id"), "</span></p></div>",
        '<div class="c5"><p class="c6"><span class="c9">LENGTH: </span><span class="c2">12 words</span></p></div>',
        '<div class="c5"><p class="c10"><span class="c4"></span><span class="c2">', escaped, "</span></p></div>\n",
        '<table class="c12"><tbody><tr><td>table of ', F.col("lang"), "</td></tr></tbody></table>",
        '<div class="c5"><span class="c2">not </span>a body</div> worst stray text <b>between</b> ',
        '<div class="c5"><span class="c4">stupid </span><span class="c2">end</span></div>',
        '<div class="c11">last</div>', *ending,
    )


@query("news_documents", _news_sql())
def _(t):
    # Every document row is an export of two documents, the second one not closed.
    html = news_export(
        '<div class="c0">2 of 2 DOCUMENTS</div><div class="c3">no closing mark</div>',
        '<div class="c5"><span class="c4">a </span><span class="c2">best day</span></div>',
    )
    exports = t.documents.select(text("doc_id").alias("file_id"), html.alias("html"))
    found = news.news_documents(exports, lexicon_frame(t.spark))
    return found.withColumns({"polarity": F.round("polarity", 6), "subjectivity": F.round("subjectivity", 6)})


@query(
    "news_export_files",
    f"SELECT body, num_words, email_title, date_time, document_idx, newspaper_title, polarity, subjectivity FROM ({_news_sql()}) WHERE doc_no = 0",
)
def _(t):
    # All document rows in a few long export files.
    path = scratch_path(t.spark, "export")
    t.documents.select(news_export()).write.text(path)
    found = news.news_documents_from_blocks(read_export_blocks(t.spark, path), lexicon_frame(t.spark))
    return found.select(
        "body", "num_words", "email_title", "date_time", "document_idx", "newspaper_title",
        F.round("polarity", 6).alias("polarity"), F.round("subjectivity", 6).alias("subjectivity"),
    )


@query(
    "load_work_items",
    f"""WITH s AS (SELECT 'c-' || c_custkey AS domain, c_acctbal AS price, TIMESTAMP '2024-01-01' AS scraped_at, c_custkey * 10000.0 AS wait_s,
                      c_mktsegment = 'BUILDING' AS done FROM customer WHERE c_acctbal > 1000),
             i AS (SELECT domain, max(price) AS price, max(wait_s) AS wait_s FROM (
                     SELECT 'c-' || c_custkey AS domain, c_custkey + 0.5 AS price,
                            CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_nationkey * 86400 + 3600 ELSE 0 END AS wait_s FROM customer
                     UNION ALL SELECT 'new-' || c_custkey, c_nationkey + 1, 0 FROM customer) GROUP BY domain)
        SELECT i.domain, CAST(CASE WHEN s.done THEN s.price ELSE i.price END AS DOUBLE) AS price,
               epoch_us(CASE WHEN s.done THEN s.scraped_at ELSE TIMESTAMP '{NOW}' END) AS scraped_us,
               CAST(CASE WHEN s.domain IS NULL THEN i.wait_s WHEN NOT s.done
                    THEN s.wait_s - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(s.scraped_at)) / 1e6 ELSE s.wait_s END AS DOUBLE) AS wait_s,
               coalesce(s.done, false) AS done
        FROM i LEFT JOIN s ON s.domain = i.domain""",
)
def _(t):
    key = text("c_custkey")
    requests = t.customer.select(
        F.col("c_custkey").alias("request_id"),
        # The same new item twice: the later price counts.
        join_text("c-", key, ",", key, ".50 new-", key, ",1 new-", key, ",", (F.col("c_nationkey") + 1).cast("string")).alias("pairs"),
    )
    durations = t.customer.where("c_mktsegment <> 'MACHINERY'").select(
        join_text("c-", key).alias("domain"), join_text(text("c_nationkey"), "d 1h").alias("time_left")
    )
    return plain_state(worktable.load_items(customer_state(t), requests, durations, now()))


LEFT = f"c_custkey * 10000.0 - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(TIMESTAMP '2024-01-01')) / 1e6"


@query("poll_state", f"""SELECT 'c-' || c_custkey AS domain, true AS done,
       CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey * 10000.0 ELSE {LEFT} END AS wait_s FROM customer""")
def _(t):
    _, state = worktable.poll(customer_state(t, known="true"), now())
    return state.select("domain", "done", "wait_s")


@query(
    "poll_plan",
    f"""WITH o AS (SELECT 'c-' || c_custkey AS domain, {LEFT} - 90 AS left_s FROM customer WHERE c_mktsegment <> 'BUILDING'),
             w AS (SELECT domain, left_s, lag(left_s - 300) OVER (ORDER BY left_s, domain) AS before FROM o WHERE left_s >= 300)
        SELECT domain, 'now' AS action, left_s, 0.0::DOUBLE AS delay_s FROM o WHERE left_s < 300
        UNION ALL SELECT domain, 'wait', left_s, left_s - 300 - coalesce(before, 0) FROM w""",
)
def _(t):
    # The plan is made a minute and a half after measuring.
    plan, _ = worktable.poll(customer_state(t, known="true"), now(), now() + F.expr("interval 90 seconds"))
    return plan.select("domain", "action", "left_s", "delay_s")
