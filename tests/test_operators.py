"""Joins, frontier, records, dates and the work table against small models."""

import random

import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import dates as D
from pagemill.functions import text as TX
from pagemill.operators import frontier as R
from pagemill.operators import lookup as L
from pagemill.operators import records as G
from pagemill.operators import schedule as C
from pagemill.operators import segment as S
from pagemill.operators.sentiment import lexicon_frame, lexicon_sentiment
from pagemill.plans import publications, worktable
from pagemill.session import scratch_path


def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expr(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("seed", range(4))
def test_convergence_model(spark, seed):
    """Visit pages until one adds no new link; that page is still visited."""
    rng = random.Random(seed)
    shown = {(f, p): [rng.randrange(6) for _ in range(rng.randrange(4))] for f in range(5) for p in range(1, 8)}
    wanted = set()
    for f in range(5):
        known = set()
        for p in range(1, 8):
            wanted.add((f, p))
            new = set(shown[f, p]) - known
            known |= new
            if not new:
                break
    links = spark.createDataFrame([(f, p, str(x)) for (f, p), xs in shown.items() for x in xs], "f int, p int, link string")
    visited = spark.createDataFrame(sorted(shown), "f int, p int")
    assert set(rows(R.converge_pages(links, visited, ["f"], "link", "p"))) == wanted


@pytest.mark.parametrize("n, parts", [(10, 3), (3, 5), (0, 4), (12, 4), (7, 1)])
@pytest.mark.parametrize("per_block", [2, 1000])
def test_even_split_model(spark, n, parts, per_block):
    k, m = divmod(n, parts)
    wanted = [(i, part + 1) for part in range(parts) for i in range(part * k + min(part, m), (part + 1) * k + min(part + 1, m))]
    got = C.even_split(spark.range(n), parts, ["id"], rows_per_block=per_block)
    assert rows(got) == sorted(wanted, key=repr)


@pytest.mark.parametrize("per_block", [3, 1000])
def test_segment_and_take_while_model(spark, per_block):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 4}", i, rng.random() < 0.2) for i in range(120)]
    doc, stopped, numbered, kept = {}, set(), set(), set()
    for key, i, end in data:
        numbered.add((key, i, doc.get(key, 0)))
        if end:
            doc[key] = doc.get(key, 0) + 1
            stopped.add(key)
        if key not in stopped:
            kept.add((key, i))
    df = spark.createDataFrame(data, "k string, i int, end boolean")
    assert set(rows(S.segment(df, F.col("end"), ["k"], ["i"], rows_per_block=per_block).select("k", "i", "doc_no"))) == numbered
    assert set(rows(S.take_while(df, F.col("end"), ["k"], ["i"]).select("k", "i"))) == kept


@pytest.mark.parametrize("per_block", [1, 10, 1000])
def test_ordered_concat_gives_one_text_per_group(spark, per_block):
    data = [("k", 99_990 + i, str(i)) for i in range(25)] + [("k", 7, None), ("other", 1, "x"), (None, 1, "n"), (None, 2, "m"), ("none", 1, None)]
    df = spark.createDataFrame(data, "k string, pos int, t string")
    got = S.ordered_concat(df.orderBy(F.desc("pos")), ["k"], ["pos"], "t", rows_per_block=per_block)
    assert rows(got) == sorted([(None, "n m"), ("k", " ".join(str(i) for i in range(25))), ("other", "x")], key=repr)


def test_gap_at_the_start(spark):
    df = spark.createDataFrame([(2,), (3,)], "i int")
    assert R.until_first_gap(df, "i", 1).count() == 0
    assert R.until_first_gap(df, "i", 2).count() == 2


def test_first_usable_tries_in_order(spark):
    pages = spark.createDataFrame([("a", 404, "x"), ("b", 200, "y"), ("c", 200, "z")], "url string, status int, body string")
    records = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["c", "b"]), (3, ["a"]), (4, [])], "id int, tries array<string>")
    got = L.first_usable(records, "id", F.col("tries"), pages, "url", F.col("status") != 404, ["body"]).select("id", "chosen_url", "body")
    assert rows(got) == [(1, "b", "y"), (2, "c", "z"), (3, None, None), (4, None, None)]


def test_zip_keeps_the_longer_side(spark):
    a = spark.createDataFrame([(5, "x"), (7, "y"), (9, "z")], "i int, a string")
    b = spark.createDataFrame([(1, "p")], "j int, b string")
    got = L.zip_by_position(a, b, ["i"], ["j"]).select("position", "a", "b")
    assert rows(got) == [(0, "x", "p"), (1, "y", None), (2, "z", None)]


def test_keep_last_and_first(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, "b"), ("k", 3, None), ("m", 1, "c")], "k string, i int, v string")
    assert rows(S.keep_last(df, ["k"], ["i"])) == [("k", 3, None), ("m", 1, "c")]
    assert rows(S.first_per(df, ["k"], ["i"])) == [("k", 1, None), ("m", 1, "c")]
    assert rows(S.last_in_segment(df, ["k"], ["i"], {"v": F.col("v")})) == [("k", "b"), ("m", "c")]


@pytest.mark.parametrize(
    "text, iso",
    [("March 7, 1998", "1998-03-07T00:00:00"), ("March 07, 1998", "1998-03-07T00:00:00"), ("7 March 1998", "1998-03-07T00:00:00"),
     ("Mar 7, 1998", "1998-03-07T00:00:00"), ("", None), ("March 1998", None), ("November 5-8, 2012", None), ("March 32, 1998", None), (None, None)],
)
def test_strict_dates(spark, text, iso):
    assert expr(spark, text, D.parse_date_iso) == iso


@pytest.mark.parametrize(
    "text, iso",
    [("July 11, 1991, Thursday, FINAL EDITION", "1991-07-11T00:00:00"), ("Held on 8 December 2004 at", "2004-12-08T00:00:00"),
     ("July 1991", None), ("12 words", None), ("May 2, 1999 and 3 June 2000", "1999-05-02T00:00:00")],
)
def test_fuzzy_dates(spark, text, iso):
    assert expr(spark, text, D.extract_date_fuzzy) == iso


def test_range_start(spark):
    assert expr(spark, "November 5-8, 2012", D.range_start) == "2012-11-05T00:00:00"
    assert expr(spark, "November 5, 2012", D.range_start) is None


@pytest.mark.parametrize("text, seconds", [("1w 2d 3h 4m 5s", 788645), ("5s 5s", 10), ("0s", 0), ("", 0), (None, 0), (" 2d ", 172800), ("x 3h", 10800)])
def test_durations(spark, text, seconds):
    assert expr(spark, text, D.duration_seconds) == seconds


@pytest.mark.parametrize("share, number", [("3", 3), ("1/3", 3), ("x", None), (None, None)])
def test_share(spark, share, number):
    assert expr(spark, share, TX.share_denominator) == number


def test_sentiment(spark):
    texts = ["Not good, no bad; not not great!", "goodness badly", "", "GOOD good\nbest", "never  worthless idiot", "no-good", "not", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = lexicon_sentiment(df, lexicon_frame(spark)).orderBy("doc_id").collect()
    assert [r.n_hits for r in got] == [3, 0, 0, 3, 2, 1, 0, 0]
    assert got[0].polarity == pytest.approx((-0.35 + 0.35 - 0.4) / 3)
    assert got[4].polarity == pytest.approx((0.4 - 0.8) / 2) and got[6].polarity == 0.0


def test_sentiment_with_any_list(spark):
    """Thousands of words, and entries that are no words."""
    words = [(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", 0.5, 1.0) for i in range(5000)]
    listed = spark.createDataFrame([*words, ("c++", -1.0, 0.0), (".*", -1.0, 0.0)], "word string, polarity double, subjectivity double")
    df = spark.createDataFrame([(1, "c c++ waaa xwaaa"), (2, "c++")], "doc_id int, text string")
    got = {r.doc_id: (r.polarity, r.n_hits) for r in lexicon_sentiment(df, listed).collect()}
    assert got == {1: (0.5, 1), 2: (0.0, 0)}


def state(spark, *items):
    return spark.createDataFrame(list(items), "domain string, price string, scraped string, wait_s double, done boolean").select(
        "domain", F.col("price").cast("decimal(12,2)").alias("price"), F.col("scraped").cast("timestamp").alias("scraped_at"), "wait_s", "done"
    )


@pytest.mark.parametrize("per_block", [1, 1000])
def test_due_plan(spark, per_block):
    day = 86400.0
    left = {"past": -5.0, "zero": 0.0, "a29": 29.0, "a30": 30.0, "a299": 299.0, "b300": 300.0, "b301": 301.0, "c900": 900.0, "c900b": 900.0}
    df = state(spark, *[(k, "1", "2024-01-01", day + v, False) for k, v in left.items()], ("done", "1", "2024-01-01", 0.0, True))
    got = {r.domain: r for r in C.due_plan(df, now(), rows_per_block=per_block).collect()}
    assert set(got) == set(left)
    assert {k: r.left_s for k, r in got.items()} == left
    assert {k for k, r in got.items() if r.action == "now"} == {"past", "zero", "a29", "a30", "a299"}
    # Waiting for one item counts for the next: the delays add up to each item's time.
    assert {k: r.delay_s for k, r in got.items() if r.action == "wait"} == {"b300": 0.0, "b301": 1.0, "c900": 599.0, "c900b": 0.0}


def test_upsert(spark):
    known = state(spark, ("open", "1", "2024-01-01", 100000.0, False), ("done", "2", "2024-01-01", 5.0, True), ("rest", "3", "2024-01-01", 7.0, False))
    incoming = spark.createDataFrame(
        [("open", "9", 0, 1), ("done", "9", 0, 1), ("new", "4", 60, 1), ("new", "5", 61, 2)], "domain string, price string, wait_s int, seq int"
    ).withColumn("price", F.col("price").cast("decimal(12,2)"))
    got = C.upsert_items(known, incoming, now(), order=["seq"])
    assert rows(got.select("domain", F.col("price").cast("int"), F.dayofmonth("scraped_at"), "wait_s", "done")) == [
        ("done", 2, 1, 5.0, True), ("new", 5, 2, 61.0, False), ("open", 9, 2, 13600.0, False), ("rest", 3, 1, 7.0, False),
    ]
    assert got.schema.simpleString() == known.schema.simpleString()


def test_load_and_poll(spark):
    empty = state(spark)
    requests = spark.createDataFrame([(1, "a.com,10 b.com,20 a.com,30"), (2, "b.com,25")], "request_id int, pairs string")
    durations = spark.createDataFrame([("a.com", "1h 5m")], "domain string, time_left string")
    loaded = worktable.load_items(empty, requests, durations, now())
    assert rows(loaded.select("domain", F.col("price").cast("int"), "wait_s", "done")) == [("a.com", 30, 3900.0, False), ("b.com", 25, 0.0, False)]
    plan, after = worktable.poll(loaded, now())
    assert rows(plan.select("domain", "action", "delay_s")) == [("a.com", "wait", 3600.0), ("b.com", "now", 0.0)]
    assert rows(after.select("domain", "done")) == [("a.com", True), ("b.com", True)]
    assert worktable.poll(after, now())[0].count() == 0


def test_generations(spark):
    flat = spark.createDataFrame([tuple("" if f != "url" else "u1" for f in G.FLAT_FIELDS)], G.flat_schema())
    texts = [f'{{"url":"{u}","external_id":"src_A-b","words":"text","meta":{{"s":{{"volume":"4"}}}}}}' for u in ("u1", "u2")]
    path = scratch_path(spark, "nested")
    spark.createDataFrame([(t,) for t in texts], "value string").write.text(path)
    nested = spark.read.schema(G.nested_schema("s")).json(path)
    both = G.union_generations(flat, nested, "s", "src_")
    assert both.count() == 3
    assert rows(G.dedup_generations(both).select("url", "generation", "title", "volume", "pdf_text")) == [
        ("u1", 2, "A b", "4", "text"), ("u2", 2, "A b", "4", "text"),
    ]


def test_publication_routing(spark):
    def page(i, *labels):
        return (f"http://e/x?pub_id={i}", '<table class="pubDisplay">' + "".join(f"<tr><th>{a}</th><td>{b}</td></tr>" for a, b in labels) + "</table>")

    doi = ("DOI:", '<a href="http://d/1">x</a>')
    df = spark.createDataFrame(
        [page(1, ("Title:", "A b"), doi), page(2, doi), page(3, ("PDF version:", "yes"), ("Dates:", "")), page(4, ("Title:", "t")), page(5, doi)],
        "url string, html string",
    )
    texts = spark.createDataFrame([("http://d/1", "1.pdf", "t\n x"), ("b2", "2.pdf", None), ("b3", "3.pdf", ""), ("b4", "4.pdf", "four")], "link string, file_name string, text string")
    got = publications.publication_records(publications.publication_fields(df.where("url not like '%2'")), texts, "b", "s", "src_")
    by = {r.url[-1]: r for r in got.collect()}
    assert {k: (r.outcome, r.reason) for k, r in by.items()} == {
        "1": ("success", None), "3": ("success", "attachment_empty"), "4": ("failures", "no_link_label"), "5": ("success", None),
    }
    assert (by["1"].external_id, by["1"].words, by["1"].file_name) == ("src_A-b", "t x", "A_b.json")
    assert (by["3"].title, by["3"].meta.s.dates) == (" ", None)


def test_items_without_a_mark_are_open(spark):
    schema = "domain string, price decimal(12,2), scraped_at timestamp, wait_s double, done boolean"
    at = F.lit("2024-01-02 00:00:00").cast("timestamp")
    state = spark.createDataFrame([("a", 1), ("b", 2)], "domain string, p int").select(
        "domain", F.col("p").cast("decimal(12,2)").alias("price"), at.alias("scraped_at"), F.lit(50.0).alias("wait_s"),
        F.lit(None).cast("boolean").alias("done"),
    )
    incoming = spark.createDataFrame([("b", 9, 7.0, 1)], "domain string, price int, wait_s double, seq int")
    from pagemill.operators.schedule import mark_done, upsert_items

    got = {r.domain: r for r in upsert_items(state, incoming, at, ["seq"]).collect()}
    assert [(got[d].price, got[d].wait_s, got[d].done) for d in "ab"] == [(1, 50.0, False), (9, 50.0, False)]
    assert got["a"].scraped_at == got["b"].scraped_at
    marked = mark_done(state, incoming.select("domain"))
    assert {r.domain: r.done for r in marked.collect()} == {"a": False, "b": True}
    assert upsert_items(state.limit(0), incoming, at, ["seq"]).schema.simpleString().startswith("struct<domain:string")
    assert spark.createDataFrame([], schema).columns == upsert_items(state, incoming, at, ["seq"]).columns


def test_tags_with_very_many_attributes(spark):
    from pagemill.functions import html as H

    many = " ".join(f'a{i}="{i}>"' for i in range(100_000))
    tags = [f"<a {many} href='x'>t", f"<a {many}>", f"<a href {many} HREF = y z>", '<a data-href="no" href="">', "<a href=1 href=2>", "<a/href='q'/>"]
    df = spark.createDataFrame(list(enumerate(tags)), "i int, tag string")
    got = [r.h for r in df.select("i", H.attr(F.col("tag"), "href").alias("h")).orderBy("i").collect()]
    assert got == ["x", None, "y", None, "1", "q"]


def slow_scores(text, entries, negators, intensifiers):
    words = re.findall("[a-z]+", text.lower())
    found, i = [], 0
    while i < len(words):
        size = next((n for n in (3, 2, 1) if " ".join(words[i : i + n]) in entries and i + n <= len(words)), 0)
        if not size:
            i += 1
            continue
        p, s = entries[" ".join(words[i : i + size])]
        before, two = (words[i - 1] if i else ""), (words[i - 2] if i > 1 else "")
        if before in intensifiers:
            p *= intensifiers[before]
            p *= -0.5 if two in negators else 1
        elif before in negators:
            p *= -0.5
        found.append((p, s))
        i += size
    n = len(found)
    return (round(sum(p for p, _ in found) / n, 9), round(sum(s for _, s in found) / n, 9), n) if n else (0.0, 0.0, 0)


def test_phrases_by_reading_word_after_word(spark):
    import random

    entries = {"good": (0.5, 0.4), "not bad": (0.6, 0.3), "good for nothing": (-0.9, 0.9), "bad": (-0.7, 0.6), "bad day": (-0.8, 0.2), "x1": (1.0, 1.0)}
    negators, intensifiers = ("not", "no"), {"very": 1.5, "so": 1.2}
    rng = random.Random(4)
    words = ["good", "bad", "not", "no", "very", "so", "for", "nothing", "day", "other", "goods", "Good", "x1"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", ". "]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["good" * 1000, "not " * 20_000 + "good", "no not good", "bad day" * 2, ""]
    # "so" and "very" are told apart from the words that end an entry: none of them is in one.
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id int, text string")
    rows = [(w, p, s) for w, (p, s) in entries.items()]
    lexicon = spark.createDataFrame(rows, "word string, polarity double, subjectivity double")
    got = {r.doc_id: (round(r.polarity, 9), round(r.subjectivity, 9), r.n_hits)
           for r in lexicon_sentiment(docs, lexicon, negators=negators, intensifiers=intensifiers).collect()}
    assert got == {-1: (0.0, 0.0, 0), **{i: slow_scores(t, entries, negators, intensifiers) for i, t in enumerate(texts)}}


def test_long_lists_meet_words_in_a_join(spark):
    docs = spark.createDataFrame([(1, "w7 alpha not beta"), (2, "none")], "doc_id int, text string")
    small = [("alpha", 1.0, 0.5), ("beta", 0.5, 0.1)]
    filler = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) + "zz" for i in range(600)]
    long = spark.createDataFrame(small + [(w, 0.1, 0.1) for w in filler], "word string, polarity double, subjectivity double")
    short = spark.createDataFrame(small, "word string, polarity double, subjectivity double")
    assert sorted(map(tuple, lexicon_sentiment(docs, long).collect())) == sorted(map(tuple, lexicon_sentiment(docs, short).collect()))
    with pytest.raises(ValueError):
        lexicon_sentiment(docs, long, intensifiers={"very": 2.0})


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_links_by_sketch(spark, bits):
    """A full sketch lets everything through to the exact join, a roomy one little more than what was seen."""
    seen = spark.range(0, 2000).select((F.col("id") % 10).alias("host"), F.concat(F.lit("/"), F.col("id").cast("string")).alias("href"))
    links = spark.range(1500, 9500).select((F.col("id") % 10).alias("host"), F.concat(F.lit("/"), F.col("id").cast("string")).alias("href"))
    links = links.unionByName(links.limit(50)).unionByName(spark.sql("select 1L host, cast(null as string) href"))
    keys = ["host", "href"]
    got = R.unseen_by_sketch(links, seen, keys, bits=bits)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, R.unseen(links, seen, keys).collect()), key=repr)
    through = R.maybe_seen(links.distinct(), seen, keys, "m", bits=bits).where("m").count()
    assert through >= 500 if bits == 64 else 500 <= through <= 520
    nothing = seen.limit(0)
    assert R.unseen_by_sketch(links, nothing, keys, bits=bits).count() == links.distinct().count()
    assert R.unseen_by_sketch(nothing, seen, keys, bits=bits).count() == 0


def test_entities_of_every_kind(spark):
    given = "&eacute;&amp;lt; &#65;&#x41;&#X42; &#150; &#0; &#xD800; &#x110000; &nope; &#; &;&#12345678; a&nbsp;b &AMP;"
    wanted = "é&lt; AAB – � � � &nope; &#; &;&#12345678; a b &AMP;"
    rows = spark.createDataFrame([(given,), ("none",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(TX.entity_decode(F.col("t"))).collect()] == [wanted, "none", None, ""]
