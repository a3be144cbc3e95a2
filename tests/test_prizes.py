"""Prize records: fallbacks, precedence, and nothing carried over between persons."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill.plans import fellows, prizes

BASE = "http://e/p"


@pytest.fixture(scope="module")
def records(spark):
    def person(i, **more):
        return {"id": i, "firstname": f"F{i}", "surname": f"Süd{i}", "motivation": f"listed {i}", **more}

    lists = [
        {"prizes": [{"category": "economics", "year": "1969", "laureates": [person("1", share="2"), person("2")]},
                    {"category": "peace", "year": "1970", "laureates": [person("1", share="1"), {"id": "3"}]}]},
        {"prizes": []},
    ]
    details = {
        "1": {"gender": "f", "died": "0000-00-00", "born": "1900-01-02", "prizes": [
            {"year": "1969", "motivation": " first ", "affiliations": [{"name": "U", "city": "C"}]}, {"year": "1970", "motivation": "second", "affiliations": [[]]}]},
        "2": {"gender": "m", "died": "1990-03-04", "prizes": [{"year": "1969", "affiliations": ""}]},
    }
    one, two, peace = (f"{BASE}/{a}/laureates/{y}/süd{i}" for a, y, i in (("economic-sciences", 1969, 1), ("economic-sciences", 1969, 2), ("peace", 1970, 1)))
    block = '<div class="laureate_prize_title"><span>{}</span>\n{}\n</div>'
    pages = [
        (one + "-bio.html", 200, "<h1> One </h1><p>a\r\nb  c</p><p>é</p>" + block.format("from bio", "with two")),
        (one + "-speech.html", 404, "<h1>S</h1><p>gone</p>"),
        (one + "-speech_en.html", 200, "<h1>S</h1><p class='smalltext'>Town, December 10, 1969</p><p>said</p>" + block.format("from speech", "")),
        (one + "-lecture.html", 200, "<div class='video_main'>Held on 8 December 1969, at</div>" + block.format("from lecture", "alone")),
        (one + "-facts.html", 200, "<div class='laureate_info_wrapper'><div></div><p><strong>Field:</strong> trade</p></div><p><strong>Contribution:</strong> no</p>"),
        (two + "-bio.html", 200, "<h1>Page Not Found</h1><p>nothing</p>" + block.format("leak", "leak")),
        (two + "-facts.html", 200, "Page Not Found"),
        (two + "-facts_en.html", 200, "<div class='laureate_info_wrapper'><p><strong>Contribution:</strong> games: many</p></div>"),
        (peace + "-speech.html", 200, "<p>Read the Banquet Speech</p><h1>x</h1>"),
    ]
    talks = [(one + "-lecture.pdf", "the  talk"), (one + "-lecture_en.pdf", "translated"), (two + "-lecture_en.pdf", "two's")]
    got = prizes.prize_records(
        spark.createDataFrame([(json.dumps(x),) for x in lists], "doc string").select(F.from_json("doc", prizes_schema()).alias("d")).select("d.prizes"),
        spark.createDataFrame([(k, json.dumps({"laureates": [v]})) for k, v in details.items()], "id string, detail string"),
        spark.createDataFrame(pages, "url string, status int, html string"),
        spark.createDataFrame(talks, "url string, words string"),
        BASE,
    )
    return {(r.id, r.year): r for r in got.collect()}


def prizes_schema():
    from pagemill.sources.readers import LIST_SCHEMA

    return LIST_SCHEMA


def test_every_listed_person_has_a_record_per_prize(records):
    assert set(records) == {("1", "1969"), ("2", "1969"), ("1", "1970"), ("3", "1970")}
    assert len(records["1", "1969"]) == 25


def test_full_record(records):
    r = records["1", "1969"]
    assert (r.area, r.share, r.last_name, r.gender, r.death_date, r.birth_date) == ("economic-sciences", "1/2", "Sud1", "f", None, "1900-01-02")
    assert (r.motivation, [a.name for a in r.affiliations]) == ("first", ["U"])
    assert (r.bio.title, r.bio.words) == ("One", "a b c e")
    assert (r.speech.words, r.speech.date, r.speech.url[-15:], r.speech.location) == ("Town, December 10, 1969 said", "1969-12-10T00:00:00", "-speech_en.html", "Stockholm")
    assert (r.lecture.words, r.lecture.date, r.lecture.url[-12:]) == ("the talk", "1969-12-08T00:00:00", "-lecture.pdf")
    # The label outside the facts box does not count.
    assert (r.prize_title, r.co_winners, r.field, r.contribution) == ("from lecture", "alone", "trade", None)


def test_nothing_leaks_from_unusable_pages_or_other_persons(records):
    r = records["2", "1969"]
    assert (r.bio.words, r.bio.url, r.prize_title, r.field, r.contribution) == (None, None, None, None, "games")
    assert (r.lecture.words, r.lecture.date, r.speech.location, r.affiliations, r.share) == ("two's", None, None, None, None)
    assert (r.motivation, r.death_date) == ("listed 2", "1990-03-04")
    r = records["1", "1970"]
    assert (r.motivation, r.affiliations, r.speech.words, r.bio.words, r.timeline) == ("second", None, None, None, None)
    r = records["3", "1970"]
    assert (r.first_name, r.last_name, r.gender, r.bio.words) == (None, None, None, None)


def test_motivation_of_the_first_prize(spark):
    lists = spark.createDataFrame([('{"prizes":[{"category":"c","year":"2","laureates":[{"id":"1","motivation":"l"}]}]}',)], "doc string")
    details = spark.createDataFrame([("1", '{"laureates":[{"prizes":[{"year":"1","motivation":"a"},{"year":"2","motivation":"b"}]}]}')], "id string, detail string")
    parsed = lists.select(F.from_json("doc", prizes_schema()).alias("d")).select("d.prizes")
    assert prizes.people(parsed, details).first().motivation == "b"
    assert prizes.people(parsed, details, first_prize_only=True).first().motivation == "a"


def test_fellow_page_with_gaps(spark):
    html = (
        "<div class='fellow-information'><div class='x'></div><h1>José R.</h1><h6>Published May 2</h6><p>School</p><p>Place</p><p>Age: 44 at time</p></div>"
        "<div class='promo default in-the-media '><h3>Tïtle</h3><a class='b icon' href='/m'>x</a></div>"
    )
    df = spark.createDataFrame([(1, "u", html), (2, "v", "<p>Age: 3</p>")], "fellow_id int, url string, html string")
    got = {r.fellow_id: r for r in fellows.fellow_summaries(df, "http://e").collect()}
    r = got[1]
    assert (r.fellow_name, r.fellow_title, r.pub_date, r.fellow_designation, r.fellow_school, r.fellow_location, r.fellow_age) == (
        "Jose R.", None, "May 2", None, "School", "Place", "44",
    )
    assert (r.fellow_photos, r.fellow_deceased, r.file_name) == ({}, None, "Jos_R._summary.json")
    assert got[2].fellow_age is None and got[2].fellow_name is None
    articles = spark.createDataFrame([], "url string, html string")
    media = fellows.fellow_media(df, articles).collect()
    assert [(m.fellow_id, m.article_link, m.title, m.file_name) for m in media] == [(1, "/m", "Title", "Jos_R._media_Title.json")]
