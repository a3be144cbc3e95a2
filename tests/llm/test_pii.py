import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import pii as P
from pagemill.llm.queries import QUERIES

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, match):
    number = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 8 <= len(number) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
        return 16 <= len(number) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return True


def slow(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in p.finditer(text or "") if passes(k, m.group())]


TEXTS = [
    None, "", "nothing", "a@b.co", "a@b.c_d@e.f", "x@y", "a@b.c@d.e", ".@-.-", "a..b@c..d", "é ü@x.y ß a%+-@b-.c", "a@b.com.",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "1.2.3.0255", "00001.2.3.4", "99999999999999999999.1.1.1", "1..2.3.4 1.2.3", "v1.2.3.4x",
    "4111111111111111", "4111 1111-1111 1111", "4111  1111 1111 1111", "41111111111111111111", "1 4111111111111111", "4111111111111112", "0000000000000000000",
    "6 4111111111111111 7", "4111111111111111-", "-4111111111111111 ", "x4111111111111111x 4111111111111111",
    "+1 (743) 555-3824", "+1 ", "+12 ... 3456789", "+1234567", "+123456789012345 6", "++49 30 1234567", "+1 2 3 4 5 6 7 8)", "+4111111111111111",
    "🙂 a@b.co 🙂 1.2.3.4 日本 +1 555 123 4567", "mark \x01 a@b.co \x01\x02 1.2.3.4", "\x01", "a@b.co\n1.2.3.4\n" * 300,
]


def found(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = P.find_spans(docs, ["doc_id"], **options).orderBy("doc_id")
    return [r.d for r in out.select(P.digest(F.col("spans")).alias("d")).collect()]


def test_base_spans(spark):
    assert found(spark, TEXTS, extra=()) == [",".join(slow(t)) for t in TEXTS]


def test_base_spans_of_random_texts(spark):
    rng = random.Random(11)
    parts = ["1", "23", "255", "411111111111111", "1", ".", ".", "@", "-", " ", "+", "(", ")", "a", "B_", "%", "é", "🙂", "\n", "x.y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    assert found(spark, texts, extra=()) == [",".join(slow(t)) for t in texts]


@pytest.mark.parametrize(
    "text, spans",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 ok", "iban:5:32"),
        ("GB29NWBK60161331926819", "iban:0:22"),
        ("GB29NWBK60161331926818", ""),
        ("social security 123-45-6789", "ssn:16:27"),
        ("number 123-45-6789", ""),
        ("ssn 000-45-6789 666-45-6789 123-00-6789", ""),
    ],
)
def test_further_kinds(spark, text, spans):
    assert found(spark, [text]) == [spans]


def test_context_raises_scores(spark):
    docs = spark.createDataFrame([(1, "call +1 555 123 4567"), (2, "xx +1 555 123 4567")], "doc_id int, text string")
    scores = [r.spans[0].score for r in P.find_spans(docs, ["doc_id"]).orderBy("doc_id").collect()]
    assert scores == [pytest.approx(0.9), pytest.approx(0.6)]


def test_long_runs_take_no_quadratic_time(spark):
    """A hundred thousand characters that begin like a match and are none."""
    assert found(spark, ["a" * 100_000 + " @", "1" * 100_000 + ".", "+" * 100_000, "1.2.3." * 30_000, "a@" * 50_000]) == [""] * 3 + [
        ",".join(slow("1.2.3." * 30_000)),
        "",
    ]


def test_redaction(spark):
    texts = ["write a@b.co, call +1 555 123 4567!", "4111 1111 1111 1111 1.2.3.4", "IBAN DE89 3704 0044 0532 0130 00", "ssn 123-45-6789, 123-45-6789" + "." * 50 + "123-45-6789", "none", None, "", "300.1.1.1 4111111111111112"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = [r.t for r in docs.select("doc_id", P.redacted(F.col("text")).alias("t")).orderBy("doc_id").collect()]
    assert out == [
        "write <EMAIL>, call <PHONE>!", "<CARD> <IP>", "IBAN <IBAN>", "ssn <SSN>, <SSN>" + "." * 50 + "123-45-6789", "none", None, "", "300.1.1.1 4111111111111112",
    ]


def test_context_reaches_across_matches(spark):
    """A context word counts within 40 characters even if other matches of the kind lie between."""
    text = "ssn 123-45-6789, 123-45-6780 and 123-45-6781 " + "." * 40 + " 123-45-6782"
    assert found(spark, [text]) == ["ssn:4:15,ssn:17:28,ssn:33:44"]


def test_thousands_of_labels(spark):
    """Neither finding nor redacting goes deeper with every label."""
    text = "write a@b" + ".b" * 100_000 + " now"
    assert found(spark, [text]) == [f"email:6:{9 + 200_000}"]
    docs = spark.createDataFrame([(text,)], "text string")
    assert docs.select(P.redacted(F.col("text")).alias("t")).first().t == "write <EMAIL> now"


@pytest.mark.parametrize("text", ["a\u0001b", "\u0001\u0002\u0003\u0004", "\u0002\u0003 \u0002\u0004", "x\u0001a@b.co\u0002"])
def test_control_characters_stay(spark, text):
    out = spark.createDataFrame([(text,)], "text string").select(P.redacted(F.col("text")).alias("t")).first().t
    assert out == text.replace("a@b.co", "<EMAIL>")


def test_rows_and_columns(spark):
    rows = [(1, "a@b.co", "x"), (1, "a@b.co", "x"), (None, "1.2.3.4", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    out = P.find_spans(docs, ["doc_id"])
    assert out.columns == ["doc_id", "spans"]
    assert sorted(str(r.doc_id) + r.spans[0].kind for r in out.collect()) == ["1email", "1email", "Noneip"]
    assert P.find_spans(docs.limit(0), ["doc_id"]).count() == 0


def test_query(spark, sf):
    out = {r.doc_id: r for r in QUERIES["op2_personal_data"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        base, row = slow(d.text), out[d.doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert row.spans.startswith(",".join(base))
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k + ":") for s in base) for k in PATTERNS]
