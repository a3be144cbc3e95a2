"""Each stage on small documents, the whole of it on the test tables, and the registered queries."""

import corpus_pipeline as P
import pytest
from test_language import TEXTS

from pagemill.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in P.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "PII", "packing"]
    assert P.ORACLE_SQL is None


def test_queries():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture
def docs(spark, prose):
    long = "\n".join(prose(i, 40) for i in range(5))
    rows = [
        (1, TEXTS["en"] + "\nAll rights reserved 2020", "en", "a", 0),
        (2, TEXTS["de"] + "\nAll rights reserved 2021", "de", "a", 0),
        (3, TEXTS["fr"] + "\nAll rights reserved 2022", "fr", "a", 0),
        (4, "All rights reserved 1999", "en", "a", 0),
        (5, "### 123 ###", "en", "a", 0),
        (6, None, None, None, None),
        (7, long, "en", "a", 0),
        (8, long + " more", "en", "a", 0),
        (None, TEXTS["es"] + " write to ana@example.org", "es", "a", 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_stage_by_stage(spark, docs):
    known = P.language_id(spark, docs, "")
    assert known.columns == docs.columns
    assert sorted(str(r.doc_id) for r in known.collect()) == ["1", "2", "3", "4", "7", "8", "None"]
    lines = P.line_dedup(spark, known, "")
    assert lines.columns == docs.columns
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert 4 not in texts  # all it says stands elsewhere
    assert texts[1].endswith("2020") and texts[2] == TEXTS["de"] and texts[3] == TEXTS["fr"]
    assert {r.doc_id: r.n_chars for r in lines.collect()} == {k: len(t) for k, t in texts.items()}
    unique = P.simhash_dedup(spark, lines, "")
    assert unique.columns == docs.columns
    assert sorted(str(r.doc_id) for r in unique.collect()) == ["1", "2", "3", "7", "None"]
    clean = P.pii_redaction(spark, unique, "")
    assert clean.columns == docs.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[None] == TEXTS["es"] + " write to <EMAIL>" and text[3] == TEXTS["fr"]
    packed = P.packing(spark, clean, "").collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 7, None}


def test_empty_tables(spark, docs):
    out = docs.limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, out, "")
        assert out.count() == 0


def test_whole_pipeline(spark, sf):
    """The same rows as the stages one after the other, each on what was written before it."""
    out = P.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), SCHEMA)
    expected = {r.doc_id for r in docs.collect()}
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == expected
    for key in expected:
        mine = [r for r in pieces if r.doc_id == key]
        assert sum(r.length for r in mine) == mine[0].doc_tokens
