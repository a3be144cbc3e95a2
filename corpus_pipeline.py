"""A corpus from raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
below the shared folder and reads again as the next stage's documents.  All but
the last return the columns of ``documents``; where a stage changes ``text``,
``n_chars`` follows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import ready, staged
from pagemill.llm.language import keep_known
from pagemill.llm.line_templates import without_repeated_lines
from pagemill.llm.packing import pack
from pagemill.llm.pii import redacted
from pagemill.llm.simhash import one_per_group

TOKENIZER = "word_bpe_49k.json"


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, with ``n_chars`` counted again where there is such a column."""
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(kind))
    return docs.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    ready(spark)
    return keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur elsewhere; those of which nothing is left go, as it stands elsewhere."""
    ready(spark)
    cleaned = without_repeated_lines(docs)
    left = F.col("text").rlike(r"\S") | (F.col("__dropped") == 0)
    return _with_text(cleaned.where(F.coalesce(left, F.lit(True))), docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ready(spark)
    return one_per_group(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the names of their kinds."""
    ready(spark)
    changed = docs.select(*[redacted(F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns])
    return _with_text(changed, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 4096 tokens."""
    ready(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("PII", pii_redaction),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


# Fingerprints, trigram models and token ids cannot be expressed in SQL.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
