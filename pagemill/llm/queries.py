"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.html import TAG, strip_noise
from pagemill.llm.collocations import collocations
from pagemill.llm.common import ready
from pagemill.llm.katz import katz_scores
from pagemill.llm.language import fit_on, host_of, identify
from pagemill.llm.line_templates import without_repeated_lines
from pagemill.llm.packing import pack
from pagemill.llm.piece_codec import coded
from pagemill.llm.pii import BASE, digest, find_spans
from pagemill.llm.pivot_lists import similar_vectors
from pagemill.llm.projections import nearest_neighbours
from pagemill.llm.simhash import simhash_components
from pagemill.llm.spelling import spelling_variants
from pagemill.llm.token_counts import section_token_counts
from pagemill.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable) -> Callable:
    """Register a function of a table reader under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready(spark)
        return build(lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return run


@query
def op3_simhash(read):
    """Near-duplicate components of all documents by 64-bit fingerprints."""
    return simhash_components(read("documents"))


@query
def op10_pivot_lists(read):
    """Links and components of all embeddings with a cosine of 0.9 or more."""
    return similar_vectors(read("embeddings"))


@query
def op9_projections(read):
    """The 10 nearest other vectors of every hundredth embedding."""
    return nearest_neighbours(read("embeddings"), F.col("vec_id") % 100 == 0)


@query
def op5_packing(read):
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(read("documents"), public_tokenizers.path("word_bpe_49k.json"))


def _remainder(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 4


@query
def op1_toxicity(read):
    """Toxicity of all documents, learned from three quarters of the labels."""
    docs = read("documents")
    scored = toxicity(docs, read("labels"), _remainder() != 2)
    return scored.select(
        "doc_id", F.coalesce(_remainder() == 2, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@query
def op8_language(read):
    """Language of all documents and all pages: texts, declared languages, suffixes and hosts."""
    docs, pages = read("documents"), read("pages")
    nothing, no_id = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    declared = F.nullif(F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1), F.lit(""))
    texts = docs.select(
        "doc_id", no_id.alias("page_id"), "text", F.col("source").alias("host"), nothing.alias("declared")
    ).unionByName(
        pages.select(
            no_id.alias("doc_id"),
            "page_id",
            F.regexp_replace(strip_noise(F.col("html")), TAG, " ").alias("text"),
            host_of(F.col("url")).alias("host"),
            declared.alias("declared"),
        )
    )
    return identify(texts, fit_on(docs), ["doc_id", "page_id"], host=F.col("host"), declared=F.col("declared"))


@query
def op7_line_templates(read):
    """All documents without the lines of templates that recur across documents."""
    cleaned = without_repeated_lines(read("documents"))
    return cleaned.select(
        "doc_id",
        F.col("__lines").cast("bigint").alias("n_lines"),
        F.col("__dropped").cast("bigint").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


@query
def op2_personal_data(read):
    """Personal data in all documents: counts by base kind, and digests of the spans."""
    found = find_spans(read("documents"), ["doc_id"])
    kinds = [kind.name for kind in BASE]

    def of(name: str):
        return F.filter("spans", lambda s: s["kind"] == name)

    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(name)).cast("bigint").alias(f"n_{name}") for name in kinds],
        F.sha2(digest(base), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )


@query
def op4_pieces(read):
    """All documents encoded into pieces and decoded again."""
    return coded(read("documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_section_tokens(read):
    """Tokens of every line of all documents, from one encoding of each document."""
    return section_token_counts(
        read("documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query
def op13_spelling(read):
    """Words of all documents, the words one edit away, and the frequent form each belongs to."""
    return spelling_variants(read("documents"))


@query
def op12_katz(read):
    """Log probabilities of all documents under a backoff model of those whose hash modulo 7 is not 2."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 7
    # A document without an id is not held out.
    return katz_scores(read("documents"), F.coalesce(remainder != 2, F.lit(True)))


@query
def op11_collocations(read):
    """The best phrases of two to four words of each language, over all documents."""
    return collocations(read("documents"))
