"""Record shaping, routing and the two record generations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields of a flat record.
FLAT_FIELDS = (
    "abstract", "authors", "citation", "dates", "issue", "keywords", "location", "pages",
    "pdf_filename", "pdf_text", "proceedings", "published", "title", "url", "volume",
)
# Fields of the nested record's inner struct.
META_FIELDS = (
    "citation", "volume", "pdf_filename", "authors", "keywords", "pages", "dates",
    "proceedings", "location", "issue",
)


def flat_schema() -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in FLAT_FIELDS])


def nested_schema(origin: str) -> T.StructType:
    """``abstract, external_id, date, url, words, meta.<origin>.{…}``"""
    inner = T.StructType([T.StructField(f, T.StringType()) for f in META_FIELDS])
    top = [T.StructField(f, T.StringType()) for f in ("abstract", "external_id", "date", "url", "words")]
    return T.StructType([*top, T.StructField("meta", T.StructType([T.StructField(origin, inner)]))])


def record_to_json(record: Column) -> Column:
    """Record as JSON text with every key present, ``null`` where there is no value."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def fill_missing(df: DataFrame, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Replace NULL by '' (or the given default) in texts, for sinks that know no NULL.

    Goes through structs and arrays; a default is given by the dotted path of a field.  A missing
    struct becomes one with empty texts, a missing array stays missing.
    """
    defaults = defaults or {}

    def filled(c: Column, kind: T.DataType, path: str) -> Column:
        if isinstance(kind, T.StringType):
            return F.coalesce(c, F.lit(defaults.get(path, "")))
        if isinstance(kind, T.StructType):
            return F.struct(*[filled(c[f.name], f.dataType, f"{path}.{f.name}").alias(f.name) for f in kind])
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: filled(x, kind.elementType, path))
        return c

    return df.select(*[filled(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema])


def title_of(external_id: Column, id_prefix: str) -> Column:
    """Title of a nested record from its external id.

    Spaces were written as dashes and come back as spaces, so a title with
    dashes of its own is not restored exactly.
    """
    bare = F.when(external_id.startswith(id_prefix), F.substring(external_id, len(id_prefix) + 1, 1 << 30))
    return F.replace(bare.otherwise(external_id), F.lit("-"), F.lit(" "))


def union_generations(flat: DataFrame, nested: DataFrame, origin: str, id_prefix: str) -> DataFrame:
    """Both record generations in the flat shape, with the generation number."""
    old = flat.withColumn("generation", F.lit(1))
    new = nested.select(
        "abstract",
        "url",
        F.col("date").alias("published"),
        F.col("words").alias("pdf_text"),
        title_of(F.col("external_id"), id_prefix).alias("title"),
        *[F.col(f"meta.{origin}.{f}").alias(f) for f in META_FIELDS],
        F.lit(2).alias("generation"),
    )
    return old.unionByName(new, allowMissingColumns=True)


def dedup_generations(records: DataFrame, key: str = "url") -> DataFrame:
    """One record per key, the newest generation, of equal ones the last by content; records without a key all stay."""
    rest = [c for c in records.columns if c != key]
    newest = F.struct("generation", *[c for c in rest if c != "generation"])
    known = (
        records.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), newest).alias("__r"))
        .select(key, "__r.*")
    )
    return known.unionByName(records.where(F.col(key).isNull()))


def route_outcome(df: DataFrame, success: Column, reasons: Mapping[str, Column]) -> DataFrame:
    """Add ``outcome`` (success or failures) and ``reason``, the first condition that holds."""
    reason = None
    for name, cond in reasons.items():
        reason = F.when(cond, F.lit(name)) if reason is None else reason.when(cond, F.lit(name))
    out = F.when(F.coalesce(success, F.lit(False)), F.lit("success")).otherwise(F.lit("failures"))
    return df.withColumn("outcome", out).withColumn("reason", reason)


def observe_outcomes(df: DataFrame, observation: Observation, outcomes: Sequence[str] = ("success", "failures")) -> DataFrame:
    """Count records and outcomes while the rows pass on to a sink; read them from ``observation.get``."""
    counts = [F.count_if(F.col("outcome") == name).alias(name) for name in outcomes]
    return df.observe(observation, F.count(F.lit(1)).alias("records"), *counts)


def outcome_counts(df: DataFrame, by: Sequence[str] = ("outcome",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def collection_to_json(c: Column) -> Column:
    return F.to_json(c)
