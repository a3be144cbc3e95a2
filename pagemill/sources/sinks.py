"""Writing records, routed folders, CSV and versions of a work table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.records import fill_missing, record_to_json
from pagemill.sources.readers import version_path


def write_json(df: DataFrame, path: str, compat: bool = False) -> None:
    """One JSON record per line; every key present, or '' for missing strings with ``compat``."""
    shaped = fill_missing(df) if compat else df
    shaped.select(record_to_json(F.struct(*shaped.columns)).alias("value")).write.text(path)


def write_routed(df: DataFrame, path: str, by: str = "outcome") -> None:
    """One folder per outcome."""
    df.write.partitionBy(by).json(path, ignoreNullFields=False)


# NULL is written as this text, so that it differs from an empty one.
NO_VALUE = "\u0001"
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "nullValue": NO_VALUE,
    "emptyValue": "",
}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose texts may hold quotes, line breaks and outer white space; '' and NULL stay apart."""
    df.write.options(**CSV_OPTIONS, quoteAll=True).csv(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    """What ``write_csv`` wrote."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=True).csv(path)


def write_work_table(df: DataFrame, root: str, version: int) -> str:
    """A full new version beside the others; never overwrites what the same job reads."""
    path = version_path(root, version)
    df.write.mode("overwrite").parquet(path)
    return path


def fan_out(rows: DataFrame, outputs: Mapping[str, Column], root: str) -> dict[str, str]:
    """Write several outputs of the same rows, each to its own folder below ``root``, in one pass.

    An output is a struct expression; rows where it is NULL give none.  Returns the folders.
    """
    lines = F.array(
        *[F.struct(F.lit(name).alias("output"), F.when(c.isNotNull(), record_to_json(c)).alias("value")) for name, c in outputs.items()]
    )
    each_output = rows.select(F.inline(lines)).where(F.col("value").isNotNull())
    each_output.write.partitionBy("output").text(root)
    return {name: f"{root.rstrip('/')}/output={name}" for name in outputs}
