"""Reading seeds, nested JSON, landed pages, attachments, work tables and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.html import blocks_of
from pagemill.functions.text import strip
from pagemill.operators.rows import each
from pagemill.operators.records import META_FIELDS, flat_schema, nested_schema, title_of

SEED_SCHEMA = "research_id int, research_name string"

LIST_SCHEMA = (
    "prizes array<struct<category string, year string, laureates array<struct<"
    "id string, share string, motivation string, firstname string, surname string>>>>"
)
DETAIL_SCHEMA = (
    "laureates array<struct<gender string, born string, bornCountry string, bornCountryCode string,"
    " bornCity string, died string, diedCountry string, diedCountryCode string, diedCity string,"
    " prizes array<struct<year string, motivation string, affiliations string>>>>"
)
AFFILIATIONS = "array<struct<name string, city string, country string>>"


def read_seed(spark: SparkSession, path: str, schema: str = SEED_SCHEMA) -> DataFrame:
    """CSV with a header; quoted names may hold commas."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_nested_json(
    spark: SparkSession, path: str, schema: str = LIST_SCHEMA, multi_line: bool | None = None
) -> DataFrame:
    """JSON documents, one per line, which lets files be split; or one per file, over several lines.

    Without ``multi_line`` the first line that is not blank decides: if it is a whole document, lines are.  A
    document that cannot be read is an error, also where files of both kinds are mixed.
    """
    if multi_line is None:
        first = spark.read.text(path).where(F.trim("value") != "").limit(1)
        whole = first.select(F.get_json_object("value", "$").isNotNull().alias("whole")).first()
        multi_line = whole is not None and not whole["whole"]
    return spark.read.schema(schema).options(multiLine=multi_line, mode="FAILFAST").json(path)


def explode_list(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Prize list to one row per prize and person."""
    prizes = each(docs, keep, "prizes", "p").select(*keep, "p.category", "p.year", "p.laureates")
    people = each(prizes, [*keep, "category", "year"], "laureates", "l")
    return people.select(*keep, "category", "year", "l.*")


def parse_json(df: DataFrame, col: str, schema: str, out: str) -> DataFrame:
    return df.withColumn(out, F.from_json(col, schema))


def first_detail(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Fields of the first person in a detail document; NULL where anything is missing.

    ``affiliations`` is read as text, since it may be an array of structs, an
    array of empty arrays or '' in the same data, and parsed afterwards.
    """
    parsed = df.withColumn("__d", F.get(F.from_json(col, DETAIL_SCHEMA)["laureates"], F.lit(0)))
    first_prize = F.get(F.col("__d.prizes"), F.lit(0))
    return parsed.select(
        *keep,
        *[
            F.col(f"__d.{f}").alias(f)
            for f in ("gender", "born", "bornCountry", "bornCountryCode", "bornCity",
                      "died", "diedCountry", "diedCountryCode", "diedCity")
        ],
        F.col("__d.prizes").alias("prizes"),
        first_prize["motivation"].alias("first_motivation"),
        affiliations(first_prize["affiliations"]).alias("affiliations"),
    )


def affiliations(text: Column) -> Column:
    """Array of structs from its JSON text; NULL for '', ``[[]]`` and the like."""
    well_formed = text.rlike(r"^\s*\[\s*\{")
    return F.when(well_formed, F.from_json(text, AFFILIATIONS))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages from parquet: ``page_id, url, html``, with ``status`` 200 where none was landed."""
    pages = spark.read.parquet(path)
    return pages if "status" in pages.columns else pages.withColumn("status", F.lit(200))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """HTML exports, one row per file: ``file_id, html``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("html")
    )


def read_export_blocks(spark: SparkSession, path: str) -> DataFrame:
    """HTML exports as ``file_id, file_start, line, part, block`` rows, one per ``div`` or table.

    Files are cut at ``</div>``, so a file of any size is read by many tasks.
    The three numbers give the order within a file.  Scripts and comments are
    only recognised where no ``</div>`` lies inside them.
    """
    lines = spark.read.option("lineSep", "</div>").text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("file_start"),
        F.monotonically_increasing_id().alias("line"),
        blocks_of(F.col("value")).alias("blocks"),
    )
    return each(lines, ["file_id", "file_start", "line"], "blocks", "block", "part")


def attachments(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Inventory of attachment files; the contents are not read.

    Spark leaves files without any bytes out of a scan, so an empty attachment counts as missing.
    """
    return inventory(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def inventory(files: DataFrame) -> DataFrame:
    """A listing (``path, length``) as ``file_name, record_id, n_bytes``; the id is the name without its extension."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        name.alias("file_name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("record_id"),
        F.col("length").cast("bigint").alias("n_bytes"),
    )


def attach_text(inventory: DataFrame, texts: DataFrame) -> DataFrame:
    """Inventory with the text extracted from each file (``record_id, text``), NULL where there is none."""
    return inventory.join(texts, "record_id", "left")


def read_work_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, or an empty one with its schema when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def version_path(root: str, version: int) -> str:
    """Where a version of a work table is."""
    return f"{root.rstrip('/')}/version={version}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The finished versions below ``root``, ascending.  Lists folders, reads no rows."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/version=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().removeprefix("version=")) for f in found or [])


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The highest finished version below ``root``, None when there is none."""
    return max(versions(spark, root), default=None)


def open_items(state: DataFrame, done: Column) -> DataFrame:
    """Rows not done yet; the filter reaches the scan."""
    return state.where(~done)


def pair_list(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``"k1,v1 k2,v2"`` to one row per pair: ``pos, item, value``."""
    pairs = F.split(strip(F.col(col)), r"\s+")
    exploded = each(df, keep, pairs, "__pair").where("__pair <> ''")
    return exploded.select(
        *keep,
        "pos",
        F.split_part("__pair", F.lit(","), F.lit(1)).alias("item"),
        F.nullif(F.split_part("__pair", F.lit(","), F.lit(2)), F.lit("")).alias("value"),
    )


def read_records(spark: SparkSession, paths: str | Sequence[str], origin: str, id_prefix: str) -> DataFrame:
    """Record files of both generations, mixed in the same folders, in the flat shape.

    One pass: every file is read with the fields of both, and a record with a
    ``meta`` struct is of generation 2.
    """
    flat, nested = flat_schema(), nested_schema(origin)
    both = T.StructType([*flat.fields, *[f for f in nested.fields if f.name not in flat.names]])
    raw = spark.read.schema(both).json(paths)
    is_new = F.col("meta").isNotNull()
    renamed = {
        "published": F.col("date"),
        "pdf_text": F.col("words"),
        "title": title_of(F.col("external_id"), id_prefix),
        **{f: F.col(f"meta.{origin}.{f}") for f in META_FIELDS},
    }
    return raw.select(
        *[F.when(is_new, renamed.get(f, F.col(f))).otherwise(F.col(f)).alias(f) for f in flat.names],
        F.when(is_new, 2).otherwise(1).alias("generation"),
    )
