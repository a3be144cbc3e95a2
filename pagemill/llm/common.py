"""What the operators share: session settings, column checks, scratch tables, a growing word table."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import pagemill.llm
from pagemill import session
from pagemill.session import configure

# Functions sent to executors carry this subpackage's code with them, so that
# nothing has to be installed there beside Spark, numpy and the tokenizers.
cloudpickle.register_pickle_by_value(pagemill.llm)

__all__ = ["ready", "require", "tidy", "staged", "discard", "text_or_empty", "link_map", "per_worker", "WordTable"]

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Texts may be long: a few hundred of them at a time pass between Spark and Python.
ROWS_PER_BATCH = "500"


def ready(spark: SparkSession) -> SparkSession:
    """The library's session settings, and small batches of texts for Python."""
    configure(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return spark


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes the shuffle files of every query as it ends; the setting of before is put back."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read from there; its shuffle files go at once."""
    with tidy(df.sparkSession):
        return session.staged(df, name)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder of staged rows that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def link_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator | dict], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` for a function that turns one batch into columns (a dict of arrays)."""
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(kinds)

    def column(values, kind):
        return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)

    def run(batches):
        for batch in batches:
            columns = rows(batch)
            yield pa.RecordBatch.from_arrays([column(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, kinds)


def per_worker(key: Hashable, make: Callable):
    """What ``make`` gave for ``key`` when this Python worker first asked.

    For vocabularies and what encoders remember: functions sent to executors bring new modules for
    every task, but Spark keeps its Python workers, and a module that only they know outlives the tasks.
    What is kept must bound its own size and must not change results.
    """
    kept = sys.modules.setdefault("_pagemill_worker", ModuleType("_pagemill_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class WordTable:
    """Words seen by a task, numbered, each with a row of numbers computed once.

    ``compute`` turns new words into a 2-D array.  The table is emptied when it
    holds more than ``limit`` words, which bounds a task's memory; the values
    of a word do not depend on that.
    """

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, limit: int = 400_000):
        self.compute, self.width, self.limit = compute, width, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.values = np.zeros((1024, self.width), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """The rows of ``words``, one below the other."""
        if len(self.index) > self.limit:
            self._clear()
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            first = len(index)
            need = first + len(new)
            if need > len(self.values):
                grown = np.zeros((max(need, 2 * len(self.values)), self.width), np.float32)
                grown[:first] = self.values[:first]
                self.values = grown
            self.values[first:need] = self.compute(new)
            index.update(zip(new, range(first, need)))
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        return self.values[at]
