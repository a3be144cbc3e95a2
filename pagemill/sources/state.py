"""A keyed table with versions, kept in hash buckets: a fold rewrites the buckets it touches and no others.

Below the root of a state lie ``data`` and ``manifests``.  A row's bucket is the hash of its key.  Each version has a manifest:
one row for each bucket that holds rows, with the folder of its files, which may have been written for an older
version.  Files of a version are written first and its manifest last, so a version exists as a whole or not at all, and
what a lost run left behind is named by no manifest.  Nothing is ever overwritten; ``expire`` removes versions
that are no longer wanted and folders that only they name.

The number of buckets is settled with the first version.  Choose it so that one bucket is small enough for one
task: a fold needs a task and a file for each touched bucket, whatever the size of the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.session import scratch_path, staged

BUCKETS = 64
# ``writer`` and ``batch`` say which fold of which stream wrote the version; bucket -1 stands for the version itself.
MANIFEST = "buckets int, bucket int, folder string, writer string, batch bigint"
_BUCKET = "__bucket"


@dataclass(frozen=True)
class Manifest:
    """The folder of each bucket of a version."""

    version: int
    buckets: int
    folders: dict[int, str]
    writer: str | None
    batch: int | None


def _path(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


def _files(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written to the folder as a whole."""
    return bool(_files(spark, _path(folder, "_SUCCESS")))


def state_versions(spark: SparkSession, root: str) -> list[int]:
    """The versions of a state, ascending.  Lists folders, reads no rows."""
    done = _files(spark, _path(root, "manifests", "version=*", "_SUCCESS"))
    return sorted(int(re.search(r"version=(\d+)/", name)[1]) for name in done)


def read_manifest(spark: SparkSession, root: str, version: int) -> Manifest:
    """The manifest of a version: as many rows as there are buckets at most."""
    rows = spark.read.schema(MANIFEST).parquet(_path(root, "manifests", f"version={version}")).collect()
    own = next(r for r in rows if r["bucket"] < 0)
    return Manifest(version, own["buckets"], {r["bucket"]: r["folder"] for r in rows if r["bucket"] >= 0}, own["writer"], own["batch"])


def _read_folders(spark: SparkSession, folders: list[str], schema: str | T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def read_state(spark: SparkSession, root: str, schema: str | T.StructType, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest; none if nothing was written yet."""
    known = state_versions(spark, root)
    if not known:
        return spark.createDataFrame([], schema)
    manifest = read_manifest(spark, root, known[-1] if version is None else version)
    return _read_folders(spark, list(manifest.folders.values()), schema)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _written(df: DataFrame, root: str, key: str, buckets: int, version: int) -> dict[int, str]:
    """Write rows by bucket into folders of their own; the folders."""
    folder = scratch_path(df.sparkSession, "x").rpartition("-")[2]
    path = _path(root, "data", f"{version}-{folder}")
    dealt = df.withColumn(_BUCKET, _bucket(key, buckets)).repartition(_BUCKET)
    dealt.write.partitionBy(_BUCKET).parquet(path)
    found = _files(df.sparkSession, f"{path}/{_BUCKET}=*")
    return {int(name.rpartition("=")[2]): name for name in found}


def _commit(spark: SparkSession, root: str, manifest: Manifest) -> int:
    """Write the manifest; fails if another writer was first with this version."""
    rows = [(manifest.buckets, -1, None, manifest.writer, manifest.batch)]
    rows += [(manifest.buckets, bucket, folder, None, None) for bucket, folder in sorted(manifest.folders.items())]
    path = _path(root, "manifests", f"version={manifest.version}")
    try:
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise ValueError(f"version {manifest.version} below {root} was written by another run") from e
    return manifest.version


def create_state(df: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> int:
    """Write ``df``, one row for each key, as the first version (0) of a state."""
    folders = _written(df, root, key, buckets, 0)
    return _commit(df.sparkSession, root, Manifest(0, buckets, folders, None, None))


def fold(
    incoming: DataFrame,
    root: str,
    key: str,
    schema: str | T.StructType,
    combine: Callable[[DataFrame, DataFrame], DataFrame],
    *,
    buckets: int = BUCKETS,
    writer: str | None = None,
    batch: int | None = None,
) -> int:
    """Fold rows into the newest version and write the next one; returns its number.

    ``combine(state, incoming)`` gets the state's rows of the touched buckets, those that keys of ``incoming`` fall into, and
    gives their new rows: it may add, change and leave out rows of these keys.  ``incoming`` is written to the shared folder
    first, so what it is made of is computed once.  With ``writer`` and ``batch``, a fold that is in the newest version of this writer
    already, or in an older one, is not done again: the newest version is returned.  Nothing incoming, no new version, unless there
    is none yet.
    """
    spark = incoming.sparkSession
    known = state_versions(spark, root)
    before = read_manifest(spark, root, known[-1]) if known else Manifest(-1, buckets, {}, None, None)
    if writer is not None and batch is not None and known:
        last = _last_batch(spark, root, known, writer)
        if last is not None and batch <= last:
            return known[-1]
    rows = staged(incoming, "incoming")
    touched = [r[0] for r in rows.select(_bucket(key, before.buckets).alias("b")).distinct().collect()]
    if not touched and known:
        return known[-1]
    state = _read_folders(spark, [before.folders[b] for b in touched if b in before.folders], schema)
    folders = _written(combine(state, rows), root, key, before.buckets, before.version + 1)
    if not set(folders) <= set(touched):
        raise ValueError("combine gave rows of keys that are in no touched bucket")
    kept = {b: f for b, f in before.folders.items() if b not in set(touched)}
    return _commit(spark, root, Manifest(before.version + 1, before.buckets, kept | folders, writer, batch))


def _last_batch(spark: SparkSession, root: str, known: list[int], writer: str) -> int | None:
    """The last batch of a writer in the versions that are kept, from the newest back."""
    own = spark.read.schema(MANIFEST).parquet(*[_path(root, "manifests", f"version={v}") for v in known])
    return own.where((F.col("bucket") < 0) & (F.col("writer") == writer)).agg(F.max("batch")).first()[0]


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` versions, and folders that no version kept names; returns the versions left.

    Not while another run folds: what it has written and not yet named would go as well.
    """
    known = state_versions(spark, root)
    left, gone = known[-keep:], known[:-keep]
    named = {f for v in left for f in read_manifest(spark, root, v).folders.values()}
    fs_of = spark._jvm.org.apache.hadoop.fs.Path

    def remove(name: str) -> None:
        path = fs_of(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    for version in gone:
        remove(_path(root, "manifests", f"version={version}"))
    for folder in _files(spark, _path(root, "data", "*", f"{_BUCKET}=*")):
        if folder not in named:
            remove(folder)
    return left
