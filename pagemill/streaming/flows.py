"""Incremental versions of the flows, as scheduled ``availableNow`` runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagemill.operators.records import observe_outcomes
from pagemill.operators.schedule import STATE_SCHEMA, due_plan, upsert_items
from pagemill.sources.readers import read_work_table, version_path
from pagemill.sources.state import BUCKETS, finished, fold, read_state, state_versions


def read_landed(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_batch: int | None = 100) -> DataFrame:
    """Landed parquet files as a stream; without ``files_per_batch`` a run is one batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _run(writer: DataStreamWriter, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_rows(pages: DataFrame, to_rows: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Append what projections and stateful operators make of all that landed since the last run, then return."""
    _run(to_rows(pages).writeStream.format("parquet").option("path", out), checkpoint)


def stream_records(pages: DataFrame, to_records: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Turn every page landed since the last run into records, then return.

    ``to_records`` gets each batch as an ordinary table, so a whole batch flow (joins, staged
    fields, aggregates within the batch) will do.  A batch that runs again replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        to_records(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    _run(pages.writeStream.foreachBatch(write), checkpoint)


def read_stream_records(spark: SparkSession, out: str) -> DataFrame:
    """All records that ``stream_records`` wrote."""
    return spark.read.parquet(out).drop("batch")


def stream_outcomes(
    rows: DataFrame,
    to_routed: Callable[[DataFrame], DataFrame],
    out: str,
    metrics: str,
    checkpoint: str,
    outcomes: Sequence[str] = ("success", "failures"),
) -> None:
    """Append routed records (with ``outcome``) and, beside them, a row of counts for each micro-batch.

    The counts are observed while the records pass on to the sink, so nothing is read twice.  A batch that runs
    again replaces its records and its counts; the counts are written last.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        folder = f"batch={batch_id}"
        observe_outcomes(to_routed(batch), seen, outcomes).write.mode("overwrite").parquet(f"{out.rstrip('/')}/{folder}")
        counts = seen.get
        names = ["records", *outcomes]
        row = batch.sparkSession.range(1).select(*[F.lit(counts.get(n, 0)).cast("bigint").alias(n) for n in names])
        row.write.mode("overwrite").parquet(f"{metrics.rstrip('/')}/{folder}")

    _run(rows.writeStream.foreachBatch(write), checkpoint)


def read_outcome_metrics(spark: SparkSession, metrics: str) -> DataFrame:
    """``batch, records`` and a count for each outcome: one row per micro-batch of ``stream_outcomes``."""
    return spark.read.parquet(metrics).withColumn("batch", F.col("batch").cast("bigint"))


def stream_dedup(df: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First row per key; a key is forgotten ``delay`` after it was seen, which bounds the state."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def _writer(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream with this checkpoint, kept inside the checkpoint: a lost one is another stream."""
    note = f"{checkpoint.rstrip('/')}/writer"
    known = read_work_table(spark, note, "name string").first()
    if known is not None:
        return known["name"]
    name = uuid.uuid4().hex
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").parquet(note)
    return name


def stream_upsert(
    source: DataFrame,
    root: str,
    checkpoint: str,
    now: Column,
    order: Sequence[str],
    plans: str | None = None,
    buckets: int = BUCKETS,
) -> int | None:
    """Fold new rows into the work table kept by parts below ``root``, one version per micro-batch; the newest version.

    A batch rewrites only the buckets its items fall into.  It is named in the version it makes, so a batch that runs again
    after a failure changes nothing; a lost checkpoint is a new stream, which reads all that landed again and goes on from the
    newest state.  Of two runs that fold at once the slower one fails and can be started again.  With ``plans`` the plan
    for the open items of the newest version is written below it, which reads the whole state; give ``read_landed`` no
    ``files_per_batch`` to plan once per run.  None if there is no state yet and nothing landed.
    """
    spark = source.sparkSession
    writer = _writer(spark, checkpoint)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        version = fold(
            batch, root, "domain", STATE_SCHEMA, lambda state, rows: upsert_items(state, rows, now, order),
            buckets=buckets, writer=writer, batch=batch_id,
        )
        if plans is not None:
            state = read_state(session, root, STATE_SCHEMA, version)
            due_plan(state, now).write.mode("overwrite").parquet(version_path(plans, version))

    _run(source.writeStream.foreachBatch(each_batch), checkpoint)
    known = state_versions(spark, root)
    return known[-1] if known else None


def stream_frontier(
    pages: DataFrame,
    to_links: Callable[[DataFrame], DataFrame],
    seen: str,
    out: str,
    checkpoint: str,
    key: str,
    schema: str,
    buckets: int = BUCKETS,
) -> None:
    """Append the links that no earlier page had, one folder of ``out`` per micro-batch, for a stream that fetches them.

    ``to_links`` makes rows of ``schema`` of a batch of pages; they are told apart by ``key``, and of equal ones in a batch the
    smallest row counts.  The set of links seen is a state by parts below ``seen``, kept across runs and apart from the
    checkpoint: a lost checkpoint reads all pages again and finds nothing new.  A batch that runs again after its links entered the set
    writes the same links again, as they carry the batch that found them.
    """
    spark = pages.sparkSession
    writer = _writer(spark, checkpoint)
    kept = f"{schema}, found_by string, found_in bigint"
    names = list(spark.createDataFrame([], schema).columns)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        links = to_links(batch).where(F.col(key).isNotNull()).select(F.struct(*names).alias("l"))
        unique = links.groupBy(F.col("l")[key].alias("__key")).agg(F.min("l").alias("l")).select("l.*")

        def add(state: DataFrame, found: DataFrame) -> DataFrame:
            fresh = found.join(state, key, "left_anti").select(
                *names, F.lit(writer).alias("found_by"), F.lit(batch_id).cast("bigint").alias("found_in")
            )
            return state.unionByName(fresh)

        folder = f"{out.rstrip('/')}/batch={batch_id}-{writer}"
        version = fold(unique, seen, key, kept, add, buckets=buckets, writer=writer, batch=batch_id)
        if finished(batch.sparkSession, folder):
            # Written again, the links would be new files for the stream that reads them.
            return
        state = read_state(batch.sparkSession, seen, kept, version)
        mine = state.where((F.col("found_by") == writer) & (F.col("found_in") == batch_id))
        mine.select(*names).write.mode("overwrite").parquet(folder)

    _run(pages.writeStream.foreachBatch(each_batch), checkpoint)
