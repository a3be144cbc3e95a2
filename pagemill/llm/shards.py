"""Corpora as shards of numbered words, and counting keys across shards.

A shard holds about ``SHARD_TOKENS`` words of whole texts as numbers of its own word list.  What several
shards have to agree on (numbers of words, counts of word sequences) is asked by key: a shard adds up what it
holds, deals its different keys out to buckets by their hash, every bucket adds up what all shards sent,
and the answers go back in the order of the questions.  Spark moves all of this as rows of
``(kind, bucket, shard, data)``, where ``data`` are columns of numbers in bytes; numpy works inside the tasks.
A bucket gets each key once from each shard at most, so frequent keys cost no more than rare ones.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import tidy
from pagemill.session import scratch_path

# Words of a shard, and tokens whose keys share a bucket (far fewer different keys).  Texts are not cut, so a shard may exceed this by one text.
SHARD_TOKENS = 1 << 19
BUCKET_KEYS = 1 << 21

ROW = "kind string, bucket bigint, shard bigint, data array<binary>"
COLUMNS = ["kind", "bucket", "shard", "data"]
ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("shard", pa.int64()), ("data", pa.list_(pa.binary()))])


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, in the narrowest type that holds them, first bytes of all first: they are alike."""
    values = np.ascontiguousarray(values)
    if values.dtype.kind != "f":
        low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
        values = values.astype(np.result_type(np.min_scalar_type(low), np.min_scalar_type(high)))
    raw = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    head = f"{values.dtype.str} {len(raw)} ".encode()
    return head + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(data: bytes) -> np.ndarray:
    """Numbers packed before, as 64-bit ones."""
    kind, size, packed = bytes(data).split(b" ", 2)
    dtype = np.dtype(kind.decode())
    raw = pa.decompress(packed, int(size), codec="zstd", asbytes=True) if int(size) else b""
    if not raw:
        return np.zeros(0, np.float64 if dtype.kind == "f" else np.int64)
    planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
    return values.astype(np.float64 if dtype.kind == "f" else np.int64)


def pack_words(words: Iterable[bytes]) -> bytes:
    """Words without line feeds but for the one that is a line feed, which comes back as an empty word."""
    raw = b"\n".join(b"" if w == b"\n" else w for w in words)
    return f"{len(raw)} ".encode() + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack_words(data: bytes, n: int) -> list[bytes]:
    if not n:
        return []
    size, packed = bytes(data).split(b" ", 1)
    raw = pa.decompress(packed, int(size), codec="zstd", asbytes=True) if int(size) else b""
    return raw.split(b"\n")


def numbered(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places of one row of each different key in ascending order, and every row's number among them."""
    size = len(columns[0])
    joined = _as_one(columns) if size else None
    # One column is sorted many times faster than several.
    columns, order = (columns, np.lexsort(columns[::-1])) if joined is None else ([joined], np.argsort(joined))
    new = np.zeros(size, bool)
    new[:1] = True
    for column in columns:
        there = column[order]
        new[1:] |= there[1:] != there[:-1]
    number = np.empty(size, np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _as_one(columns: Sequence[np.ndarray]) -> np.ndarray | None:
    """One column in the same order, if whole numbers from 0 on are small enough for that."""
    widths = [int(c.max()) + 1 for c in columns]
    if any(c.dtype.kind != "i" or c.min() < 0 for c in columns) or math.prod(widths) >= 1 << 62:
        return None
    one = columns[0].astype(np.int64)
    for column, width in zip(columns[1:], widths[1:]):
        one = one * width + column
    return one


def bucket_of(columns: Sequence[np.ndarray], buckets: int, salt: np.ndarray | int = 0) -> np.ndarray:
    """The bucket of each key; ``salt`` moves the keys of a frequent context to others."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return ((mixed % np.uint64(buckets)).astype(np.int64) + salt) % buckets


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, each turned into Python values only when it is wanted."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class Rows:
    """Collects rows of the exchange and gives them as Arrow batches."""

    def __init__(self):
        self.columns: list[list] = [[], [], [], []]

    def add(self, kind: str, bucket: int, shard: int, *data: bytes) -> None:
        for column, value in zip(self.columns, (kind, int(bucket), int(shard), list(data))):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, type=f.type) for c, f in zip(self.columns, ARROW)]
        self.columns = [[], [], [], []]
        return pa.RecordBatch.from_arrays(arrays, schema=ARROW)

    def deal(self, kind: str, shard: int, bucket: np.ndarray, columns: Sequence[np.ndarray]) -> None:
        """One row for each bucket with its part of the columns."""
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for start, end in zip(edges, [*edges[1:], len(order)]):
            here = order[start:end]
            self.add(kind, bucket[here[0]], shard, *[pack(c[here]) for c in columns])


def undealt(parts: dict[int, Sequence[np.ndarray]], bucket: np.ndarray, width: int) -> list[np.ndarray]:
    """The answers of all buckets in the order of the questions; ``bucket`` is the one asked for each."""
    order = np.argsort(bucket, kind="stable")
    out = []
    for i in range(width):
        whole = [parts[b][i] for b in sorted(parts)]
        flat = np.concatenate(whole) if whole else np.zeros(0, np.int64)
        back = np.empty(len(order), flat.dtype)
        back[order] = flat
        out.append(back)
    return out


class Numbering:
    """Numbers words in the order in which they come."""

    def __init__(self, *first: bytes):
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        for word in first:
            self.numbers[word]

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    @property
    def words(self) -> list[bytes]:
        return list(self.numbers)


def by_frequency(ids: np.ndarray, words: list[bytes], fixed: int) -> tuple[np.ndarray, list[bytes]]:
    """The same with frequent words first, behind ``fixed`` ones: small numbers take less room."""
    counts = np.bincount(ids, minlength=len(words))
    order = np.concatenate([np.arange(fixed), fixed + np.argsort(-counts[fixed:], kind="stable")])
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    return number[ids], [words[i] for i in order.tolist()]


def ask_words(rows: Rows, shard: int, words: list[bytes], counts: np.ndarray, buckets: int) -> None:
    """Questions for the numbers and counts of ``words``."""
    bucket = word_buckets(words, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for start, end in zip(edges, [*edges[1:], len(order)]):
        here = order[start:end]
        rows.add("ask", bucket[here[0]], shard, pack_words([words[i] for i in here.tolist()]), pack(counts[here]))


def word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def answer_words(buckets: int, least: int, keep: bool) -> Callable[[pa.Table], pa.Table]:
    """Adds up the words of a bucket: ``answer`` rows with numbers (from 1; -1 below ``least`` occurrences) and counts.

    With ``keep`` also a ``word`` row: the bucket's numbered words, their numbers and counts.  A ``total`` row
    holds the number of different words, all their occurrences and how many words occur 1, 2, … 6 times.
    """

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        asked, total = [], defaultdict(int)
        for shard, (words, counts) in zip(table.column("shard").to_pylist(), table.column("data").to_pylist()):
            counts = unpack(counts)
            words = unpack_words(words, len(counts))
            asked.append((shard, words))
            for word, n in zip(words, counts.tolist()):
                total[word] += n
        # Frequent words get small numbers, which take less room wherever they go.
        known = sorted((w for w, n in total.items() if n >= least), key=lambda w: (-total[w], w))
        number = {w: i * buckets + bucket + 1 for i, w in enumerate(known)}
        rows = Rows()
        for shard, words in asked:
            ids = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
            rows.add("answer", bucket, shard, pack(ids), pack(np.fromiter(map(total.__getitem__, words), np.int64, len(words))))
        if keep:
            counts = np.array([total[w] for w in known], np.int64)
            rows.add("word", bucket, -1, pack_words(known), pack(np.array([number[w] for w in known], np.int64)), pack(counts))
        rows.add("total", bucket, -1, pack(histogram(np.fromiter(total.values(), np.int64, len(total)))))
        return pa.Table.from_batches([rows.batch()])

    return answer


# Counts from 1 to this are told apart in histograms.
TOLD_APART = 6


def histogram(counts: np.ndarray) -> np.ndarray:
    """How many counts are positive, their sum, and how many are 1, 2, … ``TOLD_APART``."""
    some = counts[counts > 0]
    return np.concatenate([[len(some), some.sum()], np.bincount(some[some <= TOLD_APART], minlength=TOLD_APART + 1)[1:]])


def buckets_for(shards: DataFrame, bucket_keys: int) -> int:
    """So many buckets that one holds ``bucket_keys`` keys at most on average: a shard asks for no more than its tokens."""
    return max(1, -(-(shards.agg(F.sum("tokens")).first()[0] or 0) // bucket_keys))


def exchanged(rows: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """What ``answer`` gives for the rows of each bucket."""
    return rows.groupBy("bucket").applyInArrow(answer, ROW)


def written(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Rows of the exchange written below the shared folder, each kind in a folder ``kind=…`` of its own, and the path."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    with tidy(spark):
        rows.write.partitionBy("kind").parquet(path)
    # A path without rows has no folders to tell the kinds from.
    return spark.read.schema(ROW).option("basePath", path).parquet(path), path


def by_shard(shards: DataFrame, name: str) -> DataFrame:
    """``shards`` written below the shared folder, dealt by shard as a shuffle would: joined by it, they stay where they are."""
    spark = shards.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        with tidy(spark):
            shards.write.bucketBy(parts, "shard").format("parquet").option("path", scratch_path(spark, name)).saveAsTable(table)
        return spark.table(table)
    finally:
        # The name only; the files stay, and what has been read of it is known by its path.
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def totals(answers: DataFrame) -> np.ndarray:
    """The sum of all ``total`` rows: a handful of numbers, added up in Spark's tasks but for one row each."""

    def add(batches):
        total = None
        for batch in batches:
            for data in batch.column("data").to_pylist():
                part = unpack(data[0])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[int(x) for x in total]], pa.list_(pa.int64()))], names=["n"])

    parts = answers.where("kind = 'total'").select("data").mapInArrow(add, "n array<bigint>")
    places = parts.select(F.posexplode("n").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    return np.array([r["n"] for r in sorted(places)], np.int64) if places else np.zeros(2 + TOLD_APART, np.int64)


def with_answers(shards: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each shard's row with ``answers``: an array of ``{step, bucket, data}`` of all tables given, ``step`` from 0."""
    all_rows = None
    for step, table in enumerate(answers):
        rows = table.where("kind = 'answer'").select(
            "shard", F.struct(F.lit(step).alias("step"), "bucket", "data").alias("__answer")
        )
        all_rows = rows if all_rows is None else all_rows.unionByName(rows)
    gathered = all_rows.groupBy("shard").agg(F.collect_list("__answer").alias("answers"))
    return shards.join(gathered, "shard", "left")


def answers_of(value: list | None, steps: int) -> list[dict[int, list[np.ndarray]]]:
    """The unpacked answers of one shard by step and bucket."""
    out: list[dict[int, list[np.ndarray]]] = [{} for _ in range(steps)]
    for answer in value or []:
        out[answer["step"]][answer["bucket"]] = [unpack(d) for d in answer["data"]]
    return out
