"""Packing of tokenized examples into sequences: vector bin packing by dot products.

An example takes room in three dimensions at once: tokens, segments (one for
each piece) and loss-bearing tokens.  A sequence is filled one piece at a time:
of the examples that fit in all dimensions, the one whose size vector has the
largest dot product with the room left goes in, both measured as shares of the
limits.  Where nothing fits any more, or a single segment is left, the example with the
largest dot product is cut to what fills the sequence, and the rest of it waits for a later one.

Each task packs what it reads, in one pass: it holds a pool of a few dozen sequences'
worth of examples, so that there is always something of the right size to choose,
and nothing is shuffled.  What is left in the pool at the end of a task and does not
fill a sequence is cut into sequences whose lengths are powers of two, which
need no padding; that is at most a dozen short sequences per task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import per_worker, require, text_or_empty
from pagemill.llm.word_bpe import WordBpe

END = 2
# Sequences' worth of tokens a task keeps waiting before it packs.
POOL_SEQUENCES = 48
# Sequences that one task may number.
SEQUENCES_PER_TASK = 1 << 33


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("limits must be positive")


@dataclass
class Piece:
    """``ids`` from position ``start`` of example ``example`` of ``total`` ids; those before ``free`` bear no loss."""

    example: object
    ids: np.ndarray
    start: int
    total: int
    free: int

    def loss(self, length: int) -> int:
        """Loss-bearing ids among the first ``length`` of the piece."""
        return length - min(max(self.free - self.start, 0), length)

    def longest(self, tokens: int, loss: int) -> int:
        """How many ids of the piece fit in so many tokens and loss-bearing tokens."""
        return min(len(self.ids), tokens, max(self.free - self.start, 0) + loss)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.example, self.ids[:length], self.start, self.total, self.free),
            Piece(self.example, self.ids[length:], self.start + length, self.total, self.free),
        )


class Packer:
    """Takes examples, gives sequences (lists of pieces) that keep the limits."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.pool: list[Piece | None] = []
        self.sizes = np.zeros((0, 2), np.int64)
        self.pending: list[Piece] = []
        self.waiting = 0

    def add(self, example, ids: np.ndarray, free: int = 0) -> Iterator[list[Piece]]:
        piece = Piece(example, ids, 0, len(ids), free)
        # A long example fills sequences by itself; its last part is packed.
        while True:
            room = piece.longest(self.limits.tokens, self.limits.loss_tokens)
            if len(piece.ids) < self.limits.tokens or room < self.limits.tokens:
                break
            if room == len(piece.ids):
                yield [piece]
                return
            whole, piece = piece.cut(room)
            yield [whole]
        self.pending.append(piece)
        self.waiting += len(piece.ids)

    def ready(self) -> Iterator[list[Piece]]:
        """Full sequences, as long as the pool has plenty to choose from."""
        if self.waiting >= 2 * POOL_SEQUENCES * self.limits.tokens:
            self._open()
            while self.waiting >= POOL_SEQUENCES * self.limits.tokens:
                yield self._fill()

    def rest(self) -> Iterator[list[Piece]]:
        """All that is left, the last of it in sequences without padding."""
        self._open()
        while self.waiting:
            sequence = self._fill()
            length = sum(len(p.ids) for p in sequence)
            if self.waiting or length == self.limits.tokens:
                yield sequence
            else:
                yield from _powers_of_two(sequence)

    def _open(self) -> None:
        self.pool = [p for p in self.pool if p is not None] + self.pending
        self.pending = []
        self.sizes = np.array([(len(p.ids), p.loss(len(p.ids))) for p in self.pool], np.int64).reshape(-1, 2)

    def _take(self, i: int, length: int) -> Piece:
        piece = self.pool[i]
        if length < len(piece.ids):
            taken, left = piece.cut(length)
            self.pool[i] = left
            self.sizes[i] = len(left.ids), left.loss(len(left.ids))
        else:
            taken = piece
            self.pool[i] = None
            self.sizes[i] = 0
        self.waiting -= length
        return taken

    def _fill(self) -> list[Piece]:
        limits = np.array([self.limits.tokens, self.limits.loss_tokens], np.int64)
        share = 1.0 / (limits.astype(np.float64) ** 2)
        room, segments = limits.copy(), self.limits.segments
        sequence: list[Piece] = []
        while room[0] and segments and self.waiting:
            # The segment dimension adds the same to every example, as each takes one.
            score = self.sizes @ (room * share)
            here = self.sizes[:, 0] > 0
            fits = here & (self.sizes <= room).all(axis=1)
            if segments > 1 and fits.any():
                i = int(np.argmax(np.where(fits, score, -1.0)))
                length = int(self.sizes[i, 0])
            else:
                i = int(np.argmax(np.where(here, score, -1.0)))
                length = self.pool[i].longest(int(room[0]), int(room[1]))
                if not length:
                    break
            piece = self._take(i, length)
            sequence.append(piece)
            room -= (length, piece.loss(length))
            segments -= 1
        return sequence


def _powers_of_two(sequence: list[Piece]) -> Iterator[list[Piece]]:
    left = sum(len(p.ids) for p in sequence)
    queue = list(sequence)
    while left:
        target = 1 << (left.bit_length() - 1)
        left -= target
        part = []
        while target:
            piece = queue.pop(0)
            if len(piece.ids) > target:
                piece, after = piece.cut(target)
                queue.insert(0, after)
            part.append(piece)
            target -= len(piece.ids)
        yield part


def _pack_task(tokenizer: str, limits: Limits, end: int):
    def run(batches):
        encoder = per_worker(("words", tokenizer), lambda: WordBpe(tokenizer))
        packer = Packer(limits)
        number = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

        def columns(sequences):
            nonlocal number
            rows: list[list] = [[] for _ in names]
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    size = len(p.ids)
                    crc = zlib.crc32(np.ascontiguousarray(p.ids, "<u4").tobytes())
                    values = (p.example, p.start, size, crc, p.total, number, offset, p.loss(size))
                    for row, value in zip(rows, values):
                        row.append(value)
                    offset += size
                number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], type=key_type), *[pa.array(r, type=pa.int64()) for r in rows[1:]]], names=names
            )

        key_type = pa.null()
        for batch in batches:
            key_type = batch.schema.field("key").type
            keys = batch.column("key").to_pylist()
            responses = encoder.encode_all(batch.column("response").to_pylist())
            if "prompt" in batch.schema.names:
                prompts = encoder.encode_all(batch.column("prompt").to_pylist())
            else:
                prompts = [np.zeros(0, np.uint32)] * len(keys)
            last = np.array([end], np.uint32)
            done = chain.from_iterable(
                packer.add(key, np.concatenate([p, r, last]), len(p))
                for key, p, r in zip(keys, prompts, responses)
            )
            yield columns(chain(done, packer.ready()))
        if key_type != pa.null():
            yield columns(packer.rest())

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    response: str = "text",
    prompt: str | None = None,
    limits: Limits = Limits(),
    end: int = END,
) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens``.

    An example is the ids of ``prompt`` (if a column is named), which bear no loss, those of
    ``response`` and ``end``.  ``start`` counts the example's ids before the piece, ``offset``
    the sequence's; ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit numbers.
    Every id is in exactly one piece.  Null texts count as empty, so every row gives at least
    one piece; null and repeated keys are carried as they are, and each row is an example of its
    own.  Other columns are not looked at.  An empty table gives an empty result.
    ``tokenizer`` is the path of a tokenizer file that all executors can open.
    """
    require(docs, key, response, *([prompt] if prompt else []))
    columns = [F.col(key).alias("key"), text_or_empty(response).alias("response")]
    if prompt:
        columns.append(text_or_empty(prompt).alias("prompt"))
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, loss_tokens bigint"
    )
    packed = docs.select(*columns).mapInArrow(_pack_task(tokenizer, limits, end), schema)
    return packed.withColumnRenamed("key", key)
