"""Folds over an array in a row that hand out results as they go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let

# Results are gathered by so many items at a time: appending to one long array copies it at every step.
CHUNK = 256


def fold_emit(
    items: Column,
    start: Column,
    emitted: str,
    step: Callable[[Column, Column], Column],
    chunk: int = CHUNK,
) -> Column:
    """``struct<state, out>`` after every item in order, each giving ``step(state, item) -> struct<state, out>``.

    ``emitted`` is the type of one result.  ``items`` is used several times, so it should be a plain column.
    """

    def nothing(depth: int) -> Column:
        return F.array().cast("array<" * depth + emitted + ">" * depth)

    def one(acc: Column, item: Column) -> Column:
        done = step(acc["state"], item)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], d["out"]).alias("out")))

    def part(acc: Column, at: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), nothing(1).alias("out"))
        done = F.aggregate(F.slice(items, at * chunk + 1, chunk), begin, one)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    last = F.greatest(F.ceil(F.size(items) / chunk).cast("int") - 1, F.lit(0))
    begin = F.struct(start.alias("state"), nothing(2).alias("out"))
    return F.aggregate(
        F.sequence(F.lit(0), last), begin, part,
        lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")),
    )
