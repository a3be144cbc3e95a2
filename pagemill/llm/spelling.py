"""Spelling variants of corpus words: a trie as an edge table, walked by a frontier of states level by level.

The trie of all words is a table of edges (parent node, letter, child node).  A state says that a
prefix of one word has been read and where in the trie one is after at most one edit: (node of the prefix
read, node reached, position, edits).  Words that begin alike share the states of their
common prefix, so the frontier holds one row for each pair of nodes and not for each word.  States without
an edit are the trie's own nodes.  At every node one edit may happen: another letter of the same
parent (replaced), or the parent itself (one letter too many).  A letter too few is the
second kind seen from the other word.  A state with its edit spent goes on only where both nodes have an
edge of the same letter: one join with the edge table for each side and level.  States where a word ends at both
nodes are the neighbours.

Nodes are 64-bit hashes of prefixes.  Should two prefixes collide, paths of both are followed, so nothing is
lost, and a last check of the spellings throws out what is not one edit apart.  Every level is a
written table; levels without a branch and without states are skipped, however long the words are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import require, staged, tidy
from pagemill.session import scratch_path

MIN_LETTERS = 6
MIN_COUNT = 5
# A form must be so many times as frequent as the word.
RATIO = 5
# Every so many hashes of an occurrence lose a letter.
TYPO_EVERY = 199
# Different words a task counts before it passes them on.
WORDS_PER_FLUSH = 500_000
# Levels that get a folder of their own in the edge table.
FOLDERS = 64


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY,
) -> DataFrame:
    """``word, n``: runs of Latin letters of whole texts, A-Z lower-cased, with their occurrences.

    An occurrence whose unsigned CRC-32 of ``<key>:<run>`` is divisible by ``typo_every`` loses its letter at that
    number modulo its length.  Results of fewer letters or occurrences are left out.  A null text has no runs; a null
    key counts as an empty one.  Each task adds up its own words before they are shuffled.
    """
    require(docs, key, text)
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_letters},}}")

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for owner, content in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                # Lower-casing bytes touches A-Z only.
                found = Counter(runs.findall(content.encode().lower().decode()))
                seed = zlib.crc32(f"{owner}:".encode())
                for run, n in found.items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % typo_every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < min_letters:
                            continue
                    total[run] += n
            if len(total) > WORDS_PER_FLUSH:
                yield emit(total)
                total = Counter()
        yield emit(total)

    rows = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text")
    )
    counted = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _node(prefix: Column) -> Column:
    return F.xxhash64(prefix)


def trie_edges(words: DataFrame) -> DataFrame:
    """The trie of ``words(word)``: ``level, depth, parent, letter, child, ends, parent_ends``, written and read again.

    ``depth`` is that of the child; ``ends`` and ``parent_ends`` say whether a word ends at the node.
    """
    places = words.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("depth"))
    cut = places.select(
        "depth",
        _node(F.left("word", F.col("depth") - 1)).alias("parent"),
        F.substr("word", F.col("depth"), F.lit(1)).alias("letter"),
        _node(F.left("word", F.col("depth"))).alias("child"),
        (F.col("depth") == F.char_length("word")).alias("ends"),
    )
    edges = cut.groupBy("depth", "parent", "letter", "child").agg(F.bool_or("ends").alias("ends"))
    closed = words.select(_node(F.col("word")).alias("parent"), F.lit(True).alias("__closed")).distinct()
    whole = edges.join(closed, "parent", "left").select(
        F.least("depth", F.lit(FOLDERS)).alias("level"), "depth", "parent", "letter", "child", "ends",
        F.coalesce("__closed", F.lit(False)).alias("parent_ends"),
    )
    path = scratch_path(words.sparkSession, "trie")
    # One task for each part of a level, so that no level becomes a swarm of small files.
    with tidy(words.sparkSession):
        whole.repartition("level", F.pmod("parent", F.lit(64))).write.partitionBy("level").parquet(path)
    return words.sparkSession.read.schema(whole.schema).parquet(path)


def _at(edges: DataFrame, depth: int, side: str) -> DataFrame:
    here = edges.where((F.col("level") == min(depth, FOLDERS)) & (F.col("depth") == depth))
    return here.select(*[F.col(c).alias(f"{side}_{c}") for c in ("parent", "letter", "child", "ends", "parent_ends")])


def _opened(edges: DataFrame, depth: int) -> DataFrame:
    """States whose one edit is the letter at ``depth``: another child of the same parent, or the parent itself."""
    a, b = _at(edges, depth, "a"), _at(edges, depth, "b")
    replaced = a.join(b, (F.col("a_parent") == F.col("b_parent")) & (F.col("a_letter") < F.col("b_letter"))).select(
        F.col("a_child").alias("u"), F.col("b_child").alias("v"), F.lit(None).cast("string").alias("avoid"),
        (F.col("a_ends") & F.col("b_ends")).alias("both_end"),
    )
    # Of a run of equal letters the last one is the one too many: the same letter must not follow.
    spare = a.select(
        F.col("a_child").alias("u"), F.col("a_parent").alias("v"), F.col("a_letter").alias("avoid"),
        (F.col("a_ends") & F.col("a_parent_ends")).alias("both_end"),
    )
    return replaced.unionByName(spare)


def _advanced(states: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """States one letter further: ``u`` comes to ``depth``, ``v`` there or one level above, by the same letter."""
    a = _at(edges, depth, "a")
    b = _at(edges, depth, "b").unionByName(_at(edges, depth - 1, "b")) if depth > 1 else _at(edges, depth, "b")
    first = states.join(a, F.col("u") == F.col("a_parent")).where(
        F.col("avoid").isNull() | (F.col("a_letter") != F.col("avoid"))
    )
    both = first.join(b, (F.col("v") == F.col("b_parent")) & (F.col("a_letter") == F.col("b_letter")))
    return both.select(
        F.col("a_child").alias("u"), F.col("b_child").alias("v"), F.lit(None).cast("string").alias("avoid"),
        (F.col("a_ends") & F.col("b_ends")).alias("both_end"),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near`` for all pairs of ``words(word)`` that are one insertion, deletion or replacement apart, both ways.

    Words are distinct and not null; without words the result is empty.
    """
    spark = words.sparkSession
    edges = trie_edges(words)
    # Only where a parent has two children, or is a word itself, can an edit lead anywhere.
    forks = edges.groupBy("depth", "parent").agg(
        F.count(F.lit(1)).alias("children"), F.bool_or("parent_ends").alias("closed")
    )
    open_at = {r[0] for r in forks.where("children > 1 or closed").select("depth").distinct().collect()}
    found: list[str] = []
    states: DataFrame | None = None
    depth = 0
    while True:
        later = [d for d in open_at if d > depth]
        if states is None and not later:
            break
        depth = depth + 1 if states is not None else min(later)
        steps = [_opened(edges, depth)] if depth in open_at else []
        if states is not None:
            steps.append(_advanced(states, edges, depth))
        level = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
        path = scratch_path(spark, "frontier")
        with tidy(spark):
            level.write.parquet(path)
        found.append(path)
        states = spark.read.schema(level.schema).parquet(path)
        if states.isEmpty():
            states = None
    if not found:
        return spark.createDataFrame([], "word string, near string")
    ended = spark.read.schema("u bigint, v bigint, both_end boolean").parquet(*found).where("both_end")
    nodes = words.select(_node(F.col("word")).alias("node"), "word")
    pairs = (
        ended.select("u", "v").distinct()
        .join(nodes.select(F.col("node").alias("u"), F.col("word").alias("w")), "u")
        .join(nodes.select(F.col("node").alias("v"), F.col("word").alias("x")), "v")
        .where(F.levenshtein("w", "x") == 1)
    )
    sides = F.explode(F.array(F.struct(F.col("w").alias("word"), F.col("x").alias("near")),
                              F.struct(F.col("x").alias("word"), F.col("w").alias("near"))))
    return pairs.select(sides.alias("p")).select("p.word", "p.near").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every row of ``word, form``: forms are followed by doubling.  Frequencies grow, so there are no rings."""
    roots = staged(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        hop = roots.join(up, "root").select("word", F.col("__next").alias("root"), (F.col("__next") != F.col("root")).alias("moved"))
        hop = staged(hop, "roots")
        roots = hop.select("word", "root")
        if hop.where("moved").isEmpty():
            return roots


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT, ratio: int = RATIO, typo_every: int = TYPO_EVERY,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``word_counts``.

    ``n_near`` counts the words one edit away.  ``form`` is the most frequent of them (ties: the first by code
    points) if it is at least ``ratio`` times as frequent, else null; ``root`` is where following the forms ends,
    the word itself without a form.  Repeated rows are counted each; other columns are not looked at; an empty
    table gives an empty result.
    """
    words = staged(word_counts(docs, key, text, min_letters, min_count, typo_every), "words")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (
        near_pairs(words.select("word"))
        .join(counts, "near")
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("rank"), "near", "near_n")).alias("best"),
        )
    )
    enough = F.col("best.near_n") >= F.lit(ratio) * F.col("n")
    forms = words.join(best, "word", "left").select(
        "word",
        F.when(enough, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.near_n")).alias("form_n"),
    )
    forms = staged(forms, "forms")
    return forms.join(_roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
