"""Phrases by an FM-index for each shard of the corpus, over word numbers.

A shard's pieces of text, one after the other with marks between them, are indexed in both directions: the
word before each place in the order of what follows, and the word after each place in the reversed order
of what precedes (Burrows-Wheeler transforms sorted as deep as the longest phrase).  A phrase is a pair of intervals of the
same size, one in each order; its size is the phrase's count in the shard.  The words found in the one interval
extend the phrase to the left, those in the other to the right: two-word phrases come from words by extension to the right,
three from two to the left, four from three to the right, all phrases of a length at once.

Counts are summed across shards between two lengths, and only phrases frequent enough in the whole corpus
are extended: a phrase is at most as frequent as its parts.  The other part of an extended phrase is found as the
interval it lies in.  The extensions also say how much of a phrase goes on in one longer phrase, which decides whether it
stands for itself.  Everything is per language; a shard holds one language.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import shards as X
from pagemill.llm.common import require, staged, text_or_empty

LONGEST = 4
LEAST = 30
TOP = 2000
# A phrase goes where so many hundredths of it stand in one longer phrase.
ABSORBED = 80
UNKNOWN = "und"
# Ends of pieces; one of them stands for all.
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


def _cut(shard_tokens: int):
    """Texts as shards of one language: pieces of words, 0 between them."""

    def cut(batches):
        made = 0
        open_shards: dict[str, list] = {}

        def close(lang):
            nonlocal made
            numbers, pieces, size = open_shards.pop(lang)
            ids, words = X.by_frequency(np.concatenate(pieces), numbers.words, 1)
            counts = np.bincount(ids, minlength=len(words))
            row = [(TaskContext.get().partitionId() << 32) + made, lang, len(words), size, X.pack_words(words[1:]),
                   X.pack(counts[1:]), X.pack(ids)]
            made += 1
            names = ["shard", "lang", "size", "tokens", "words", "counts", "ids"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = text.encode().lower().translate(_ENDS).replace(b".", b" . ").split()
                shard = open_shards.setdefault(lang, [X.Numbering(b"."), [], 0])
                shard[1] += [shard[0].of(words), np.zeros(1, np.int64)]
                shard[2] += len(words) + 1
                if sum(s[2] for s in open_shards.values()) >= shard_tokens:
                    yield close(max(open_shards, key=lambda k: open_shards[k][2]))
        for lang in list(open_shards):
            yield close(lang)

    return cut


def _order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of the ``depth`` numbers from there on; equal ones as they come."""
    rank, known = text, 1
    while known < depth:
        step = min(known, depth - known)
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1]
        known += step
    return np.argsort(rank, kind="stable")


class FmIndex:
    """Both transforms of one shard, and intervals of phrases in them.

    ``before[i]`` is the number before the place that is ``i``-th by what begins there, ``after[i]`` the number after the place
    that is ``i``-th by what ends there, read backwards.  0 separates pieces and stands for words that are too rare.
    """

    def __init__(self, before: np.ndarray, after: np.ndarray):
        self.transforms = before, after

    @classmethod
    def build(cls, text: np.ndarray, depth: int) -> FmIndex:
        """``text`` must be numbers without two zeros in a row, a zero at both ends, longer than ``depth``."""
        forward, back = _order(text, depth), _order(text[::-1], depth)
        return cls(text[forward - 1], text[::-1][back - 1])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All numbers with their intervals in both orders and their sizes."""
        counts = np.bincount(self.transforms[0])
        starts = np.cumsum(counts) - counts
        there = np.flatnonzero(counts[1:]) + 1
        return there, np.stack([starts[there]] * 2), counts[there]

    def extend(self, starts: np.ndarray, sizes: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions of phrases by one number, to the left (``side`` 0) or right (1).

        Gives, for each extended phrase, which phrase it comes from, the number, its starts in both orders, and
        its size.  In the order in which numbers are added, the new interval begins where the last-to-first mapping
        leads; in the other order, the extensions lie side by side within the phrase's interval by number.
        """
        transform = self.transforms[side]
        last_to_first = np.empty(len(transform), np.int64)
        last_to_first[np.argsort(transform, kind="stable")] = np.arange(len(transform))
        ends = np.cumsum(sizes)
        parent = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes - starts[side], sizes)
        added = transform[place]
        key = parent * (int(transform.max(initial=0)) + 1) + added
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        size = np.diff(np.append(first, len(order)))
        at = order[first]
        parent, added, mapped = parent[at], added[at], last_to_first[place[at]]
        # Numbers below it, zeros among them, come first in the other order.
        within = first - (ends - sizes)[parent]
        beside = starts[1 - side][parent] + within
        real = added > 0
        both = np.stack([mapped, beside] if side == 0 else [beside, mapped])
        return parent[real], added[real], both[:, real], size[real]


def _containing(starts: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which interval holds each place; ``order`` sorts ``starts``, and every place must be in one or before all of it."""
    return order[np.searchsorted(starts[order], place, side="right") - 1]


def phrases(index: FmIndex, counts: Sequence[np.ndarray], numbers: np.ndarray, least: int):
    """The phrases one word longer than those in ``counts``: their words' numbers, counts in the shard.

    ``counts[m]`` are the corpus' counts of the phrases of ``m + 2`` words in the order in which this function gives them;
    without any, two-word phrases are given.  ``numbers`` are the corpus' numbers of the shard's numbers.
    """
    words, starts, sizes = index.words()
    columns = [numbers[words]]
    for length in range(2, len(counts) + 3):
        # Alternately to the right and to the left.
        side = length % 2 == 0
        parent, added, new_starts, new_sizes = index.extend(starts, sizes, int(side))
        if length > 2:
            # The other part, without the far word: the phrase of the level before whose interval holds this one.
            side_starts, here = starts[int(side)], new_starts[int(side)]
            order = np.argsort(side_starts)
            other = _containing(side_starts, order, here) if len(order) else np.zeros(0, np.int64)
            inside = (here >= side_starts[other]) & (here < side_starts[other] + sizes[other])
            parent, added, new_starts, new_sizes = parent[inside], added[inside], new_starts[:, inside], new_sizes[inside]
        word = numbers[added]
        kept = [c[parent] for c in columns]
        columns = [*kept, word] if side else [word, *kept]
        starts, sizes = new_starts, new_sizes
        if length - 2 < len(counts):
            frequent = counts[length - 2] >= least
            columns, starts, sizes = [c[frequent] for c in columns], starts[:, frequent], sizes[frequent]
    return columns, sizes


def _answer(words: int, least: int):
    """Sums up the phrases of a bucket; ``phrase`` rows hold the frequent ones with their counts."""

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        shards = table.column("shard").to_pylist()
        asked = [[X.unpack(d) for d in data] for data in table.column("data").to_pylist()]
        columns = [np.concatenate(c) for c in zip(*asked)]
        places, number = X.numbered(columns[:words])
        counts = np.zeros(len(places), np.int64)
        np.add.at(counts, number, columns[words])
        rows = X.Rows()
        start = 0
        for shard, part in zip(shards, asked):
            rows.add("answer", bucket, shard, X.pack(counts[number[start : start + len(part[0])]]))
            start += len(part[0])
        kept = counts >= least
        rows.add("phrase", bucket, -1, *[X.pack(c[places][kept]) for c in columns[:words]], X.pack(counts[kept]))
        return pa.Table.from_batches([rows.batch()])

    return answer


def _index(buckets: int, depth: int):
    """Shards with the answers for their words as indexes: ``shard, before, after, numbers``."""

    def build(batches):
        for batch in batches:
            for row in X.one_by_one(batch):
                words = X.unpack_words(row["words"], row["size"] - 1)
                numbers, _ = X.undealt(X.answers_of(row["answers"], 1)[0], X.word_buckets(_keys(row["lang"], words), buckets), 2)
                # Rare words separate like ends of pieces; the rest are numbered anew, without gaps.
                known = np.concatenate([[0], np.where(numbers > 0, np.cumsum(numbers > 0), 0)])
                text = known[X.unpack(row["ids"])]
                text = np.concatenate([[0], text[(text > 0) | (np.concatenate([[0], text[:-1]]) > 0)], np.zeros(depth, np.int64)])
                index = FmIndex.build(text, depth)
                values = [row["shard"], *[X.pack(t) for t in index.transforms], X.pack(np.concatenate([[0], numbers[numbers > 0]]))]
                names = ["shard", "before", "after", "numbers"]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

    return build


def _keys(lang: str, words: list[bytes]) -> list[bytes]:
    """Words of different languages are different keys; neither part holds a space."""
    head = quote(lang, safe="").encode() + b" "
    return [head + w for w in words]


def _ask(steps: int, least: int, buckets: int):
    def ask(batches):
        for batch in batches:
            for row in X.one_by_one(batch):
                index = FmIndex(X.unpack(row["before"]), X.unpack(row["after"]))
                numbers = X.unpack(row["numbers"])
                counts = []
                for parts in X.answers_of(row.get("answers"), steps):
                    columns, _ = phrases(index, counts, numbers, least)
                    counts.append(X.undealt(parts, X.bucket_of(columns, buckets), 1)[0])
                columns, sizes = phrases(index, counts, numbers, least)
                rows = X.Rows()
                if len(sizes):
                    rows.deal("ask", row["shard"], X.bucket_of(columns, buckets), [*columns, sizes])
                yield rows.batch()

    return ask


def _phrase_rows(answers: DataFrame, words: int) -> DataFrame:
    """``w1, w2, …, f`` from ``phrase`` rows."""
    names = [*[f"w{i + 1}" for i in range(words)], "f"]

    def spread(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(X.unpack(d), pa.int64()) for d in data], names=names)

    return answers.where("kind = 'phrase'").select("data").mapInArrow(spread, ", ".join(f"{n} bigint" for n in names))


def _word_rows(answers: DataFrame) -> DataFrame:
    """``lang, word, w1, f`` from ``word`` rows."""

    def spread(batches):
        for batch in batches:
            for words, numbers, counts in batch.column("data").to_pylist():
                counts = X.unpack(counts)
                keys = [k.split(b" ", 1) for k in X.unpack_words(words, len(counts))]
                columns = [[unquote(k[0].decode()) for k in keys], [k[1].decode() for k in keys], X.unpack(numbers), counts]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["lang", "word", "w1", "f"])

    return answers.where("kind = 'word'").select("data").mapInArrow(spread, "lang string, word string, w1 bigint, f bigint")


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _described(levels: list[DataFrame], longest: int) -> list[DataFrame]:
    """Frequent phrases of each length with their texts and the counts of all their beginnings and ends.

    ``heads[k - 1]`` is the count of the first ``k`` words, ``tails[k - 1]`` that of the last ``k``.
    """
    none = F.array().cast("array<bigint>")
    out = [levels[0].select("lang", "w1", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("heads"), none.alias("tails"))]
    for words in range(2, longest + 1):
        inner = [f"w{i}" for i in range(1, words)]
        head = out[-1].select("lang", *inner, F.col("phrase").alias("h_phrase"), F.col("f").alias("h_f"), F.col("heads").alias("h_heads"))
        tail = out[-1].select(
            *[F.col(f"w{i}").alias(f"w{i + 1}") for i in range(1, words)],
            F.col("last").alias("t_last"), F.col("f").alias("t_f"), F.col("tails").alias("t_tails"),
        )
        joined = levels[words - 1].join(head, inner).join(tail, [f"w{i + 1}" for i in range(1, words)])
        out.append(
            staged(
                joined.select(
                    "lang", *[f"w{i}" for i in range(1, words + 1)], "f",
                    F.concat_ws(" ", "h_phrase", "t_last").alias("phrase"), F.col("t_last").alias("last"),
                    F.concat("h_heads", F.array("h_f")).alias("heads"), F.concat("t_tails", F.array("t_f")).alias("tails"),
                ),
                "phrases",
            )
        )
    return out


def _standing(level: DataFrame, longer: DataFrame | None, words: int, absorbed: int) -> DataFrame:
    """Phrases of which no single longer one holds ``absorbed`` hundredths; the next length decides, as counts do not grow."""
    if longer is None:
        return level
    names = [f"w{i}" for i in range(1, words + 1)]
    left = longer.select(*names, "f")
    right = longer.select(*[F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, words + 1)], "f")
    most = left.unionByName(right).groupBy(*names).agg(F.max("f").alias("__most"))
    joined = level.join(most, names, "left")
    stays = _wide(F.coalesce("__most", F.lit(0))) * 100 < _wide(F.col("f")) * absorbed
    return joined.where(stays).drop("__most")


def _scored(level: DataFrame, words: int) -> DataFrame:
    """The lowest-scoring cut of each phrase; of equal scores the one after the fewest words."""
    cuts = []
    for k in range(1, words):
        left, right = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(words - k - 1))
        # Whole numbers beyond 64 bits are exact decimals of up to 38 digits.
        score = F.call_function("div", _wide(F.col("f")) * F.lit(2_000_000).cast("decimal(19,0)"), _wide(left) + _wide(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    best = F.array_min(F.array(*cuts))
    return level.select("lang", "phrase", F.col("f").alias("a"), best.alias("b")).select(
        "lang", "phrase", "a", "b.l", "b.r", F.col("b.score").cast("bigint").alias("score")
    )


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST,
    top: int | None = TOP, absorbed: int = ABSORBED, shard_tokens: int = X.SHARD_TOKENS, bucket_keys: int = X.BUCKET_KEYS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best ``top`` phrases (all with null) of 2 to ``longest`` words.

    Texts are cut at sentence marks and line ends into pieces, pieces at spaces and tabs into words, A-Z lower-cased.  A
    phrase needs ``least`` occurrences ``a`` within pieces; overlapping ones count.  ``l`` and ``r`` are the counts of its two parts
    at the cut with the lowest score ``floor(2000000 a / (l + r))``, ``n`` is the number of the language's words.  Phrases of
    which a longer one holds ``absorbed`` hundredths are left out.  Ties go to the more frequent and then to the first phrase
    by bytes.  A null text counts as empty, a null language as ``und``.  Repeated rows count each; other
    columns are not looked at; an empty table gives an empty result.
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    require(docs, text, lang)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(text).alias("text"))
    schema = "shard bigint, lang string, size bigint, tokens bigint, words binary, counts binary, ids binary"
    shards = staged(rows.mapInArrow(_cut(shard_tokens), schema), "shards")
    buckets = X.buckets_for(shards, bucket_keys)

    def ask_words(batches):
        for batch in batches:
            for row in X.one_by_one(batch):
                counts = X.unpack(row["counts"])
                asked = X.Rows()
                X.ask_words(asked, row["shard"], _keys(row["lang"], X.unpack_words(row["words"], len(counts))), counts, buckets)
                yield asked.batch()

    def totals_of(batches):
        for batch in batches:
            sums = [int(X.unpack(c).sum()) for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(sums, pa.int64())], names=["lang", "n"])

    asked = shards.select("shard", "lang", "words", "counts").mapInArrow(ask_words, X.ROW)
    words = staged(X.exchanged(asked, X.answer_words(buckets, least, keep=True)), "words")
    indexes = staged(
        X.with_answers(shards, words).mapInArrow(_index(buckets, longest), "shard bigint, before binary, after binary, numbers binary"),
        "indexes",
    )
    known: list[DataFrame] = []
    levels = [_word_rows(words)]
    for length in range(2, longest + 1):
        with_known = X.with_answers(indexes, *known) if known else indexes
        asked = with_known.mapInArrow(_ask(len(known), least, buckets), X.ROW)
        known.append(staged(X.exchanged(asked, _answer(length, least)), "counts"))
        levels.append(_phrase_rows(known[-1], length))
    described = _described(levels, longest)
    found = []
    for length in range(2, longest + 1):
        longer = described[length] if length < longest else None
        found.append(_scored(_standing(described[length - 1], longer, length, absorbed), length))
    scored = reduce(DataFrame.unionByName, found)
    sizes = shards.select("lang", "counts").mapInArrow(totals_of, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))
    best_first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best_first))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
