"""Katz backoff language model over a corpus: counted, normalised and evaluated as exchanges between shards.

``P(w | h) = c*(hw) / c(h)`` where ``hw`` occurs often enough in training, else ``a(h) P(w | h')`` with the first word of
``h`` taken off, down to ``P(w) = c*(w) / N`` and what is left for words never seen.  ``c*`` are Good-Turing discounted
counts (up to ``TOLD_APART - 1``; larger ones are reliable and lose ``RELIABLE_LOSS`` of an occurrence only, so that every
context leaves something for what was not seen in it).  ``a(h)`` makes the sum over all words exactly 1: what the seen words
leave, divided by what the shorter context gives to words not seen after ``h``.

Texts are shards of numbered words.  For each order every shard sends its different word sequences, context by context, with
their counts in the training texts to buckets dealt by context.  It gets back the corpus' counts and, for each context after
which the model knows a word, how often its words occur: these tables, written below the shared folder, are the model.  Contexts
more frequent than a bucket is to hold are spread over several, whose sums add up.  A shard computes the weights of the contexts
it holds from their sums, and evaluates its tokens order by order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm import shards as X
from pagemill.llm.common import require, staged, text_or_empty

ORDER = 3
# Fewest occurrences of a sequence of one, two, … words that the model keeps; the last one holds beyond.
LEAST = (1, 1, 2)
RELIABLE_LOSS = 0.01
START, END = b"", b"\n"
SHARD = "shard bigint, size bigint, tokens bigint, words binary, counts binary, ids binary, lengths binary, learned binary"


@dataclass(frozen=True)
class Discounts:
    """Discounted counts: ``kept[r]`` stands for a count of r up to its length, larger ones lose ``RELIABLE_LOSS``."""

    kept: tuple[float, ...]

    @classmethod
    def fit(cls, seen: np.ndarray, least: int) -> Discounts:
        """From how many sequences occur 1, 2, … times.

        Katz's rule with the largest limit for which all discounts lie between 0 and 1; where the numbers allow none (few
        or strangely repeated texts), ``n1 / (n1 + 2 n2)`` is taken off each count.
        """
        n = [0.0, *map(float, seen)]
        for limit in range(len(n) - 2, least - 1, -1):
            if min(n[1 : limit + 2]) <= 0:
                continue
            rest = (limit + 1) * n[limit + 1] / n[1]
            if rest >= 1:
                continue
            ratio = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, limit + 1)]
            if all(0 < d < 1 for d in ratio[least - 1 :]):
                return cls((0.0, *[r * d for r, d in enumerate(ratio, start=1)]))
        off = min(max(n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5, 0.1), 0.9)
        return cls((0.0, *[r - off for r in range(1, len(n) - 1)]))

    def of(self, counts: np.ndarray) -> np.ndarray:
        small = np.minimum(counts, len(self.kept) - 1)
        return np.where(counts < len(self.kept), np.array(self.kept)[small], counts - RELIABLE_LOSS)

    def sum_of(self, sums: list[np.ndarray]) -> np.ndarray:
        """What many counts stand for: how many are 1, 2, … and how many are larger, and the sum of those."""
        *told, large, total = sums
        return total - RELIABLE_LOSS * large + sum(n * d for n, d in zip(told, self.of(np.arange(1, X.TOLD_APART))))


@dataclass(frozen=True)
class Words:
    """The lowest order: ``P(w) = scale c*(w) / N``, and ``unknown`` for everything never seen."""

    tokens: int
    different: int
    discounts: Discounts
    scale: float
    unknown: float

    @classmethod
    def fit(cls, total: np.ndarray) -> Words:
        different, tokens, seen = int(total[0]), int(total[1]), total[2:]
        discounts = Discounts.fit(seen, 1)
        told = np.arange(1, len(seen) + 1)
        large = different - int(seen.sum())
        kept = float(discounts.of(told) @ seen) + (tokens - int(told @ seen)) - large * RELIABLE_LOSS
        if not tokens:
            return cls(0, 0, discounts, 0.0, 1.0)
        # Something is always left for unknown words.
        most = tokens / (tokens + 1)
        scale = min(1.0, most / (kept / tokens))
        return cls(tokens, different, discounts, scale, 1.0 - scale * kept / tokens)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.full(len(counts), self.unknown)
        return np.where(counts > 0, self.scale * self.discounts.of(counts) / self.tokens, self.unknown)


def least_of(order: int, least: tuple[int, ...]) -> int:
    return least[min(order, len(least)) - 1]


def _cut(key_type, shard_tokens: int):
    """Texts as shards: every text is ``START``, its words, ``END``."""

    def cut(batches):
        made = 0
        numbers, pieces, lengths, learned, keys, size = X.Numbering(START, END), [], [], [], [], 0
        edge = np.array([0], np.int64), np.array([1], np.int64)

        def close():
            ids, words = X.by_frequency(np.concatenate(pieces), numbers.words, 2)
            taught = np.repeat(np.array(learned, bool), lengths)
            counts = np.bincount(ids[taught], minlength=len(words))
            counts[0] = 0
            row = [
                (TaskContext.get().partitionId() << 32) + made, len(words), size, X.pack_words(words[1:]), X.pack(counts),
                X.pack(ids), X.pack(np.array(lengths)), X.pack(np.array(learned, np.int64)), keys,
            ]
            names = ["shard", "size", "tokens", "words", "counts", "ids", "lengths", "learned", "keys"]
            kinds = [*[pa.int64()] * 3, *[pa.binary()] * 5, pa.list_(key_type)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for key, taught, text in zip(*[batch.column(c).to_pylist() for c in ("key", "learned", "text")]):
                # Lower-casing and splitting bytes know A-Z and the six white characters of ASCII only.
                ids = numbers.of(text.encode().lower().split())
                pieces += [edge[0], ids, edge[1]]
                lengths.append(len(ids) + 2)
                learned.append(taught)
                keys.append(key)
                size += len(ids) + 2
                if size >= shard_tokens:
                    yield close()
                    made += 1
                    numbers, pieces, lengths, learned, keys, size = X.Numbering(START, END), [], [], [], [], 0
        if size:
            yield close()

    return cut


@dataclass(frozen=True)
class Dealt:
    """What a shard asks for one order, sorted by bucket: contexts, and how many of the sequences asked follow each there."""

    contexts: np.ndarray  # numbers in the order below, ascending
    at: np.ndarray  # places in ``contexts``, one for each bucket that a context is asked of
    bucket: np.ndarray
    size: np.ndarray
    other: np.ndarray  # whether the shard has more sequences after the context than are asked in this bucket
    asked: np.ndarray  # sequences of the order, context by context

    def parts(self) -> Iterator[tuple[int, slice, slice]]:
        """Each bucket with its parts of contexts and sequences."""
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1)).tolist()
        behind = np.concatenate([[0], np.cumsum(self.size)]).tolist()
        for start, end in zip(edges, [*edges[1:], len(self.bucket)]):
            yield int(self.bucket[start]), slice(start, end), slice(behind[start], behind[end])


class Grams:
    """The different word sequences of a shard, order by order; numbers of one order build on those of the one before."""

    def __init__(self, shard: dict, learned_texts: int, words: tuple[np.ndarray, np.ndarray]):
        self.ids = X.unpack(shard["ids"])
        self.lengths = X.unpack(shard["lengths"])
        self.taught = np.repeat(X.unpack(shard["learned"]).astype(bool), self.lengths)
        # START has number 0 everywhere and occurs once in each text.
        self.numbers = np.concatenate([[0], words[0]])
        self.counts: list[np.ndarray] = [np.zeros(0, np.int64), np.concatenate([[learned_texts], words[1]])]
        self.at: list[np.ndarray] = [np.zeros(0, np.int64), self.ids]
        self.last: list[np.ndarray] = [np.zeros(0, np.int64), np.arange(len(self.numbers))]
        self.prefix: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
        self.suffix: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
        self.n: list[np.ndarray] = [np.zeros(0, np.int64)] * 2

    def extend(self) -> int:
        """Number the sequences of the next order; its counts are not known yet."""
        order = len(self.at)
        before = np.concatenate([[-1], self.at[-1][:-1]])
        valid = (self.ids != 0) & (before >= 0)
        if order > 2:
            valid &= np.concatenate([[0], self.ids[:-1]]) != 0
        first, number = X.numbered([before[valid], self.ids[valid]])
        places = np.flatnonzero(valid)[first]
        at = np.full(len(self.ids), -1, np.int64)
        at[valid] = number
        self.prefix.append(before[places])
        self.suffix.append(self.at[-1][places])
        self.last.append(self.ids[places])
        self.n.append(np.bincount(number, weights=self.taught[valid], minlength=len(first)).astype(np.int64))
        self.at.append(at)
        return order

    def columns(self, order: int, some: np.ndarray) -> list[np.ndarray]:
        """The corpus' numbers of the words of some sequences, a column for each word."""
        before = self.columns(order - 1, self.prefix[order][some]) if order > 1 else []
        return [*before, self.numbers[self.last[order][some]]]

    def deal(self, order: int, least: int, buckets: int, bucket_keys: int) -> Dealt:
        """Which sequences of an order may occur in training, or more than once if only such are kept, after which contexts.

        All others have a part that never occurs, or occurs once: they occur here alone, if at all.  A context more frequent
        than a bucket is to hold is asked of all the buckets that its sequences are spread over.
        """
        lower, parts, heads = self.counts[order - 1], min(least, 2), self.prefix[order]
        contexts = np.unique(heads)
        contexts = contexts[lower[contexts] >= parts]
        asked = np.flatnonzero((lower[heads] >= parts) & (lower[self.suffix[order]] >= parts))
        home = X.bucket_of(self.columns(order - 1, contexts), buckets)
        spread = np.maximum(-(-lower[contexts] // bucket_keys), 1)
        each = np.minimum(spread, buckets)
        at = np.repeat(np.arange(len(contexts)), each)
        step = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        key = np.sort((home[at] + step) % buckets * len(contexts) + at)
        of = np.searchsorted(contexts, heads[asked])
        bucket = home[of]
        wide = np.flatnonzero(spread[of] > 1)
        if len(wide):
            salt = X.bucket_of(self.columns(order, asked[wide]), 1 << 30) % spread[of[wide]]
            bucket[wide] = (bucket[wide] + salt) % buckets
        there = bucket * len(contexts) + of
        size = np.bincount(np.searchsorted(key, there), minlength=len(key))
        whose = max(len(contexts), 1)
        at = key % whose
        other = size < np.bincount(heads, minlength=len(lower))[contexts][at]
        return Dealt(contexts, at, key // whose, size, other, asked[np.argsort(there, kind="stable")])


def _answer_grams(order: int, least: int):
    """``answer`` rows: the counts of a bucket's sequences.  ``sums`` rows: for each context after which the model knows a word
    how many words follow it 1, 2, … times, more often, and how often these do; the same for their counts one order below.

    A shard that has only words known after a context needs no weight of it and gets no sums.  Whole numbers all, which take a fraction of the room of weights.  Other rows pass through.
    """

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        is_asked = pc.equal(table.column("kind"), "ask")
        others, table = table.filter(pc.invert(is_asked)).select(X.COLUMNS), table.filter(is_asked)
        if not table.num_rows:
            return others.cast(X.ARROW)
        shards = table.column("shard").to_pylist()
        asked = [[X.unpack(d) for d in data] for data in table.column("data").to_pylist()]
        columns = [np.concatenate(c) for c in zip(*asked)]
        sizes, other, (words, n, below) = columns[order - 1], columns[order] > 0, columns[order + 1 :]
        first, context = X.numbered(columns[: order - 1])
        places, number = X.numbered([np.repeat(context, sizes), words])
        counts = np.bincount(number, weights=n, minlength=len(places)).astype(np.int64)
        kept = (counts >= least) & (counts > 0)
        c, of = counts[kept], np.repeat(context, sizes)[places][kept]

        def total(weights: np.ndarray) -> np.ndarray:
            return np.bincount(of, weights=weights, minlength=len(first))

        sums = []
        for counted in (c, below[places][kept]):
            large = counted >= X.TOLD_APART
            sums += [total(counted == r) for r in range(1, X.TOLD_APART)] + [total(large), total(counted * large)]
        # Of the words below, all that are not told apart are the others of those above.
        del sums[2 * X.TOLD_APART]
        sums = [s.astype(np.int64) for s in sums]
        known = np.bincount(of, minlength=len(first)) > 0
        unknown = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=~kept[number], minlength=len(sizes)) > 0
        wanted = known[context] & (other | unknown)
        rows = X.Rows()
        start = at = 0
        for shard, part in zip(shards, asked):
            here, mine = wanted[at : at + len(part[0])], context[at : at + len(part[0])]
            at += len(mine)
            rows.add("answer", bucket, shard, X.pack(counts[number[start : start + len(part[-1])]]))
            start += len(part[-1])
            rows.add("sums", bucket, shard, X.pack(here.astype(np.int64)), *[X.pack(s[mine[here]]) for s in sums])
        rows.add("total", bucket, -1, X.pack(X.histogram(counts)))
        return pa.concat_tables([others.cast(X.ARROW), pa.Table.from_batches([rows.batch()])])

    return answer


@dataclass(frozen=True)
class Setting:
    """What all tasks know of the model: one row of numbers for each order."""

    words: Words
    learned_texts: int
    discounts: tuple[Discounts, ...]  # from two words on
    least: tuple[int, ...]
    buckets: int
    bucket_keys: int


def _known(row: dict, setting: Setting, orders: int, contexts: int) -> tuple[Grams, list, list]:
    """A shard's sequences with the counts of ``orders`` orders and the weights of contexts up to order ``contexts``."""
    answers = X.answers_of(row["answers"], orders + max(contexts - 1, 0))
    size = row["size"]
    words = X.unpack_words(row["words"], size - 1)
    grams = Grams(row, setting.learned_texts, tuple(X.undealt(answers[0], X.word_buckets([w or END for w in words], setting.buckets), 2)))
    alive: list[np.ndarray] = [np.zeros(0, bool)] * 2
    weights: list = [None, None]
    for order in range(2, orders + 1):
        grams.extend()
        least = least_of(order, setting.least)
        dealt = grams.deal(order, least, setting.buckets, setting.bucket_keys)
        counts = np.zeros(len(grams.n[order]), np.int64)
        counts[dealt.asked] = _in_turn(answers[order - 1], 0)
        grams.counts.append(counts)
        alive.append((counts >= least) & (counts > 0))
        if order <= contexts:
            weights.append(_weights(grams, order, dealt, answers[orders + order - 2], setting))
    return grams, alive, weights


def _in_turn(parts: dict[int, list[np.ndarray]], i: int) -> np.ndarray:
    """The ``i``-th columns of all buckets one after the other."""
    return np.concatenate([np.zeros(0, np.int64), *[parts[b][i] for b in sorted(parts)]])


def _weights(grams: Grams, order: int, dealt: Dealt, sums: dict[int, list[np.ndarray]], setting: Setting) -> np.ndarray:
    """The backoff weight of each context: what its words leave, divided by what they leave one order below.

    After a context without sums the model knows no word, and the weight is 1; or it knows all that follow here, and
    the weight is not used.
    """
    here = dealt.at[_in_turn(sums, 0) > 0]
    columns = [_in_turn(sums, i) for i in range(1, 2 * X.TOLD_APART + 2)]
    own, under = columns[: X.TOLD_APART + 1], columns[X.TOLD_APART + 1 :]
    under.insert(X.TOLD_APART - 1, sum(own[:-1]) - sum(under[:-1]))
    below_them = setting.discounts[order - 3] if order > 2 else setting.words.discounts
    # A spread context has sums in several buckets.
    seen, below = [
        np.bincount(here, weights=discounts.sum_of(x), minlength=len(dealt.contexts))
        for discounts, x in ((setting.discounts[order - 2], own), (below_them, under))
    ]
    known = np.unique(here)
    whole = dealt.contexts[known]
    if order == 2:
        scale, occur = setting.words.scale, np.full(len(known), max(setting.words.tokens, 1))
    else:
        scale, occur = 1.0, grams.counts[order - 2][grams.suffix[order - 1][whole]]
    weight = np.ones(len(grams.counts[order - 1]))
    weight[whole] = (1.0 - seen[known] / grams.counts[order - 1][whole]) / (1.0 - scale * below[known] / occur)
    return weight


def _ask(setting: Setting, order: int):
    """Questions of a shard for one order, all below being known: counts of its sequences, sums of their contexts.

    A row has each context once, with the number of its sequences and whether there are others, and of the sequences only the last words.
    """

    def run(batches):
        for batch in batches:
            for row in X.one_by_one(batch):
                grams, _, _ = _known(row, setting, order - 1, 0)
                grams.extend()
                rows = X.Rows()
                dealt = grams.deal(order, least_of(order, setting.least), setting.buckets, setting.bucket_keys)
                alone = int(grams.n[order].sum() - grams.n[order][dealt.asked].sum())
                rows.add("total", -1, row["shard"], X.pack(X.histogram(np.ones(alone, np.int64))))
                contexts = grams.columns(order - 1, dealt.contexts[dealt.at])
                words = grams.numbers[grams.last[order][dealt.asked]]
                n = grams.n[order][dealt.asked]
                below = grams.counts[order - 1][grams.suffix[order][dealt.asked]]
                for bucket, here, asked in dealt.parts():
                    columns = [*[c[here] for c in contexts], dealt.size[here], dealt.other[here].astype(np.int64), words[asked], n[asked], below[asked]]
                    rows.add("ask", bucket, row["shard"], *map(X.pack, columns))
                yield rows.batch()

    return run


def _probabilities(grams: Grams, alive: list, weights: list, setting: Setting) -> np.ndarray:
    """The probability of the token at each place of a shard; 1 at the beginnings of texts."""
    p = setting.words.probability(grams.counts[1])[grams.ids]
    for order in range(2, len(alive)):
        at = grams.at[order]
        here = np.flatnonzero(at >= 0)
        j = at[here]
        context = grams.prefix[order][j]
        own = setting.discounts[order - 2].of(grams.counts[order][j]) / np.maximum(grams.counts[order - 1][context], 1)
        p[here] = np.where(alive[order][j], own, weights[order][context] * p[here])
    p[grams.ids == 0] = 1.0
    return p


def _score(setting: Setting, order: int, key_type):
    names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [key_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        for batch in batches:
            for row in X.one_by_one(batch):
                grams, alive, weights = _known(row, setting, order, order)
                starts = np.cumsum(grams.lengths) - grams.lengths
                words = setting.words
                counts = np.where(grams.ids == 0, 0, grams.counts[1][grams.ids])
                base = np.log10((counts + 1) / (words.tokens + words.different + 1))
                base[grams.ids == 0] = 0.0
                logs = np.log10(_probabilities(grams, alive, weights, setting))
                size = len(starts)
                columns = [
                    row["keys"], ~X.unpack(row["learned"]).astype(bool), grams.lengths - 1, np.add.reduceat((counts > 0).astype(np.int64), starts),
                    np.full(size, words.tokens), np.add.reduceat(base, starts), np.add.reduceat(logs, starts),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return run


def katz_scores(
    docs: DataFrame, learned: Column, key: str = "doc_id", text: str = "text", order: int = ORDER,
    least: tuple[int, ...] = LEAST, shard_tokens: int = X.SHARD_TOKENS, bucket_keys: int = X.BUCKET_KEYS,
) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    The model learns from the rows where ``learned`` holds (null: it does not), the others are held out.  Words are
    what lies between ASCII white space, A-Z lower-cased; a text's tokens are its words and one end.  ``score`` is the log10
    probability of all tokens, ``base_score`` that of single words with one added to each count.  A null text counts as
    empty: one token.  Rows with a null or repeated key are scored each; other columns are not looked at; an
    empty table gives an empty result.  Without anything to learn from every token is unknown and has probability 1.
    ``least`` are the fewest occurrences for each order, not falling.
    """
    if order < 1 or any(a > b for a, b in zip(least, least[1:])):
        raise ValueError("order must be positive and least must not fall")
    require(docs, key, text)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.coalesce(learned, F.lit(False)).alias("learned"), text_or_empty(text).alias("text"))
    shards = X.by_shard(rows.mapInArrow(_cut(to_arrow_type(kind), shard_tokens), f"{SHARD}, keys array<{kind.simpleString()}>"), "shards")
    buckets = X.buckets_for(shards, bucket_keys)

    def ask_words(batches):
        for batch in batches:
            for row in X.one_by_one(batch):
                asked = X.Rows()
                words = [w or END for w in X.unpack_words(row["words"], row["size"] - 1)]
                X.ask_words(asked, row["shard"], words, X.unpack(row["counts"])[1:], buckets)
                yield asked.batch()

    asked = shards.select("shard", "size", "words", "counts").mapInArrow(ask_words, X.ROW)
    known = [staged(X.exchanged(asked, X.answer_words(buckets, 1, keep=False)), "words")]
    words = Words.fit(X.totals(known[0]))
    texts = rows.where("learned").count()
    setting = Setting(words, texts, (), least, buckets, bucket_keys)
    sums: list[DataFrame] = []
    for now in range(2, order + 1):
        least_here = least_of(now, least)
        questions = X.with_answers(shards, *known).mapInArrow(_ask(setting, now), X.ROW)
        grams = X.written(X.exchanged(questions, _answer_grams(now, least_here)), "grams")[0]
        discounts = Discounts.fit(X.totals(grams)[2:], least_here)
        known.append(grams)
        sums.append(grams.where("kind = 'sums'").withColumn("kind", F.lit("answer")))
        setting = Setting(words, texts, (*setting.discounts, discounts), least, buckets, bucket_keys)
    schema = f"key {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scored = X.with_answers(shards, *known, *sums).mapInArrow(_score(setting, order, to_arrow_type(kind)), schema)
    return scored.withColumnRenamed("key", key)
