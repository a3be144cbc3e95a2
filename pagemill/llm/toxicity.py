"""Toxicity of whole texts: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams; every n-gram has a vector, a word's vector
is the average of its n-grams' and a passage's the average of its words'.  A
linear softmax on the passage gives the logit.  Vectors and softmax are trained
jointly, in numpy.  Misspellings and inflections never seen in training share
most n-grams with words that were.

A text is toxic if some passage of it is, and a few words among thousands must not be averaged
away, so the bag is a passage of ``PASSAGE`` words, and training follows: after some
steps on whole texts each text trains on the passages that score highest.  The
probability of a text is calibrated on its highest passage, the mean of its highest few,
and the mean of all.

Only the training sample, bounded by ``SAMPLE_ROWS`` rows per label and ``SAMPLE_CHARS``
characters per row, comes to the driver.  Scoring covers every text whole: a word's
logit is computed once per task, a text is a lookup and a running sum.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WordTable, link_map, require, text_or_empty

BUCKETS = 1 << 16
WIDTH = 8
GRAMS = (3, 4, 5)
PASSAGE = 8
TOP = 3
THRESHOLD = 0.3
# Bounds of the training sample: rows per label, and the longest text that takes part in training.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000
# N-grams of fewer texts of the sample are left out: they tell these texts apart, not the labels.
MIN_TEXTS = 5
WARM_STEPS, STEPS = 40, 100
RATE, DECAY = 0.05, 3e-5
SEED = 1


def subwords(word: str) -> list[int]:
    """Buckets of the n-grams of a word between ``<`` and ``>``, and of the word itself."""
    core = word.lower().strip(".,;:!?\"'()[]{}<>|*#$%&=~_-")
    raw = f"<{core or word}>"
    grams = [raw[i : i + n] for n in GRAMS for i in range(len(raw) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in [raw, *grams]]


def bags(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words one after the other, and where each word's begin."""
    parts, sizes = [np.zeros(0, np.int32)], []
    for first in range(0, len(words), at_once):
        lists = [subwords(w) for w in words[first : first + at_once]]
        sizes += [len(x) for x in lists]
        parts.append(np.fromiter((b for x in lists for b in x), np.int32))
    ends = np.cumsum(np.array(sizes, np.int64))
    return np.concatenate(parts), ends - sizes


def passage_logits(word_logits: np.ndarray) -> np.ndarray:
    """Mean word logit of each passage of ``PASSAGE`` words, half overlapping; the last one ends with the text."""
    n = len(word_logits)
    if n <= PASSAGE:
        return word_logits.mean(keepdims=True)
    total = np.concatenate(([0.0], np.cumsum(word_logits, dtype=np.float64)))
    first = passage_starts(n)
    return (total[first + PASSAGE] - total[first]) / PASSAGE


def passage_starts(n: int) -> np.ndarray:
    if n <= PASSAGE:
        return np.zeros(1, np.int64)
    first = np.arange(0, n - PASSAGE + 1, PASSAGE // 2)
    return first if first[-1] == n - PASSAGE else np.append(first, n - PASSAGE)


def features(word_logits: np.ndarray, bias: float) -> tuple[float, float, float]:
    """What a text's probability is calibrated on."""
    if not len(word_logits):
        return bias, bias, bias
    logits = passage_logits(word_logits) + bias
    top = np.sort(logits)[-TOP:]
    return float(top[-1]), float(top.mean()), float(word_logits.mean() + bias)


@dataclass
class Model:
    """Logit of every subword bucket (vector times softmax), bias, and the calibration."""

    bucket_logits: np.ndarray
    bias: float
    weights: np.ndarray

    def word_logits(self, words: list[str]) -> np.ndarray:
        flat, starts = bags(words)
        sums = np.add.reduceat(self.bucket_logits[flat], starts)
        return sums / np.diff(np.append(starts, len(flat)))

    def probability(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip(rows @ self.weights[:-1] + self.weights[-1], -30, 30)
        return 1 / (1 + np.exp(-z))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, 0.0, 0.0, 0

    def step(self, gradient):
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient * gradient
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        return self.rate * m / (np.sqrt(v) + 1e-8)


def train(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Model:
    """Fit on texts with labels 0 and 1.  With one label only, every text gets that label's frequency."""
    labels = np.asarray(labels, np.float64)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in t.split()], np.int64) for t in texts]
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, labels = [docs[i] for i in keep], labels[keep]
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    if not docs or labels.min() == labels.max():
        flat_model = np.zeros(4)
        flat_model[-1] = np.log(share / (1 - share))
        return Model(np.zeros(BUCKETS), 0.0, flat_model)
    flat, starts = bags(list(index))
    sizes = np.diff(np.append(starts, len(flat)))
    rng = np.random.default_rng(seed)
    used = _texts_of_buckets(docs, flat, starts, sizes) >= MIN_TEXTS
    vectors = rng.normal(scale=0.1, size=(BUCKETS, WIDTH)) * used[:, None]
    softmax, bias = rng.normal(scale=0.5, size=WIDTH), float(np.log(share / (1 - share)))
    move_vectors, move_softmax, move_bias = _Adam(RATE), _Adam(RATE), _Adam(RATE)
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    words = np.concatenate(docs)
    ends = np.cumsum([len(d) for d in docs])
    begins = ends - [len(d) for d in docs]
    starts_of = [passage_starts(len(d)) for d in docs]
    passage_doc = np.repeat(np.arange(len(docs)), [len(s) for s in starts_of])
    passage_from = np.concatenate([b + s for b, s in zip(begins, starts_of)])
    passage_to = np.minimum(passage_from + PASSAGE, ends[passage_doc])
    passage_at = np.concatenate(([0], np.cumsum([len(s) for s in starts_of])))
    for step in range(WARM_STEPS + STEPS):
        word_logits = np.add.reduceat((vectors @ softmax)[flat], starts) / sizes
        total = np.concatenate(([0.0], np.cumsum(word_logits[words])))
        if step < WARM_STEPS:
            lo, hi, of = begins, ends, np.arange(len(docs))
        else:
            logits = (total[passage_to] - total[passage_from]) / (passage_to - passage_from)
            order = np.lexsort((logits, passage_doc))
            best = order[passage_at[1:] - 1]
            second = order[np.maximum(passage_at[1:] - 2, passage_at[:-1])]
            chosen = np.concatenate([best, second])
            lo, hi, of = passage_from[chosen], passage_to[chosen], passage_doc[chosen]
        z = (total[hi] - total[lo]) / (hi - lo) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[of]) * weight[of]
        # Each word of a bag gets an equal share of its error, each n-gram an equal share of its word's.
        span = hi - lo
        spots = np.arange(span.sum()) + np.repeat(lo - (np.cumsum(span) - span), span)
        per_word = np.bincount(words[spots], np.repeat(error / span, span), len(sizes)) / sizes
        per_bucket = np.bincount(flat, np.repeat(per_word, sizes), BUCKETS) * used
        vector_step = move_vectors.step(np.outer(per_bucket, softmax) + DECAY * vectors)
        softmax = softmax - move_softmax.step(per_bucket @ vectors)
        vectors = vectors - vector_step
        bias = float(bias - move_bias.step(error.sum()))
    model = Model(vectors @ softmax, bias, np.zeros(4))
    word_logits = model.word_logits(list(index))
    rows = np.array([features(word_logits[d], bias) for d in docs])
    model.weights = _calibrate(rows, labels)
    return model


def _texts_of_buckets(docs: list[np.ndarray], flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """In how many texts each bucket occurs."""
    counts = np.zeros(BUCKETS, np.int64)
    for doc in docs:
        words = np.unique(doc)
        span = sizes[words]
        spots = np.arange(span.sum()) + np.repeat(starts[words] - (np.cumsum(span) - span), span)
        counts[np.unique(flat[spots])] += 1
    return counts


def _calibrate(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the features, lightly damped, by Newton steps."""
    scale = rows.std(axis=0) + 1e-9
    x = np.column_stack([rows / scale, np.ones(len(rows))])
    w = np.zeros(4)
    damp = np.diag([1.0, 1.0, 1.0, 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + damp
        w = w - np.linalg.solve(h, x.T @ (p - labels) + damp @ w)
    return np.append(w[:3] / scale, w[3])


def training_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, label: str, rows: int, chars: int
) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``rows`` rows per label, chosen by a hash of the key."""
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & learn)
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    order = [F.xxhash64("key", F.lit(SEED)), F.col("key")]
    picked = known.where("label = 1").orderBy(*order).limit(rows)
    picked = picked.unionByName(known.where("label = 0").orderBy(*order).limit(rows))
    texts = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    # The picked keys are at most 2 * rows: small by construction.
    joined = texts.where(F.length("text") <= chars).join(F.broadcast(picked), "key").select("key", "text", "label")
    # Repeated keys must not exceed the bound either.
    found = joined.orderBy("key", "text").limit(2 * rows).collect()
    return [r["text"] for r in found], np.array([r["label"] for r in found], np.int64)


def score_texts(docs: DataFrame, model: Model, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``key, score, predicted`` for every row."""

    def run(batch):
        nonlocal table
        if table is None:
            table = WordTable(lambda words: model.word_logits(words)[:, None], 1)
        rows = []
        for t in batch.column("text").to_pylist():
            words = t.split()
            rows.append(features(table.rows(words)[:, 0].astype(np.float64), model.bias))
        score = model.probability(np.array(rows).reshape(-1, 3))
        return {
            "key": batch.column("key"),
            "score": score,
            "predicted": (score >= threshold).astype(np.int32),
        }

    table = None
    kind = docs.schema[key].dataType.simpleString()
    scored = link_map(
        docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")),
        run,
        f"key {kind}, score double, predicted int",
    )
    return scored.withColumnRenamed("key", key)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``key, score, predicted``: the probability of ``label`` for every text, and whether it reaches ``threshold``.

    The model is fitted on rows of ``labels`` where ``learn`` holds (a condition on the key); a
    null key or a label other than 0 and 1 takes no part, and of labels that disagree the larger
    counts.  A null text counts as empty; an empty text gets the score of a text without any
    evidence.  Repeated rows are scored each.  Without labelled rows of both kinds every score is
    the share of the label, one half if there are none.  An empty table gives an empty result.
    """
    require(docs, key, text)
    require(labels, key, label)
    texts, marks = training_sample(docs, labels, learn, key, text, label, sample_rows, sample_chars)
    return score_texts(docs, train(texts, marks), key, text, threshold)
