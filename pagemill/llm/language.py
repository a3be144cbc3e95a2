"""Language of texts and pages by Bayesian fusion of independent evidence.

Four kinds of evidence are fused by adding logarithms:

* the text: character trigrams of its words under one model per language and under a
  background model (``und``) in which all trigrams are alike.  Trigrams of a text depend on
  each other, so a text counts as ``EVIDENCE`` trigrams at most;
* a declared markup language, right with probability ``DECLARED``;
* the address's suffix, for suffixes of countries;
* the host: how often its other texts are in each language.  Counts are smoothed towards the
  registered domain's, these towards the suffix's, and these towards those of all texts.  They are sums
  of the texts' own posteriors by host, computed by grouped aggregation over all rows.

A text is rejected when it has no letters, when the background model explains it better
than any language, or when the best language's probability is below ``MIN_CONFIDENCE``.

The trigram models are fitted on a sample of labelled rows, bounded by ``SAMPLE_ROWS`` rows per language and
``SAMPLE_CHARS`` characters per row, and on a few common words per language, which alone
serve where there are no labelled rows.  The sample's trigrams are counted by tasks; the driver gets one
number for each bucket and language, never a text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.llm.common import WordTable, link_map, require, staged, text_or_empty

UNKNOWN = "und"
BUCKETS = 1 << 15
EVIDENCE = 60.0
DECLARED = 0.9
SUFFIX = 0.8
SMOOTHING = 20.0
MIN_CONFIDENCE = 0.4
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000
# How much one trigram that was never seen counts in fitting.
UNSEEN = 0.1

# Common words.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "en": "the of and to in is that it was for on are as with his they at be this have from or had by not but what all were when we",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya",
    "fr": "de la le et les des en un du une que est pour qui dans par plus au sur ne se pas il ce avec sont son elle nous vous mais",
}
# Languages of country suffixes.
COUNTRIES = {"at": "de", "de": "de", "es": "es", "fr": "fr", "mx": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "ar": "es"}

_LETTERS = re.compile(r"[^\W\d_]+")


def trigrams(word: str) -> list[int]:
    """Buckets of the trigrams of each run of letters in a word, with its ends marked."""
    found = []
    for part in _LETTERS.findall(word.lower()):
        marked = f"<{part}>".encode()
        found += [zlib.crc32(marked[i : i + 3]) % BUCKETS for i in range(len(marked) - 2)]
    return found


@dataclass
class TextModel:
    """Log-probability of each trigram bucket (rows) in each language and, last, the background."""

    languages: list[str]
    table: np.ndarray

    def evidence(self, words: list[str]) -> np.ndarray:
        """For each word the sums of log-probabilities, and its number of trigrams."""
        out = np.zeros((len(words), self.table.shape[1] + 1), np.float32)
        lists = [trigrams(w) for w in words]
        sizes = np.array([len(x) for x in lists])
        flat = np.fromiter((b for x in lists for b in x), np.int64)
        at = np.repeat(np.arange(len(words)), sizes)
        for k in range(self.table.shape[1]):
            out[:, k] = np.bincount(at, self.table[flat, k], len(words))
        out[:, -1] = sizes
        return out


def trigram_counts(texts: Iterable[str], languages: Iterable[str]) -> dict[str, np.ndarray]:
    """How often each trigram bucket occurs in the texts of each language."""
    words: dict[str, Counter[str]] = {}
    for text, language in zip(texts, languages):
        words.setdefault(language, Counter()).update(text.split())
    counts = {}
    for language, found in words.items():
        lists = [trigrams(w) for w in found]
        times = np.repeat(np.array([*found.values()], np.int64), np.array([len(x) for x in lists], np.int64))
        flat = np.fromiter((b for x in lists for b in x), np.int64, len(times))
        counts[language] = np.bincount(flat, times, BUCKETS).astype(np.int64)
    return counts


def fit(texts: Iterable[str], languages: Iterable[str]) -> TextModel:
    return fit_counts(trigram_counts(texts, languages))


def fit_counts(found: dict[str, np.ndarray]) -> TextModel:
    """Fit on counts of trigram buckets and the common words; a language may have counts of nothing."""
    names = sorted({*found, *COMMON})
    counts = np.zeros((BUCKETS, len(names)))
    for part in (found, trigram_counts(COMMON.values(), COMMON)):
        for language, n in part.items():
            counts[:, names.index(language)] += n
    smooth = counts + UNSEEN
    table = np.log(smooth / smooth.sum(axis=0))
    return TextModel(names, np.column_stack([table, np.full(BUCKETS, -np.log(BUCKETS))]))


def _bucket_rows(batch) -> dict:
    """``l, bucket, n`` of a batch ``l, t``; each language has a row at least, if its texts have no trigram, too."""
    found = trigram_counts(batch.column("t").to_pylist(), batch.column("l").to_pylist())
    at = {language: np.union1d([0], np.flatnonzero(n)).astype(np.int64) for language, n in found.items()}
    return {
        "l": [language for language, buckets in at.items() for _ in buckets],
        "bucket": np.concatenate([np.zeros(0, np.int64), *at.values()]),
        "n": np.concatenate([np.zeros(0, np.int64), *(found[language][buckets] for language, buckets in at.items())]),
    }


def fit_on(docs: DataFrame, text: str = "text", language: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> TextModel:
    """Fit on at most ``rows`` rows of each language, chosen by a hash of their texts."""
    require(docs, text, language)
    known = docs.select(F.col(text).alias("t"), F.lower(F.trim(F.col(language))).alias("l"))
    known = known.where(F.col("l").rlike("^[a-z]{2,3}$") & (F.length("t") <= chars) & (F.length("t") > 0))
    known = known.withColumn("h", F.xxhash64("t"))
    # The choice is made on hashes; the texts chosen, each once, are counted where they are.
    # Each language has rows of its own, so a rare one is in the model however large the others are.
    hashes = known.groupBy("h").agg(F.min("l").alias("l"))
    sizes = hashes.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    # Hashes are uniform: the lowest part of a language's, twice what is wanted and some, holds the smallest;
    # so no task ever orders a whole language.
    share = F.col("h").cast("double") / 2.0**64 + 0.5
    low = hashes.join(F.broadcast(sizes), "l").where(share * F.col("n") <= 2 * rows + 100)
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    picked = low.withColumn("nth", nth).where(F.col("nth") <= rows).select("h")
    chosen = known.join(F.broadcast(picked), "h").groupBy("h").agg(F.min(F.struct("l", "t")).alias("r"))
    sums = link_map(chosen.select("r.*"), _bucket_rows, "l string, bucket bigint, n bigint")
    found: dict[str, np.ndarray] = {}
    for batch in sums.groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        names, buckets, n = batch.column("l").to_pylist(), batch.column("bucket").to_numpy(), batch.column("n").to_numpy()
        for name in set(names):
            own = np.array([x == name for x in names])
            found.setdefault(name, np.zeros(BUCKETS, np.int64))[buckets[own]] = n[own]
    return fit_counts(found)


def _log_likelihoods(model: TextModel):
    width = model.table.shape[1] + 1
    state = {}

    def run(batch):
        if not state:
            state["table"] = WordTable(model.evidence, width)
        found = []
        for t in batch.column("text").to_pylist():
            sums = state["table"].rows(t.split()).sum(axis=0, dtype=np.float64)
            found.append(np.append(sums[:-1] * min(1.0, EVIDENCE / max(sums[-1], 1.0)), sums[-1]))
        return {"evidence": found}

    return run


def text_evidence(docs: DataFrame, text: str, model: TextModel, out: str) -> Column:
    """A column with the log-likelihood per language, the background's, and the number of trigrams."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    run = _log_likelihoods(model)

    @pandas_udf("array<double>")
    def of(texts):
        import pyarrow as pa

        return pd.Series(run(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]))["evidence"])

    # A filter on the evidence would otherwise be pushed below and read every text a second time, in workers of its own.
    return of.asNondeterministic()(text_or_empty(text)).alias(out)


def host_of(address: Column) -> Column:
    """Lower-case host name of an address, null if it has none."""
    found = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name; a name without dots is its own domain."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host name with dots, null for others."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def _weights(scores: Column) -> Column:
    """Log scores as weights in proportion to probabilities; the largest weight is 1."""
    return let(scores, lambda all_: let(F.array_max(all_), lambda top: F.transform(all_, lambda s: F.exp(s - top))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def host_priors(evidence: DataFrame, languages: int, smoothing: float = SMOOTHING) -> DataFrame:
    """``host, prior`` from rows ``host, e``: each level's share of languages, smoothed towards the next.

    Texts without letters say nothing.  The hosts' sums are aggregated before they are shuffled, so a host with a
    third of all rows costs no more than others; the levels above are sums of hosts' sums.
    """
    own = let(_weights(F.slice("e", 1, languages)), lambda w: F.transform(w, lambda x: x / _sum(w)))
    telling = F.col("host").isNotNull() & (F.get("e", F.lit(languages + 1)) > 0)
    sums = evidence.where(telling).select("host", own.alias("p"))
    sums = sums.groupBy("host").agg(*[F.sum(F.get("p", F.lit(k))).alias(f"p{k}") for k in range(languages)])
    hosts = staged(sums.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")

    def level(name: str) -> DataFrame:
        counts = F.array(*[F.sum(f"p{k}") for k in range(languages)])
        return hosts.groupBy(F.col(name).alias(f"_{name}")).agg(counts.alias(f"{name}_n"))

    def smoothed(counts: Column, parent: Column) -> Column:
        return F.zip_with(counts, parent, lambda n, p: (n + F.lit(smoothing) * p) / (_sum(counts) + F.lit(smoothing)))

    total = hosts.agg(*[F.sum(f"p{k}") for k in range(languages)]).first()  # one number per language
    weight = sum(x or 0.0 for x in total) + smoothing
    everywhere = [((x or 0.0) + smoothing / languages) / weight for x in total]
    table = hosts.withColumn("all_p", F.array(*[F.lit(x) for x in everywhere]))
    for name in ("suffix", "domain"):
        above = level(name)
        table = table.join(above, F.col(name).eqNullSafe(F.col(f"_{name}")), "left").drop(f"_{name}")
    own_n = F.array(*[f"p{k}" for k in range(languages)])
    prior = table.withColumn("suffix_p", smoothed(F.col("suffix_n"), F.col("all_p")))
    prior = prior.withColumn("domain_p", smoothed(F.col("domain_n"), F.col("suffix_p")))
    return staged(prior.select("host", smoothed(own_n, F.col("domain_p")).alias("prior")), "priors")


def decided(evidence: DataFrame, priors: DataFrame, model: TextModel, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Add ``language, confidence, accepted`` to rows ``host, declared, e``; ``host`` and the rest stay."""
    names = model.languages
    n = len(names)
    rows = evidence.alias("e").join(
        priors.select(F.col("host").alias("__host"), "prior"), F.col("e.host") == F.col("__host"), "left"
    )
    suffix = suffix_of(F.col("host"))
    country = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])[F.coalesce(suffix, F.lit(""))]
    declared = F.substring_index(F.lower(F.trim("declared")), "-", 1)

    listed = F.array(*[F.lit(name) for name in names])

    def says(value: Column, right: float) -> Column:
        wrong = math.log((1 - right) / max(n - 1, 1))
        one = F.transform(listed, lambda name: F.when(name == value, math.log(right)).otherwise(wrong))
        return F.when(value.isin(*names), one).otherwise(F.array_repeat(F.lit(0.0), n))

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    prior = F.coalesce("prior", F.array_repeat(F.lit(1.0 / n), n))
    scores = plus(F.slice("e", 1, n), F.transform(prior, lambda p: F.log(p)))
    rows = rows.withColumn("__w", _weights(plus(plus(scores, says(declared, DECLARED)), says(country, SUFFIX))))
    # The best language has the weight 1.
    rows = rows.withColumn("__best", F.get(listed, F.array_position("__w", 1.0).cast("int") - 1))
    rows = rows.withColumn("__p", F.lit(1.0) / _sum(F.col("__w")))
    has_letters = F.get("e", F.lit(n + 1)) > 0
    known = has_letters & (F.array_max(F.slice("e", 1, n)) >= F.get("e", F.lit(n)))
    return rows.select(
        *evidence.columns,
        F.when(known, F.col("__best")).otherwise(F.lit(UNKNOWN)).alias("language"),
        F.when(has_letters, F.col("__p")).otherwise(F.lit(0.0)).alias("confidence"),
        (known & (F.col("__p") >= min_confidence)).alias("accepted"),
    )


def identify(
    docs: DataFrame,
    model: TextModel,
    keys: list[str],
    text: str = "text",
    host: Column | None = None,
    declared: Column | None = None,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``keys, language, confidence, accepted`` for every row.

    ``host`` is a host name or another name of the source, ``declared`` a markup language; either
    may be null or left out and then says nothing.  A null text counts as empty.  Texts without letters are ``und``
    with confidence 0 and rejected.  Repeated rows are decided each and count each in their host's
    prior.  Of equally likely languages the first in alphabetical order is taken.  An empty table gives an
    empty result.
    """
    require(docs, text, *keys)
    nothing = F.lit(None).cast("string")
    parts = docs.select(
        F.struct(*keys).alias("key"),
        (nothing if host is None else host.cast("string")).alias("host"),
        (nothing if declared is None else declared.cast("string")).alias("declared"),
        text_evidence(docs, text, model, "e"),
    )
    parts = staged(parts, "evidence")
    found = decided(parts, host_priors(parts, len(model.languages)), model, min_confidence)
    return found.select("key.*", "language", "confidence", "accepted")


def keep_known(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` whose language is recognised, all columns kept.

    Fits the text model on the rows' own labels (bounded sample), takes ``source`` for the host and the label for
    nothing else.  The texts are read twice and never shuffled for the decision.
    """
    model = fit_on(docs, text, language)
    n = len(model.languages)
    parts = docs.select(F.col(source).cast("string").alias("host"), text_evidence(docs, text, model, "e"))
    priors = host_priors(parts, n)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(source).cast("string").alias("host"),
        F.lit(None).cast("string").alias("declared"),
        text_evidence(docs, text, model, "e"),
    )
    return decided(rows, priors, model).where("accepted").select("row.*")
