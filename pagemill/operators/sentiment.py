"""Polarity and subjectivity of documents from a word list."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let

# Word -> (polarity -1..1, subjectivity 0..1).  A small hand-made list; pass
# another DataFrame of the same shape for other purposes.
LEXICON = {
    "awful": (-0.9, 1.0),
    "bad": (-0.7, 0.7),
    "best": (1.0, 0.3),
    "better": (0.5, 0.5),
    "clown": (-0.4, 0.8),
    "cheap": (-0.2, 0.6),
    "disgusting": (-1.0, 1.0),
    "fool": (-0.6, 0.9),
    "free": (0.4, 0.6),
    "garbage": (-0.8, 0.8),
    "gain": (0.4, 0.3),
    "good": (0.7, 0.6),
    "great": (0.8, 0.75),
    "happy": (0.8, 1.0),
    "hate": (-0.8, 0.9),
    "idiot": (-0.8, 0.9),
    "loser": (-0.6, 0.8),
    "loss": (-0.4, 0.3),
    "love": (0.5, 0.6),
    "nice": (0.6, 1.0),
    "optimistic": (0.6, 0.7),
    "pathetic": (-1.0, 1.0),
    "record": (0.2, 0.1),
    "strong": (0.4, 0.7),
    "stupid": (-0.8, 1.0),
    "ugly": (-0.7, 1.0),
    "weak": (-0.4, 0.6),
    "worst": (-1.0, 1.0),
    "worthless": (-0.8, 0.9),
}
# A negated word counts with this factor.
NEGATION = -0.5
NEGATORS = ("not", "no", "never")
# Lists up to this length become part of the plan.
SMALL = 500


def lexicon_frame(spark) -> DataFrame:
    """The list as a table: ``word, polarity, subjectivity``."""
    rows = [(w, p, s) for w, (p, s) in LEXICON.items()]
    return spark.createDataFrame(rows, "word string, polarity double, subjectivity double")


def listed(lexicon: DataFrame) -> dict[str, tuple[float, float]] | None:
    """A list of at most ``SMALL`` entries as a dictionary; None for a longer one, or one with repeated entries."""
    rows = lexicon.select("word", "polarity", "subjectivity").limit(SMALL + 1).collect()
    found = {r["word"]: (r["polarity"], r["subjectivity"]) for r in rows if r["word"] is not None}
    return found if len(rows) <= SMALL and len(found) == len(rows) else None


def scores(
    text: Column,
    entries: Mapping[str, tuple[float, float]],
    negators: Sequence[str] = NEGATORS,
    intensifiers: Mapping[str, float] | None = None,
) -> Column:
    """``polarity, subjectivity, n_hits`` of a text as a struct, without leaving the row.

    Entries are one or more words, lower-case ASCII letters with single spaces; others never occur.  A text is read from left
    to right; of the entries that begin at a word the one with the most words counts, and reading goes on behind
    it.  An intensifier right before an entry multiplies its polarity by the given number, a negator
    right before the entry or its intensifier by ``NEGATION``.  Both values are means over the entries found.
    """
    usable = {e: v for e, v in entries.items() if re.fullmatch("[a-z]+( [a-z]+)*", e) and None not in v}
    zero = F.struct(F.lit(0.0).alias("polarity"), F.lit(0.0).alias("subjectivity"), F.lit(0).cast("bigint").alias("n_hits"))
    if not usable:
        return zero
    gap = "[^a-z]++"
    longest_first = sorted(usable, key=lambda e: (-e.count(" "), -len(e), e))
    entry = f"(?:{'|'.join(e.replace(' ', gap) for e in longest_first)})(?![a-z])"
    factors = {**{w: NEGATION for w in negators}, **(intensifiers or {})}
    # A modifier counts only where it stands before an entry: it is found together with the gap behind it.  An entry of
    # several words that begins with a modifier goes first.
    several = [e.replace(" ", gap) for e in longest_first if " " in e]
    ways = [entry]
    if intensifiers:
        strong = f"(?:{'|'.join(sorted(intensifiers, key=len, reverse=True))}){gap}"
        ways.insert(0, f"{strong}(?={entry})")
    else:
        strong = ""
    if negators:
        after = f"(?:{strong})?{entry}" if strong else entry
        ways.insert(0, f"(?:{'|'.join(sorted(negators, key=len, reverse=True))}){gap}(?={after})")
    if several:
        ways.insert(0, f"(?:{'|'.join(several)})(?![a-z])")
    # A look at the letter first: most of a text begins no entry and no modifier.
    first = {word[:1] for word in [*usable, *factors]}
    begins = f"(?=[{''.join(sorted(first))}])" if all(re.fullmatch("[a-z]", c) for c in first) else ""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"{begins}(?<![a-z])(?:{'|'.join(ways)})"), F.lit(0))

    def table(values: Mapping[str, tuple[float, float] | float], kind: str) -> Column:
        cells = [F.struct(*[F.lit(float(x)) for x in v]) if isinstance(v, tuple) else F.lit(float(v)) for v in values.values()]
        pairs = [c for word, cell in zip(values, cells) for c in (F.lit(word), cell)]
        return F.create_map(*pairs) if pairs else F.create_map().cast(f"map<string,{kind}>")

    values, turns = table(usable, "struct<col1:double,col2:double>"), table(factors, "double")

    def step(state: Column, token: Column) -> Column:
        def counted(word: Column) -> Column:
            hit, modifies = values[word], token.rlike("[^a-z]$")
            factor = F.when(hit.isNull(), state["factor"]).otherwise(F.lit(1.0))
            return F.struct(
                F.when(modifies, factor * turns[word]).otherwise(F.lit(1.0)).alias("factor"),
                (state["p"] + F.coalesce(hit["col1"] * state["factor"], F.lit(0.0))).alias("p"),
                (state["s"] + F.coalesce(hit["col2"], F.lit(0.0))).alias("s"),
                (state["n"] + hit.isNotNull().cast("bigint")).alias("n"),
            )

        return let(F.trim(F.regexp_replace(token, "[^a-z]+", " ")), counted)

    start = F.struct(F.lit(1.0).alias("factor"), F.lit(0.0).alias("p"), F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"))

    def means(end: Column) -> Column:
        some = end["n"] > 0
        return F.struct(
            F.when(some, end["p"] / end["n"]).otherwise(F.lit(0.0)).alias("polarity"),
            F.when(some, end["s"] / end["n"]).otherwise(F.lit(0.0)).alias("subjectivity"),
            end["n"].alias("n_hits"),
        )

    return F.coalesce(F.aggregate(found, start, step, means), zero)


def lexicon_sentiment(
    docs: DataFrame,
    lexicon: DataFrame,
    key: str | Sequence[str] = "doc_id",
    text: str = "text",
    negators: Sequence[str] = NEGATORS,
    intensifiers: Mapping[str, float] | None = None,
) -> DataFrame:
    """``key, polarity, subjectivity, n_hits`` of every document, 0 without any entry of the list; see ``scores``.

    A word is a run of lower-case ASCII letters after lower-casing.  Lists of up to ``SMALL`` different entries are put into the plan
    and documents are scored row by row, without a shuffle.  Longer ones, of single words only and without intensifiers, meet
    the words in a join, and one partial sum per document and task is shuffled; ``key`` must then tell documents apart.
    """
    keys = [key] if isinstance(key, str) else list(key)
    entries = listed(lexicon)
    if entries is not None:
        return present_scores(docs.select(*keys, text), F.col(text), entries, negators, intensifiers).drop(text)
    if intensifiers or not lexicon.where("word like '% %'").isEmpty():
        raise ValueError(f"phrases and intensifiers need a list of at most {SMALL} different entries")
    return _joined_scores(docs, lexicon, keys, text, negators)


def present_scores(
    docs: DataFrame, text: Column, entries: Mapping[str, tuple[float, float]], negators: Sequence[str] = NEGATORS,
    intensifiers: Mapping[str, float] | None = None,
) -> DataFrame:
    """``docs`` with ``polarity, subjectivity, n_hits`` of ``text``."""
    # Through an array, so that the fold is computed once for all three.
    found = docs.withColumn("__scores", let(text, lambda t: scores(t, entries, negators, intensifiers)))
    return found.select(*docs.columns, F.inline(F.array("__scores")))


def _joined_scores(docs: DataFrame, lexicon: DataFrame, keys: list[str], text: str, negators: Sequence[str]) -> DataFrame:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    # Each word beside the one before it; the surplus entry at the end has no word.
    pairs = F.arrays_zip(F.col("__words").alias("word"), F.concat(F.array(F.lit("")), "__words").alias("before"))
    spoken = (
        docs.select(*keys, words.alias("__words"))
        .select(*keys, F.explode_outer(pairs).alias("w"))
        .select(*keys, F.col("w.word").alias("word"), F.col("w.before").alias("before"))
    )
    scored = spoken.join(lexicon, "word", "left")
    factor = F.when(F.col("before").isin(*negators), F.lit(NEGATION)).otherwise(F.lit(1.0))
    return scored.groupBy(*keys).agg(
        F.coalesce(F.avg(F.col("polarity") * factor), F.lit(0.0)).alias("polarity"),
        F.coalesce(F.avg("subjectivity"), F.lit(0.0)).alias("subjectivity"),
        F.count("polarity").alias("n_hits"),
    )
