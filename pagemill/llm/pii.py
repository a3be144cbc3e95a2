"""Personal data in texts: patterns propose spans, checksums confirm, context adjusts the score.

DataFrame operations only.  Four base kinds are fixed: each is the leftmost
non-overlapping matches of a pattern that pass the kind's check; a match that fails is
dropped and nothing is tried in its place.  Further kinds (``EXTRA``) are added
by the same steps.  Every confirmed span has a score: the kind's base score, raised where
one of the kind's context words stands within ``NEAR`` characters before or
after it.  Extra kinds are kept from ``MIN_SCORE`` on; base kinds are always kept.

Positions are code points.  A text is cut at its matches (a marker that occurs in no
match is put around them), and the lengths of the parts give the positions.  The
patterns run in time proportional to the text: what they begin with is a possessive run that
cannot begin in the middle of another one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.llm.common import require, text_or_empty

NEAR = 40
NEAR_BONUS = 0.3
MIN_SCORE = 0.5
# Parts between matches, and matches, that ``NEAR`` characters can reach: the shortest match has five characters.
PARTS_NEAR = 2 * (NEAR // 5) + 3
# Stands around matches.  No pattern matches it or what a text's own marks are changed to.
MARK, OTHER = "\u0001", "\u0002"
# A text's own control characters while it is redacted, each pair for one; undone from the last to the first.
ESCAPES = ((OTHER, "\u0002\u0004"), (MARK, "\u0002\u0003"))
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

# A number up to 255, leading zeros allowed.
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    backwards = F.split(F.reverse(number), "")

    def value(digit: Column, at: Column) -> Column:
        n = digit.cast("int")
        doubled = n * 2
        return F.when(at % 2 == 0, n).when(doubled > 9, doubled - 9).otherwise(doubled)

    total = F.aggregate(
        F.transform(F.filter(backwards, lambda d: d != ""), value), F.lit(0), lambda s, x: s + x
    )
    return total % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number (capital letters and digits) leaves 1 modulo 97, its first four characters put last."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    characters = F.filter(F.split(turned, ""), lambda c: c != "")
    # A letter counts as two digits: A is 10, Z is 35.
    values = F.transform(characters, lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55))
    rest = F.aggregate(values, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return rest == 1


@dataclass(frozen=True)
class Kind:
    """A pattern whose group 1 is the span, what must be in a text for it to occur, the check, base score, context words."""

    name: str
    pattern: str
    needs: str
    check: Callable[[Column], Column]
    score: float
    context: str


def _in_range(c: Column, low: int, high: int) -> Column:
    return F.char_length(c).between(low, high)


# The base kinds, in the order of their digest.  ``\\G`` is the end of the match before.
BASE = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)([A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)",
        "@",
        lambda m: F.lit(True),
        0.9,
        "mail|contact|write to|kontakt|correo|courriel",
    ),
    Kind(
        "ip",
        r"(?<![0-9])([0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)",
        ".",
        lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        0.6,
        "address|host|server|login|adresse|dirección",
    ),
    Kind(
        "card",
        # A whole chain of digits of the right length; longer and shorter chains are not even proposed.
        r"(?<![0-9])(?<![0-9][\x20-])([0-9](?:[\x20-]?[0-9]){15,18}+)(?![\x20-]?[0-9])",
        "",
        lambda m: luhn(digits(m)),
        0.7,
        "card|visa|credit|karte|tarjeta|carte",
    ),
    Kind(
        "phone",
        r"(\+[0-9][\x20().0-9-]+[0-9])",
        "+",
        lambda m: _in_range(digits(m), 8, 15),
        0.6,
        "phone|call|tel|mobile|fax|telefon|teléfono|téléphone",
    ),
)
EXTRA = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
        "",
        lambda m: _in_range(F.replace(m, F.lit(" "), F.lit("")), 15, 34) & mod_97(F.replace(m, F.lit(" "), F.lit(""))),
        0.8,
        "iban|account|bank|konto|cuenta|compte",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])",
        "-",
        lambda m: F.lit(True),
        0.3,
        "ssn|social security|tax",
    ),
)


def _parts(text: Column, kind: Kind) -> Column:
    """The text cut at the kind's matches: those are the parts with odd numbers from 0."""
    marked = F.regexp_replace(text, kind.pattern, f"{MARK}$1{MARK}")
    return F.split(marked, MARK)


def unmarked(text: Column) -> Column:
    """The text with its own marks changed to another control character of the same length."""
    return F.translate(text, MARK, OTHER)


def _around(parts: Column) -> tuple[Column, Column]:
    """The last and the first ``NEAR`` characters of each part: all of a part that context can need."""
    return F.transform(parts, lambda p: F.right(p, F.lit(NEAR))), F.transform(parts, lambda p: F.left(p, F.lit(NEAR)))


def _says(kind: Kind, around: Column, i: Column) -> Column:
    """Whether a context word stands within ``NEAR`` characters of part ``i``, other matches included."""
    # One by one: slicing would copy the whole array for each match.  Beyond both ends there is nothing to join.
    steps = [F.lit(k) for k in range(1, PARTS_NEAR + 1)]
    before = F.right(F.array_join(F.array(*[F.get(around["ends"], i - k) for k in reversed(steps)]), ""), F.lit(NEAR))
    after = F.left(F.array_join(F.array(*[F.get(around["begins"], i + k) for k in steps]), ""), F.lit(NEAR))
    return F.lower(F.concat(before, F.lit(" "), after)).rlike(rf"(?<![a-z])(?:{kind.context})")


def _with_around(parts: Column) -> Column:
    ends, begins = _around(parts)
    return F.struct(parts.alias("parts"), ends.alias("ends"), begins.alias("begins"))


def confirmed(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind in the order of the text; ``text`` must be ``unmarked``."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(SPANS).alias("out"))

    def walk(around: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            i, at, end = state["i"], state["at"], state["at"] + F.char_length(part)
            good = (i % 2 == 1) & kind.check(part)
            near = _says(kind, around, i)
            score = F.lit(kind.score) + F.when(near, F.lit(NEAR_BONUS)).otherwise(F.lit(0.0))
            span = F.struct(
                F.lit(kind.name).alias("kind"),
                at.alias("start"),
                end.alias("end"),
                F.least(score, F.lit(1.0)).alias("score"),
            )
            return F.struct(
                end.alias("at"),
                (i + 1).alias("i"),
                F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
            )

        return F.aggregate(around["parts"], start, step, lambda s: s["out"])

    def found(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, let(_with_around(parts), walk)).otherwise(F.array().cast(SPANS))

    spans = let(_parts(text, kind), found)
    return F.when(text.contains(kind.needs), spans).otherwise(F.array().cast(SPANS)) if kind.needs else spans


def find_spans(
    docs: DataFrame, keys: Sequence[str], text: str = "text", extra: Sequence[Kind] = EXTRA, min_score: float = MIN_SCORE
) -> DataFrame:
    """``keys, spans`` for every row: an array of ``{kind, start, end, score}`` by kind, then start.

    The base kinds in their order, then ``extra`` kinds with a score of at least ``min_score``.  A null
    text counts as empty; rows without spans have an empty array; repeated rows come out
    each.  Spans of different kinds may overlap.  Other columns are not looked at; an empty table gives
    an empty result.
    """
    require(docs, text, *keys)
    clean = docs.select(*keys, unmarked(text_or_empty(text)).alias("__text"))
    base = [confirmed(F.col("__text"), kind) for kind in BASE]
    more = [F.filter(confirmed(F.col("__text"), kind), lambda s: s["score"] >= min_score) for kind in extra]
    return clean.select(*keys, F.concat(*base, *more).alias("spans"))


def digest(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column) -> Column:
    """The text with confirmed data of every kind replaced by ``<KIND>``; texts without any stay as they are."""

    def replacing(kind: Kind) -> Callable[[Column], Column]:
        certain = kind in BASE or kind.score >= MIN_SCORE

        def marked(around: Column) -> Column:
            def keep(part: Column, i: Column) -> Column:
                good = (i % 2 == 1) & kind.check(part)
                if not certain:
                    # Too weak on its own: context has to say so.
                    good = good & _says(kind, around, i)
                return F.when(good, F.lit(f"<{kind.name.upper()}>")).otherwise(part)

            return F.array_join(F.transform(around["parts"], keep), "")

        def one(parts: Column) -> Column:
            return F.when(F.size(parts) > 1, let(_with_around(parts), marked)).otherwise(F.get(parts, F.lit(0)))

        def replace(value: Column) -> Column:
            done = let(_parts(value, kind), one)
            return F.when(value.contains(kind.needs), done).otherwise(value) if kind.needs else done

        return replace

    # Account numbers first: a run of their digits may look like a card.
    order = [*[k for k in EXTRA if k.name == "iban"], *BASE, *[k for k in EXTRA if k.name != "iban"]]
    out = text
    for own, pair in ESCAPES:
        out = F.replace(out, F.lit(own), F.lit(pair))
    for kind in order:
        out = let(out, replacing(kind))
    for own, pair in reversed(ESCAPES):
        out = F.replace(out, F.lit(pair), F.lit(own))
    return out
