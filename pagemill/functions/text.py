"""Text clean-up as plain column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a decomposition in Unicode that still are variants of one ASCII letter.
VARIANTS = dict(zip("ØøŁłĐđĦħŦŧıſÐð", "OoLlDdHhTtisDd", strict=True))


def _accented() -> dict[str, str]:
    """Latin letters up to Extended-B and those of Extended Additional whose decomposition begins with an ASCII letter."""
    letters = map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
    plain = {c: unicodedata.normalize("NFD", c)[0] for c in letters}
    return {c: base for c, base in plain.items() if base.isascii() and base.isalpha()} | VARIANTS


FOLDED = _accented()
ACCENTED, PLAIN = "".join(FOLDED), "".join(FOLDED.values())
# Characters that fold to more than one letter, or to punctuation.
SPELLED_OUT = {
    "ß": "ss",
    "Æ": "AE",
    "æ": "ae",
    "Œ": "OE",
    "œ": "oe",
    "Þ": "Th",
    "þ": "th",
    "Ŋ": "NG",
    "ŋ": "ng",
    "Ĳ": "IJ",
    "ĳ": "ij",
    "–": "-",
    "—": "--",
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "…": "...",
    "\u00a0": " ",
}
UNKNOWN = "[?]"

# Named entities as the standard lists them; `apos` is the one it leaves out.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
# Numbers that old pages use for the characters of their own code page.
CODE_PAGE = {n: bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once.

    An expression that uses its input several times would repeat the whole
    input each time, since Spark shares nothing inside lambdas and branches.
    """
    # A fold over no items at all: ``value`` is the start, ``f`` the end.  Taking ``f`` of an array of one out of it again
    # costs more than most ``f``: its type is worked out anew, level by level, for every row.
    return F.aggregate(F.array().cast("array<int>"), value, lambda found, _: found, f)


def non_empty(value: Column) -> Column:
    """NULL for '' (``nullif`` would compute the value twice inside lambdas)."""
    return let(value, lambda v: F.when(v != "", v))


def strip(c: Column) -> Column:
    """Whitespace of any kind off both ends (``trim`` takes spaces only)."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def ws_collapse(c: Column) -> Column:
    """Every run of whitespace becomes one space; ends trimmed."""
    # A single space, which most runs are, is left as it is.
    return F.trim(F.regexp_replace(c, r"\s{2,}|[^\S ]", " "))


def space_collapse(c: Column) -> Column:
    """Every run of spaces becomes one space, other whitespace stays; ends trimmed."""
    return strip(F.regexp_replace(c, " {2,}", " "))


def newline_to_space(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def ascii_fold(c: Column, unknown: str = UNKNOWN) -> Column:
    """Transliterate Latin text to ASCII; what has no counterpart becomes ``unknown``."""
    foreign = r"[^\x00-\x7F]"

    def spell_out(letters: Column) -> Column:
        spelled = letters
        for char, ascii_text in SPELLED_OUT.items():
            spelled = F.replace(spelled, F.lit(char), F.lit(ascii_text))
        return F.when(letters.rlike(foreign), F.regexp_replace(spelled, foreign, unknown)).otherwise(letters)

    # Most texts are done after a look, most others after the single letters.
    return let(
        c, lambda v: F.when(v.rlike(foreign), let(F.translate(v, ACCENTED, PLAIN), spell_out)).otherwise(v)
    )


def slugify(title: Column, suffix: str = ".json") -> Column:
    """File name of a title: spaces to underscores, only portable characters kept."""
    return F.regexp_replace(F.replace(F.concat(title, F.lit(suffix)), F.lit(" "), F.lit("_")), r"[^-_.() A-Za-z0-9]", "")


def url_template(template: str, **fields: Column) -> Column:
    """Fill ``{name}`` marks of a template."""
    filled = F.lit(template)
    for name, value in fields.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value.cast("string"))
    return filled


def page_kind_url(base: str, category: Column, year: Column, surname: Column, ending: Column) -> Column:
    """``base/category/laureates/year/surname`` + ``ending`` such as ``-bio.html``."""
    return F.concat(
        F.lit(base.rstrip("/") + "/"), category, F.lit("/laureates/"), year.cast("string"), F.lit("/"),
        F.lower(surname), ending,
    )


def external_id(title: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(title, F.lit(" "), F.lit("-")))


def first_digits(c: Column) -> Column:
    """The first run of digits, NULL if there is none."""
    return F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit(""))


def strip_label(c: Column, label: str) -> Column:
    return strip(F.replace(c, F.lit(label), F.lit("")))


def contains_ci(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle.lower()))


def split_nth(c: Column, separator: str, k: int) -> Column:
    """The k-th part (0-based) between literal separators, NULL past the end."""
    quoted = "".join("\\" + ch if not ch.isalnum() and ch.isprintable() and not ch.isspace() else ch for ch in separator)
    return F.get(F.split(c, quoted), F.lit(k))


def share_label(c: Column) -> Column:
    """``3`` -> ``1/3``; NULL stays NULL."""
    return F.concat(F.lit("1/"), c.cast("string"))


def share_denominator(c: Column) -> Column:
    """``3`` or ``1/3`` -> 3."""
    return F.regexp_extract(c, r"^(?:1/)?(\d+)$", 1).try_cast("int")


def recode_value(c: Column, mapping: dict[str, str]) -> Column:
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)) if out is None else out.when(c == old, F.lit(new))
    return out.otherwise(c)


def default_fill(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def url_last_segment(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def _text_map(entries: dict[str, str]) -> Column:
    """A constant map made from one text: a literal for each key and value would have every rule of the planner walk over all of them."""
    text = "\x02".join(f"{key}\x01{value}" for key, value in entries.items())
    return F.str_to_map(F.lit(text), F.lit("\x02"), F.lit("\x01"))


def entity_decode(c: Column) -> Column:
    """Named and numeric character entities to characters, each once; what is none stays.

    A no-break space becomes a plain one.
    """
    named, paged = _text_map(ENTITIES), _text_map({str(n): char for n, char in CODE_PAGE.items() if char})

    def numbered(code: Column) -> Column:
        # A code point as four bytes.
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        octets = F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(0xFFFD)), 8, "0"))
        found = F.coalesce(F.try_element_at(paged, code.cast("string")), F.decode(octets, "UTF-32"))
        return F.when(code.isNotNull(), found)

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*);$", 1)
        decimal = F.regexp_extract(piece, "^&#([0-9]{1,7});$", 1)
        hexadecimal = F.conv(F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]{1,6});$", 1), 16, 10)
        code = F.coalesce(decimal.try_cast("bigint"), hexadecimal.try_cast("bigint"))
        found = F.coalesce(F.try_element_at(named, name), let(code, numbered))
        return F.when(piece.startswith("&"), F.coalesce(found, piece)).otherwise(piece)

    def decode(v: Column) -> Column:
        # An entity is a piece of its own.
        pieces = F.split(v, r"(?=&[#A-Za-z])|(?<=;)")
        decoded = F.replace(F.array_join(F.transform(pieces, one), ""), F.lit("\u00a0"), F.lit(" "))
        return F.when(F.contains(v, F.lit("&")), decoded).otherwise(v)

    return let(c, decode)
