"""Column expressions over HTML text.

There is no tree: a page is a list of tokens (tags and text runs) in document
order.  All of it stays inside the row, so none of these needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import entity_decode, let, non_empty, ws_collapse

NOISE = r"(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)"
TOKEN = r"<[^>]*>|[^<]+"
TAG = r"<[^>]*>"


def strip_noise(html: Column) -> Column:
    """Drop scripts, styles and comments, which may hide tags."""
    return F.regexp_replace(html, NOISE, "")


def tokens(html: Column) -> Column:
    """Tags and text runs in document order."""
    return F.regexp_extract_all(strip_noise(html), F.lit(TOKEN), F.lit(0))


def tag_name(tok: Column) -> Column:
    """Lower-case element name of an opening or closing tag, NULL for text."""
    return F.nullif(F.lower(F.regexp_extract(tok, r"^</?([A-Za-z][A-Za-z0-9]*)", 1)), F.lit(""))


def token_kind(tok: Column) -> Column:
    """``open``, ``close``, ``text`` or ``other`` (doctype and the like)."""
    return (
        F.when(~tok.startswith("<"), F.lit("text"))
        .when(tok.startswith("</"), F.lit("close"))
        .when(tok.rlike(r"^<[A-Za-z]"), F.lit("open"))
        .otherwise(F.lit("other"))
    )


def attr(tok: Column, name: str) -> Column:
    """Value of an attribute of the first tag in ``tok``; NULL when absent or empty.

    Goes from attribute to attribute, so that a value never passes for one.
    """
    # Possessive throughout: all attributes of other names are skipped at once, without a way back, so that the time
    # is in proportion to the tag and the depth does not grow with its attributes.
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    wanted = rf"{name}\s*+="
    other = rf"""(?:[\s/]*+(?!{wanted}\s*+{value})[^\s=>"'/]++(?:\s*+=\s*+{value})?+)*+"""
    raw = F.regexp_extract(tok, rf"""(?i)^<[a-z][^\s>/]*+{other}[\s/]*+(?<=[\s"'/]){wanted}\s*+({value})""", 1)
    return non_empty(F.regexp_replace(raw, r"""^["']|["']$""", ""))


def has_class(tok: Column, cls: str) -> Column:
    """Whether the class attribute of the tag lists ``cls``."""
    return F.coalesce(F.array_contains(F.split(attr(tok, "class"), r"\s+"), cls), F.lit(False))


def class_mention(cls: str) -> str:
    """The pattern of a mention of class ``cls``, in any case of letters."""
    return rf"""\bclass\s*=\s*["']?(?:[^"'>]*\s)?{cls}(?:["'\s>])"""


def mentions_class(fragment: Column, cls: str) -> Column:
    """Whether any tag in the fragment has class ``cls``."""
    return fragment.rlike(f"(?i){class_mention(cls)}")


def classes_in(fragment: Column) -> Column:
    """All classes of all tags in the fragment as one text, `` a b c ``, to look names up in."""
    return F.concat(F.lit(" "), F.array_join(class_list(fragment), " "), F.lit(" "))


def class_list(fragment: Column) -> Column:
    """The classes of every tag in the fragment; a class that several tags have comes several times."""
    values = F.regexp_extract_all(fragment, F.lit(r"""(?i)\bclass\s*=\s*("[^">]*|'[^'>]*|[^\s"'>]+)"""), F.lit(1))

    def listed(names: Column) -> Column:
        # Most tags have one class: no pattern to split at is compiled for them.
        return F.when(names.rlike(r"\s"), F.array_distinct(F.split(names, r"\s+"))).otherwise(F.array(names))

    return F.flatten(F.transform(values, lambda v: let(F.regexp_replace(v, r"""^["']""", ""), listed)))


def text_of(cleaned: Column, tag: str) -> Column:
    """Clean text of the first element of this name, NULL when there is none or it is empty."""
    return non_empty(clean_text(first_element(cleaned, tag)))


def inner_text(fragment: Column) -> Column:
    """Text of a fragment: tags removed, entities decoded."""
    return entity_decode(F.regexp_replace(fragment, TAG, ""))


def clean_text(fragment: Column) -> Column:
    return ws_collapse(inner_text(fragment))


def elements(html: Column, name: str) -> Column:
    """Every ``<name>…</name>`` with its tags.  For elements that do not nest."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>"), F.lit(0))


def first_element(html: Column, name: str) -> Column:
    return non_empty(F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", 0))


def element_with(html: Column, name: str, attribute: str, value: str) -> Column:
    """First ``<name>`` whose ``attribute`` contains ``value`` as a word, up to its own end tag.

    Elements of the same name may nest inside.  The end tag itself is left out;
    an element that is never closed reaches to the end of the page.
    """
    opening = rf"""<{name}\b[^>]*\b{attribute}\s*=\s*["'](?:[^"'>]*\s)?{value}(?:\s[^"'>]*)?["'][^>]*>"""
    rest = F.regexp_extract(html, rf"(?is)({opening}.*)\z", 1)
    # Every piece but the first text starts with an opening or a closing tag.
    pieces = F.split(rest, rf"(?i)(?=</?{name}[\s/>])")

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.startswith("</"), F.lit(-1)).otherwise(F.lit(1))
        seen = state["seen"] + 1
        end = F.when((state["end"] == 0) & (depth == 0), seen).otherwise(state["end"])
        return F.struct(depth.alias("depth"), seen.alias("seen"), end.alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def up_to_end(parts: Column) -> Column:
        return let(
            F.aggregate(parts, start, step, lambda state: state["end"]),
            lambda end: F.array_join(F.when(end > 0, F.slice(parts, 1, end - 1)).otherwise(parts), ""),
        )

    # Usually nothing of the same name nests inside, and the first end tag is the right one.
    plain = F.regexp_extract(html, rf"(?is)({opening}.*?)</{name}[\s>]", 1)
    nested = rf"(?is)^<.+<{name}[\s/>]"
    return non_empty(
        let(plain, lambda e: F.when((e != "") & ~e.rlike(nested), e).otherwise(let(pieces, up_to_end)))
    )


def blocks_of(html: Column) -> Column:
    """Fragments that start with a ``div`` or a table, in order, each up to the first end tag of one.

    What stands between an end tag and the next block belongs to none.
    """
    start, end = r"(?:div|table)[\s>]", r"/(?:div|table)\s*>"
    return pieces_of(strip_noise(html), rf"(?i)<{start}", f"{start}|{end}")


def paragraphs(html: Column) -> Column:
    """Fragments that start with ``<p>``; an unclosed one ends where the next begins."""
    return pieces_of(html, r"(?i)<p[\s>]", r"p[\s>]|/p\s*>")


def pieces_of(html: Column, begin: str, ends: str) -> Column:
    """Pieces that start with ``begin``, each up to the next ``<`` with one of ``ends`` behind it.

    One pattern, which Spark keeps; ``split`` would compile its own again for every text.
    """
    # Possessive: a loop without a way back, in proportion to the text.
    return F.regexp_extract_all(html, F.lit(rf"{begin}(?:[^<]++|<(?!{ends}))*+"), F.lit(0))
