"""Lines that recur across documents, found with a log-template tree; DataFrame operations only.

A line is parsed into tokens at white space; tokens that hold a digit are variable
fields.  The tree has a fixed depth: below the root the number of tokens, below that
the first ``LEADING`` tokens (variable fields as ``<*>``).  The path is the line's
leaf.  Two sorts of templates live in a leaf:

* the masked lines themselves: lines that differ in variable fields only;
* common templates, which generalise other variable fields: at each
  place the token that most lines of a group have.  A line of the group belongs to it
  if it agrees at ``SIMILARITY`` or more of its places behind the leading ones; the places where it does not are
  the template's variable fields.

The groups are the leaf itself and, for the leaf's several templates, the lines that agree
in a class of places.  If ``m`` places may differ, the places behind the leading ones are dealt
into ``m + 1`` classes in turn.  Fields at ``m`` places leave one class or more without a
field, in which all lines of a template agree; and templates that differ in a run of more than
``m`` places differ in every class.  So such templates are found beside each other,
however many share the leaf and whatever else stands in it.  Of lines with more than ``CLASSES``
classes (80 places or more) the first ``CLASSES`` are taken, each with places all along the line.

A template recurs if lines of ``MIN_DOCS`` documents or more belong to it, or of ``LONG_DOCS``
if it has ``LONG_WORDS`` tokens or more besides variable fields: a passage of that length is not
in two documents by chance.  A line that
belongs to a recurring template is dropped, except in the document with the
smallest key among them: what is said once must not get lost with its copies.

Counts and majorities are aggregates that combine before the shuffle, so a line
that stands in a third of all documents costs no more than others.  What is shuffled is narrow (hashes and
places) except for the lines of leaves shared by several documents, whose tokens are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import require, staged, text_or_empty
from pagemill.operators.rows import each

LEADING = 3
MIN_DOCS = 3
LONG_DOCS = 2
LONG_WORDS = 50
SIMILARITY = 0.8
CLASSES = 16
FIELD = "<*>"


# The gaps between tokens besides single spaces.
GAPS = ("  ", "\t", "\r", "\x0b", "\x0c")


def masked(line: Column) -> Column:
    """The line's tokens separated by single spaces, those with a digit as ``<*>``."""
    odd = line.startswith(" ") | line.endswith(" ")
    for gap in GAPS:
        odd = odd | F.contains(line, F.lit(gap))
    # Most lines have neither, and looking is much cheaper than replacing.
    clean = F.when(odd, F.btrim(F.regexp_replace(line, r"[ \t\r\x0b\x0c]+", " "), F.lit(" "))).otherwise(line)
    fields = F.regexp_replace(clean, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)
    return F.when(line.rlike("[0-9]"), fields).otherwise(clean)


def _row(text: str) -> Column:
    return F.xxhash64(text_or_empty(text))


def parsed_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, row, pos, m`` for every line with a token: its place in the text and its masked form.

    ``row`` tells texts under one key apart; what it cannot tell apart is the same text.
    """
    texts = docs.select(F.col(key).alias("key"), _row(text).alias("row"), text_or_empty(text).alias("text"))
    # Masked before they become rows, so that nothing after computes it again.
    return each(texts, ["key", "row"], F.transform(F.split("text", "\n"), masked), "m").where("m <> ''")


def _tokens(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf(line: Column, leading: int) -> Column:
    """Hash of the path through the tree: token count and leading tokens."""
    return F.xxhash64(_tokens(line), F.substring_index(line, " ", leading))


def _need(words: Column, min_docs: int | None) -> Column:
    """Documents a template with so many tokens besides variable fields has to recur in."""
    by_length = F.when(words >= LONG_WORDS, LONG_DOCS).otherwise(MIN_DOCS)
    return by_length if min_docs is None else F.lit(min_docs)


def _recurring(members: DataFrame, by: list[str]) -> DataFrame:
    """``by, first``: templates with members from ``need`` keys or more, and the smallest of these."""
    per_doc = members.select(*by, "need", "key").distinct()
    counted = per_doc.groupBy(*by, "need").agg(F.count(F.lit(1)).alias("docs"), F.min("key").alias("first"))
    return counted.where(F.col("docs") >= F.col("need")).select(*by, "first")


def repeated_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_docs: int | None = None,
    leading: int = LEADING,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``key, row, pos`` of every line to drop, each once.

    ``min_docs`` holds for lines of any length; without it their length decides.
    """
    lines = parsed_lines(docs, key, text)
    # Fields are three characters long.
    fields = ((F.char_length("m") - F.char_length(F.replace("m", F.lit(FIELD), F.lit("")))) / len(FIELD)).cast("int")
    need = _need(_tokens(F.col("m")) - fields, min_docs).alias("need")
    places = staged(
        lines.select("key", "row", "pos", leaf(F.col("m"), leading).alias("leaf"), F.xxhash64("m").alias("line"), need),
        "lines",
    )
    exact = staged(_recurring(places, ["leaf", "line"]), "recurring")
    by_line = _members(places, exact, ["leaf", "line"])
    # Leaves with lines of several documents that are not all the same line: one row per different line.
    kinds = places.groupBy("leaf", "line").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    shared = kinds.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    # Lines of so many documents are at least so many lines.
    enough = (F.col("kinds") > 1) & (F.col("n") >= (min_docs or LONG_DOCS)) & (F.col("low") < F.col("high"))
    shared = staged(shared.where(enough).select("leaf"), "leaves")
    # Each different line of these leaves once, with how often it occurs, if it can differ from a template at all.
    tokens = (
        lines.where(_may_differ(_tokens(F.col("m")), leading, similarity) > 0)
        .withColumn("leaf", leaf(F.col("m"), leading))
        .join(shared.hint("merge"), "leaf")
        .groupBy("leaf", "m")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("leaf", F.xxhash64("m").alias("line"), "n", F.split("m", " ").alias("tokens"))
    )
    tokens = staged(tokens, "tokens")
    grouped = staged(_groups(tokens, leading, similarity), "groups")
    grouped = grouped.join(tokens.select("leaf", "line", "n", "tokens"), ["leaf", "line"])
    votes = grouped.select("leaf", "group", "n", F.posexplode("tokens").alias("at", "token"))
    votes = votes.groupBy("leaf", "group", "at", "token").agg(F.sum("n").alias("n"))
    # Most frequent first, ties to the token that sorts first.
    top = votes.groupBy("leaf", "group", "at").agg(F.min(F.struct(-F.col("n"), F.col("token"))).alias("top"))
    common = top.groupBy("leaf", "group").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("top.token")))), lambda x: x["token"]).alias("common")
    )
    common = staged(common, "templates")
    agree = F.aggregate(
        F.zip_with("tokens", "common", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x
    )
    # The leading tokens agree by construction; the places behind them decide.
    differ = F.size("tokens") - agree
    alike = grouped.join(common, ["leaf", "group"]).where(differ <= _may_differ(F.size("tokens"), leading, similarity))
    # Groups with the same common line are one template.
    words = F.size(F.filter("common", lambda x: x != FIELD))
    alike = alike.select("leaf", "line", F.xxhash64("common").alias("template"), _need(words, min_docs).alias("need"))
    alike = staged(alike.distinct(), "alike")
    members = places.drop("need").join(alike, ["leaf", "line"])
    members = staged(members.select("leaf", "template", "need", "key", "row", "pos"), "members")
    by = ["leaf", "template"]
    by_leaf = _members(members, staged(_recurring(members, by), "recurring"), by)
    return by_line.unionByName(by_leaf).distinct()


def _may_differ(size: Column, leading: int, similarity: float) -> Column:
    """At how many places a line of ``size`` tokens may differ from its template."""
    behind = F.greatest(size - leading, F.lit(0))
    return (behind - F.ceil(behind * F.lit(similarity))).cast("int")


def _groups(tokens: DataFrame, leading: int, similarity: float) -> DataFrame:
    """``leaf, group, line``: the leaves, and the lines of a leaf that agree in a class of places.

    A group has two different lines or more; of groups with the same lines there is one.
    """
    step = _may_differ(F.size("tokens"), leading, similarity) + 1
    classes = F.transform(
        F.sequence(F.lit(0), F.least(step, F.lit(CLASSES)) - 1),
        lambda c: F.xxhash64(
            c,
            F.transform(F.sequence(c + leading, F.size("tokens") - 1, step), lambda at: F.get("tokens", at)),
        ),
    )
    groups = F.concat(F.array(F.lit(0).cast("bigint")), classes)
    dealt = staged(tokens.select("leaf", "line", F.explode(groups).alias("group")), "classes")
    kinds = dealt.groupBy("leaf", "group").agg(F.count(F.lit(1)).alias("kinds"), F.bit_xor("line").alias("all"))
    kinds = kinds.where("kinds > 1").groupBy("leaf", "kinds", "all").agg(F.min("group").alias("group"))
    return dealt.join(kinds.select("leaf", "group"), ["leaf", "group"])


def _members(lines: DataFrame, templates: DataFrame, by: list[str]) -> DataFrame:
    """Lines of recurring templates outside the document that keeps them."""
    return lines.join(templates, by).where(~F.col("key").eqNullSafe(F.col("first"))).select("key", "row", "pos")


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, row, drop``: the places of the lines to drop, ascending, for every text under a key that has any."""
    found = repeated_lines(docs, key, text, **options)
    return found.groupBy("key", "row").agg(F.sort_array(F.collect_list("pos")).alias("drop"))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``__lines, __dropped``: lines before, lines taken out.

    All rows and columns stay.  Null texts stay null, texts without repeated lines stay
    as they are, blank lines are never dropped.  Null keys count as one document that
    keeps no template, as rows with the same key count as one; each row loses lines of
    its own text only.  Ties between tokens go to the one that sorts first.  An empty table gives an empty result.
    """
    require(docs, key, text)
    drops = staged(dropped_lines(docs, key, text, **options), "drops")
    drops = drops.select(F.col("key").alias("__key"), F.col("row").alias("__row"), F.col("drop").alias("__drop"))
    # Shared leaves and drops grow with the documents, so neither is ever broadcast.
    own = docs[key].eqNullSafe(drops["__key"]) & (_row(text) == drops["__row"])
    joined = docs.join(drops.hint("merge"), own, "left")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("__drop", i))
    new = F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[new.alias(c) if c == text else docs[c] for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).alias("__lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).alias("__dropped"),
    )
