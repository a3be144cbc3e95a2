"""HTML tables as grids: cells that span rows or columns fill every place they cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.fold import fold_emit
from pagemill.functions.text import let, ws_collapse
from pagemill.operators.rows import each

# Fixed values of the HTML standard: no cell spans more; a row span of 0 reaches to the end of the table.
MOST_COLUMNS = 1000
MOST_ROWS = 65_534

_SLOTS = "array<struct<text:string,left:int>>"
_CELL = r"(?is)<t[dh]\b[^>]*>.*?</t[dh]\s*>"


def _span(cell: Column, name: str, most: int, zero: int) -> Column:
    """The number an attribute begins with, 1 without one."""

    def number(value: Column) -> Column:
        digits = F.substring(F.regexp_extract(value, r"^\s*\+?0*(\d*)", 1), 1, 9)
        counted = let(
            F.coalesce(digits.try_cast("int"), F.lit(0)), lambda n: F.when(n == 0, zero).otherwise(F.least(n, F.lit(most)))
        )
        return F.when(value.rlike(r"^\s*\+?\d"), counted).otherwise(1)

    # Most cells do not name the attribute at all: a look at the text spares going from attribute to attribute.
    return F.when(cell.rlike(f"(?i){name}"), F.coalesce(let(H.attr(cell, name), number), F.lit(1))).otherwise(1)


def _cell_texts(cells: Column) -> Column:
    """Clean texts of the cells of all rows (``array<array<string>>``)."""
    # A cell begins and ends with a tag, so neither tags nor white space reach from one to the next.  Marks between cells and
    # rows let one pass clean the whole table; a table with entities, or with these marks in it, goes cell by cell.
    together = F.split(
        ws_collapse(
            F.regexp_replace(F.array_join(F.transform(cells, lambda row: F.array_join(row, "\x01")), "\x02"), H.TAG, "")
        ),
        " ?\x02 ?",
    )
    return F.when(
        F.array_join(F.flatten(cells), "").rlike("[&\x01\x02]"), F.transform(cells, lambda row: F.transform(row, H.clean_text))
    ).otherwise(F.transform(together, lambda row: F.split(row, " ?\x01 ?")))


def _read(row: Column, cells: Column, texts: Column) -> Column:
    """``struct<cells, spread, body>`` of a table row; ``spread`` has a cell as often as it spans columns."""

    def cell(c: Column, text: Column) -> Column:
        return F.struct(
            text.alias("text"),
            _span(c, "rowspan", MOST_ROWS, MOST_ROWS).cast("int").alias("rows"),
            _span(c, "colspan", MOST_COLUMNS, 1).cast("int").alias("cols"),
        )

    plain = F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit(1).alias("rows"), F.lit(1).alias("cols")))
    return let(
        # A row that names no span is made of its texts.
        F.when(row.rlike("(?i)(?:row|col)span"), F.zip_with(cells, texts, cell)).otherwise(plain),
        lambda known: F.struct(
            known.alias("cells"),
            F.when(row.rlike("(?i)colspan"), F.flatten(F.transform(known, lambda c: F.array_repeat(_slot(c), c["cols"]))))
            .otherwise(F.transform(known, _slot)).alias("spread"),
            row.rlike(r"(?i)<td[\s>]").alias("body"),
        ),
    )


def _slot(cell: Column) -> Column:
    return F.struct(cell["text"].alias("text"), cell["rows"].alias("left"))


def _place(slots: Column, cell: Column, at: Column) -> Column:
    """The slots with the cell in its columns from ``at``; what reaches down from above stays."""

    def slot(i: Column) -> Column:
        return let(
            F.coalesce(F.get(slots, i), F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).alias("left"))),
            lambda old: F.when((i >= at) & (i < at + cell["cols"]) & (old["left"] == 0), _slot(cell)).otherwise(old),
        )

    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(slots), at + cell["cols"]) - 1), slot)


def _filled(above: Column, cells: Column) -> Column:
    """A row's slots, cell by cell: each from the first column free."""

    def put(state: Column, cell: Column) -> Column:
        slots = state["slots"]
        free = F.filter(
            F.sequence(state["at"], F.greatest(state["at"], F.size(slots))),
            lambda i: F.coalesce(F.get(slots, i)["left"], F.lit(0)) == 0,
        )
        return let(
            F.get(free, F.lit(0)),
            lambda at: F.struct(_place(slots, cell, at).alias("slots"), (at + cell["cols"]).alias("at")),
        )

    return F.aggregate(cells, F.struct(above.cast(_SLOTS).alias("slots"), F.lit(0).alias("at")), put, lambda s: s["slots"])


def _dealt(above: Column, cells: Column) -> Column:
    """A row's slots where no cell spans columns: one cell for each free column in order."""

    def among(free: Column) -> Column:
        def slot(i: Column) -> Column:
            return let(F.array_position(free, i), lambda n: F.when(n > 0, _slot(F.get(cells, n.cast("int") - 1))).otherwise(F.get(above, i)))

        width = F.greatest(F.size(above), F.element_at(free, -1) + 1)
        return F.transform(F.sequence(F.lit(0), width - 1), slot)

    places = F.sequence(F.lit(0), F.size(above) + F.size(cells) - 1)
    return let(F.slice(F.filter(places, lambda i: F.coalesce(F.get(above, i)["left"], F.lit(0)) == 0), 1, F.size(cells)), among)


def _row(above: Column, row: Column) -> Column:
    """A row's slots, then what they leave open for the next row."""
    cells, spread = row["cells"], row["spread"]
    held = F.array_position(F.transform(above, lambda s: s["left"] > 0), F.lit(True)).cast("int")
    # Usually nothing is held where the cells go side by side; else usually no cell spans columns.
    filled = let(
        held,
        lambda h: F.when((h == 0) | (h > F.size(spread)), F.concat(spread, F.slice(above, F.size(spread) + 1, F.size(above))))
        .when(F.size(spread) == F.size(cells), _dealt(above, cells))
        .otherwise(_filled(above, cells)),
    )

    def done(slots: Column) -> Column:
        rest = F.transform(
            slots,
            lambda s: F.struct(
                F.when(s["left"] > 1, s["text"]).alias("text"), F.greatest(s["left"] - 1, F.lit(0)).alias("left")
            ),
        )
        texts = F.transform(slots, lambda s: F.when(s["left"] > 0, s["text"]))
        return F.struct(
            rest.alias("state"), F.array(F.struct(row["body"].alias("body"), texts.alias("texts"))).alias("out")
        )

    return let(filled, done)


def with_grid(pages: DataFrame, keep: Sequence[str], html: str = "html") -> DataFrame:
    """``keep, grid``: the first table of each page as ``array<struct<body, texts>>``, a struct for each row.

    ``body`` tells rows with a ``td`` from rows of headers only.  A cell takes the first free column of its row and those
    after it that it spans; a column held by a cell from a row above stays with that cell.  Every place a cell covers has
    its text, a place no cell covers is NULL.  Tables within a cell are not told apart.  NULL without a table.
    """
    found = F.transform(
        H.elements(H.first_element(H.strip_noise(F.col(html)), "table"), "tr"),
        lambda r: F.struct(r.alias("row"), F.regexp_extract_all(r, F.lit(_CELL), F.lit(0)).alias("cells")),
    )
    # Bound by `let`: a column used once would be put inside the lambda, and be computed again for each row.
    rows = let(
        found,
        lambda f: let(
            _cell_texts(f["cells"]),
            lambda texts: F.transform(f, lambda r, i: _read(r["row"], r["cells"], F.slice(F.get(texts, i), 1, F.size(r["cells"])))),
        ),
    )
    folded = fold_emit(F.col("__rows"), F.array().cast(_SLOTS), "struct<body:boolean,texts:array<string>>", _row)
    return pages.select(*keep, rows.alias("__rows")).select(*keep, folded["out"].alias("grid"))


def grid_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, row, col, text``: every covered place of the first table, rows and columns from 0."""
    rows = each(with_grid(pages, [key], html), [key], "grid", "__r", "row")
    cells = each(rows, [key, "row"], F.col("__r.texts"), "text", "col")
    return cells.where(F.col("text").isNotNull())


def grid_table_rows(pages: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), html: str = "html") -> DataFrame:
    """Body rows of the first table, one column per wanted header of its first row of headers.

    A header over several columns stands for the first of them, a cell over several rows is in each.
    """
    grid = with_grid(pages, keep, html)
    head = F.get(F.filter("grid", lambda r: ~r["body"] & (F.size(r["texts"]) > 0)), F.lit(0))["texts"]
    places = grid.select(
        *keep, F.filter("grid", lambda r: r["body"]).alias("__body"),
        F.transform(F.array(*map(F.lit, columns)), lambda c: F.nullif(F.array_position(head, c), F.lit(0)).cast("int") - 1).alias("__at"),
    )
    rows = each(places, [*keep, "__at"], "__body", "__row")
    return rows.select(*keep, *[F.get(F.col("__row.texts"), F.col("__at")[i]).alias(c) for i, c in enumerate(columns)])
