"""Dates, durations and waiting times as plain column expressions.

Waiting times are numbers of seconds; ``now`` is always a parameter so that a
plan gives the same answer whenever it runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let

ISO = "yyyy-MM-dd'T'HH:mm:ss"
# The spellings a complete date may have.
STRICT_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd", "M/d/yyyy")
NO_DATE = "0000-00-00"
# English month names, for dates inside prose.
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
# Seconds per duration unit.
UNIT_SECONDS = {"w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1}
# Fixed value: items due within this many seconds are acted on at once; others are scheduled
# so much ahead of their time.
LEAD_SECONDS = 300


def sentinel_to_null(c: Column, sentinel: str = NO_DATE) -> Column:
    return F.nullif(c, F.lit(sentinel))


def parse_date(c: Column, formats: Sequence[str] = STRICT_FORMATS) -> Column:
    """A complete date in one of ``formats``, else NULL (never filled up from today)."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def parse_date_iso(c: Column, formats: Sequence[str] = STRICT_FORMATS) -> Column:
    return F.date_format(parse_date(c, formats), ISO)


def extract_date_fuzzy(c: Column) -> Column:
    """The first complete date inside prose, ISO: ``11 July 1991``, ``July 11th, 1991``, ``11 JUL. 1991``."""
    month = "|".join(f"{name[:3]}(?:{name[3:]})?" if name != "September" else "Sep(?:t(?:ember)?)?" for name in MONTHS.split("|"))
    day, year = r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4})"
    either = rf"(?i)\b(?:{day}\s+({month})\.?,?\s+{year}|({month})\.?\s+{day},?\s+{year})\b"

    def read(found: Column) -> Column:
        name = F.lower(F.substring(F.regexp_extract(found, rf"(?i)\b({month})", 1), 1, 3))
        number = F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), name) + 2) / 3)
        shown = F.concat_ws(
            "-",
            F.regexp_extract(found, r"(\d{4})$", 1),
            number.cast("string"),
            F.regexp_extract(found, r"(?<!\d)(\d{1,2})(?!\d)", 1),
        )
        return F.date_format(F.try_to_timestamp(shown, F.lit("yyyy-M-d")), ISO)

    # A regexp that finds nothing gives '', which is no date.
    return let(F.regexp_extract(c, either, 0), lambda found: F.when(found != "", read(found)))


def range_start(c: Column) -> Column:
    """First day of ``November 5-8, 2012``, ISO; NULL for anything else."""
    month_day = F.regexp_extract(c, rf"^((?:{MONTHS}) \d{{1,2}})-\d{{1,2}}, \d{{4}}$", 1)
    year = F.regexp_extract(c, r"(\d{4})$", 1)
    return F.date_format(
        F.try_to_timestamp(F.concat(month_day, F.lit(", "), year), F.lit("MMMM d, yyyy")), ISO
    )


def duration_seconds(c: Column) -> Column:
    """``1w 2d 3h 4m 5s`` -> seconds; parts add up in any order, no text is 0 seconds."""
    none = F.lit(0).cast("bigint")

    def seconds(part: Column) -> Column:
        unit = F.right(part, F.lit(1))
        size = none
        for name, value in UNIT_SECONDS.items():
            size = F.when(unit == name, F.lit(value)).otherwise(size)
        return F.coalesce(F.rtrim(part, F.lit("wdhms")).try_cast("bigint"), none) * size

    return F.coalesce(F.aggregate(F.split(c, r"\s+"), none, lambda total, part: total + seconds(part)), none)


def remaining_seconds(wait_s: Column, scraped_at: Column, now: Column) -> Column:
    """What is left of ``wait_s`` at ``now`` when it was read at ``scraped_at``."""
    elapsed_us = F.unix_micros(now.cast("timestamp")) - F.unix_micros(scraped_at.cast("timestamp"))
    return wait_s.cast("double") - elapsed_us / F.lit(1e6)


def due_bucket(left_s: Column, lead: int = LEAD_SECONDS) -> Column:
    """``now`` when less than ``lead`` seconds are left, else ``wait``."""
    return F.when(left_s < lead, F.lit("now")).otherwise(F.lit("wait"))
