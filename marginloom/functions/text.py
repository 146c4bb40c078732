"""Text cleaning: dates, order and listing numbers, waybills, quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A shape with a month's whole name asks for that name, as a parse that fails costs an exception.
MONTH = "(?i:january|february|march|april|may|june|july|august|september|october|november|december)"

# Accepted date shapes, each with its Spark pattern, in priority order.
DATE_SHAPES = [
    (r"^\d{2}-[A-Za-z]{3}-\d{2}$", "dd-MMM-yy"),
    (rf"^{MONTH} \d{{1,2}}, \d{{4}}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}", None),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (rf"^\d{{1,2}} {MONTH} \d{{4}}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (rf"^{MONTH} \d{{1,2}} \d{{4}}$", "MMMM d yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
]

# What a text must hold to have the shape at the same place: looked for before the pattern runs, as most texts fail it.
DATE_MARKS = [
    lambda text: F.length(text) == 9,
    lambda text: F.contains(text, F.lit(", ")),
    lambda text: F.substring(text, 4, 1) == " ",
    lambda text: F.substring(text, 5, 1) == "-",
    lambda text: F.contains(text, F.lit("/")),
    lambda text: F.substring(text, 5, 1) == "/",
    lambda text: F.contains(text, F.lit(" ")),
    lambda text: F.contains(text, F.lit(" ")),
    lambda text: ~F.contains(text, F.lit(",")),
    lambda text: F.substring(text, 4, 1) == " ",
    lambda text: F.contains(text, F.lit("-")),
    lambda text: F.contains(text, F.lit("-")),
]

# A weekday in front and a time behind a date say nothing about the day.
WEEKDAY = r"^[A-Za-z]{3,9}, +(?=[A-Za-z0-9])"
TIME = r"[ T]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[AaPp][Mm])?(?: ?(?:Z|UTC|GMT))?$"

# Two-digit years above this one belong to the 1900s.
LAST_SHORT_YEAR = 68


def blank_to_null(text: Column) -> Column:
    """Trimmed text; blanks become null."""
    return F.nullif(F.trim(text), F.lit(""))


def _parsed(trimmed: Column) -> Column:
    """The date by the first shape that fits; a text is held against the shapes that begin as it does, with a letter or a digit."""
    named, numbered = [], []
    for (shape, pattern), mark in zip(DATE_SHAPES, DATE_MARKS, strict=True):
        date = F.try_to_date(trimmed, pattern) if pattern else F.try_to_date(trimmed)
        if pattern and pattern.endswith("-yy"):
            date = F.when(F.year(date) > 2000 + LAST_SHORT_YEAR, F.add_months(date, -1200)).otherwise(date)
        begins = named if shape.startswith(("^[A-Za-z]", f"^{MONTH}")) else numbered
        begins.append(F.when(mark(trimmed) & trimmed.rlike(shape), date))
    return F.when(trimmed >= "A", F.coalesce(*named)).otherwise(F.coalesce(*numbered))


def _parts(trimmed: Column) -> Column:
    """The text without weekday and time, which only texts with a comma or a colon can hold."""
    dated = F.when(F.contains(trimmed, F.lit(",")), F.regexp_replace(trimmed, WEEKDAY, "")).otherwise(trimmed)
    return F.when(F.contains(trimmed, F.lit(":")), F.regexp_replace(dated, TIME, "")).otherwise(dated)


def clean_date(text: Column) -> Column:
    """The date in ``text``, or null. A shape test guards each parse, so a miss costs no exception.

    The text is bound once for all shapes; written out, it would be repeated for every shape
    and the generated code would outgrow the compiler's limits.
    """
    trimmed = F.trim(text)
    bound = F.transform(F.transform(F.array(trimmed), _parts), _parsed)
    return F.when(trimmed != "", F.get(bound, F.lit(0)))


def order_no_in(text: Column) -> Column:
    """An order number of 8 to 12 digits: after the word "order", or after "#" in text that names no listing."""
    # the words are looked for before the patterns run
    named = F.when(F.contains(F.lower(text), F.lit("order")), F.nullif(F.regexp_extract(text, r"(?i)\border[\s ]*#?[\s ]*(\d{8,12})", 1), F.lit("")))
    hashed = F.when(F.contains(text, F.lit("#")), F.nullif(F.regexp_extract(text, r"#(\d{8,12})", 1), F.lit("")))
    return F.coalesce(named, F.when(~F.contains(F.lower(text), F.lit("listing")), hashed))


def listing_id_in(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("isting")), F.nullif(F.regexp_extract(text, r"[Ll]isting\s*#?(\d+)", 1), F.lit("")))


def clean_waybill(text: Column) -> Column:
    """A waybill number as digits: no ".0" tail, no spreadsheet scientific notation."""
    trimmed = F.trim(text)
    scientific = F.contains(F.lower(trimmed), F.lit("e")) & trimmed.rlike(r"(?i)^\d+(\.\d+)?E\+?\d+$")
    digits = trimmed.try_cast("double").try_cast("decimal(38,0)").cast("string")
    ended = F.when(F.contains(trimmed, F.lit(".0")), F.regexp_replace(trimmed, r"\.0$", "")).otherwise(trimmed)
    return F.when(scientific, F.coalesce(digits, trimmed)).otherwise(ended)


def order_of_item(item_id: Column) -> Column:
    """``4104705089-2`` is item 2 of order ``4104705089``."""
    return F.trim(F.substring_index(item_id, "-", 1))


def leading_number(text: Column) -> Column:
    """The number at the start of ``text`` in ten-thousandths (BIGINT), or null."""
    number = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return (F.nullif(number, F.lit("")).try_cast("decimal(30,4)") * 10000).try_cast("bigint")
