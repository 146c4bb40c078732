"""Money as whole cents (BIGINT).

Sums of long values stay in primitive codegen and are exact in any order; a sum of
DECIMAL(15,2) needs 25 digits and falls back to objects. Amounts turn into doubles
only in the last projection of a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rate of the tax contained in an inclusive carrier amount.
TAX_RATE = 18
TAX_BASE = 118


def cents(number: Column) -> Column:
    """A numeric amount in currency units, rounded half up to cents."""
    return F.floor(number.cast("double") * 100 + 0.5)


def cents_from_text(text: Column) -> Column:
    """Statement text such as ``INR 4,891.30`` in cents; unreadable or blank text is 0.

    Only digits, dots and minus signs count, and of those only the leading number:
    ``(45.00)`` is a positive 45. An amount too large for BIGINT is null.
    """
    zero = F.lit(0).cast("bigint")
    kept = F.regexp_replace(text, r"[^0-9.\-]+", "")
    number = F.regexp_extract(kept, r"^-?(?:\d+\.?\d*|\.\d+)", 0)
    # bound once, so that the patterns do not run for the test and again for the value
    found = F.get(F.transform(F.array(number), _number_cents), F.lit(0))
    return F.when(F.coalesce(text, F.lit("")) == "", zero).otherwise(F.coalesce(_usual_cents(text), found))


def _usual_cents(text: Column) -> Column:
    """The cents of a text that is one number beside a usual currency sign and separators; no pattern runs for it. Null for others.

    A cast takes digits of other scripts and exponents, too, which do not count here.
    """
    number = text
    for sign in ("INR ", "₹", ","):
        number = F.replace(number, F.lit(sign), F.lit(""))
    plain = (F.octet_length(number) == F.length(number)) & ~F.contains(F.lower(number), F.lit("e"))
    return F.when(plain, (number.try_cast("decimal(36,2)") * 100).try_cast("bigint"))


def _number_cents(number: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.when(number == "", zero).otherwise((number.try_cast("decimal(36,2)") * 100).try_cast("bigint"))


def currency(amount_cents: Column) -> Column:
    return amount_cents / F.lit(100)


def in_currency(df: DataFrame, *columns: str) -> DataFrame:
    """Replace cent columns by doubles in currency units."""
    return df.withColumns({c: currency(F.col(c)) for c in columns})


def money_text(amount_cents: Column) -> Column:
    """Cents as text with two decimals."""
    return (amount_cents.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def round_half_up(value: Column, places: int) -> Column:
    """Rounding where ties go up, also below zero."""
    scale = 10**places
    return F.floor(value * scale + 0.5) / F.lit(float(scale))


def round_half_away(value: Column, places: int) -> Column:
    """Rounding where ties go away from zero."""
    scale = 10**places
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / F.lit(float(scale))


def tax_component(amount_cents: Column) -> Column:
    """Cents of tax inside a tax-inclusive amount; a tie cannot occur with this rate."""
    return F.floor(amount_cents * TAX_RATE / TAX_BASE + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``, 0 unless ``whole`` is positive."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
