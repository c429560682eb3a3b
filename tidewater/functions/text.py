"""Text building and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number_text(x: Column) -> Column:
    """Plain text of a number: whole values without a decimal point."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def add_units(x: Column) -> Column:
    """Axis labels: ``950``, ``3k``, ``12M``, ``4B``, ``7T``, and ``too big!`` beyond."""
    def scaled(div: float, unit: str) -> Column:
        return F.concat(F.bround(x / div).cast("long").cast("string"), F.lit(unit))

    return (
        F.when(x < 1e3, number_text(x))
        .when(x < 1e6, scaled(1e3, "k"))
        .when(x < 1e9, scaled(1e6, "M"))
        .when(x < 1e12, scaled(1e9, "B"))
        .when(x < 1e15, scaled(1e12, "T"))
        .otherwise("too big!")
    )


def fmt_interval(median: Column, low: Column, high: Column) -> Column:
    """``median (low-high)``."""
    return F.concat(number_text(median), F.lit(" ("), number_text(low), F.lit("-"), number_text(high), F.lit(")"))


def fmt_percent(x: Column, digits: int = 0) -> Column:
    """Share as percent text."""
    return F.concat(F.format_string(f"%.{digits}f", F.bround(x * 100, digits)), F.lit("%"))


def signif_text(x: Column) -> Column:
    """Text with three significant digits, without trailing zeros; whole numbers from 1000 up."""
    trimmed = F.regexp_replace(F.format_string("%.3g", x), r"\.?0+(e|$)", "$1")
    small = F.when(F.format_string("%.3g", x).contains("."), trimmed).otherwise(F.format_string("%.3g", x))
    return F.when(F.abs(x) >= 1000, F.format_string("%.0f", x)).when(x == 0, "0").otherwise(small)


def paste(*cols: Column, sep: str = " ") -> Column:
    """Join texts; a missing part is written as ``NA`` (``concat_ws`` alone would skip it)."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def strip_spaces(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", "")


def pad_age(age: Column) -> Column:
    """Two-digit age text, empty for a biomass index."""
    return F.when(age.isNull(), "").otherwise(F.lpad(age.cast("string"), 2, "0"))


def last_chars(x: Column, n: int) -> Column:
    return F.substring(x, -n, n)
