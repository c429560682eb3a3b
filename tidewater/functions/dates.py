"""Dates as the haul and catch tables use them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: day zero of spreadsheet serial dates.
SERIAL_EPOCH = "1899-12-30"


def excel_date(serial: Column) -> Column:
    """Spreadsheet serial day number -> date; fractions of a day are dropped."""
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), serial.cast("int"))


def hhmm_timestamp(date: Column, hhmm: Column) -> Column:
    """Date plus an ``HHMM`` number -> zone-free timestamp; impossible times give NULL."""
    n = hhmm.cast("int")
    return F.try_make_timestamp_ntz(
        F.year(date), F.month(date), F.dayofmonth(date),
        F.floor(n / 100).cast("int"), F.pmod(n, F.lit(100)), F.lit(0),
    )


def week_of_year(date: Column) -> Column:
    """Seven-day blocks counted from 1 January (1-53); not the ISO week."""
    return (F.floor((F.dayofyear(date) - 1) / 7) + 1).cast("int")


def quarter_label(date: Column) -> Column:
    """``q1`` ... ``q4``; NULL for a missing date."""
    return F.concat(F.lit("q"), F.quarter(date).cast("string"))
