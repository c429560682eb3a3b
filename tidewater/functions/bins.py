"""Binning of numbers into labelled classes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Class edges used by the CPUE and catch tables.
DEPTH_BREAKS = (0, 200, 300, 400, 500, 600, 700, 2500)
SET_HOUR_BREAKS = (0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24)
DECADE_BREAKS = tuple(10**k for k in range(13))
# A step of mult x power of ten is taken once the raw step exceeds limit x that power.
PRETTY_LIMITS = ((2, 1.4), (5, 2.8), (10, 7.0))
PENTAD_FIRST, PENTAD_LAST, PENTAD_WIDTH = 1980, 2040, 5


def edge_labels(breaks: Sequence[float], digits: int = 3) -> list[str]:
    """Text of the edges with the fewest significant digits that keep them apart."""
    for d in range(digits, max(12, digits) + 1):
        text = [f"{float(b):.{d}g}" for b in breaks]
        if len(set(text)) == len(text):
            break
    return text


def left_labels(breaks: Sequence[float], digits: int = 3) -> list[str]:
    t = edge_labels(breaks, digits)
    return [f"[{a},{b})" for a, b in zip(t, t[1:])]


def right_labels(breaks: Sequence[float], include_lowest: bool = False, digits: int = 3) -> list[str]:
    t = edge_labels(breaks, digits)
    labels = [f"({a},{b}]" for a, b in zip(t, t[1:])]
    if include_lowest:
        labels[0] = "[" + labels[0][1:]
    return labels


def _chain(conditions: list[Column], values: list[str]) -> Column:
    out = F.when(conditions[0], values[0])
    for c, v in zip(conditions[1:], values[1:]):
        out = out.when(c, v)
    return out


def bin_left(x: Column, breaks: Sequence[float], digits: int = 3) -> Column:
    """Classes ``[a,b)``; values outside the edges give NULL."""
    conds = [(x >= float(a)) & (x < float(b)) for a, b in zip(breaks, breaks[1:])]
    return _chain(conds, left_labels(breaks, digits))


def bin_right(x: Column, breaks: Sequence[float], include_lowest: bool = False, digits: int = 3) -> Column:
    """Classes ``(a,b]``; with ``include_lowest`` the first class is ``[a,b]``."""
    conds = [(x > float(a)) & (x <= float(b)) for a, b in zip(breaks, breaks[1:])]
    if include_lowest:
        conds[0] = (x >= float(breaks[0])) & (x <= float(breaks[1]))
    return _chain(conds, right_labels(breaks, include_lowest, digits))


def bin_log10(x: Column) -> Column:
    """Decade class of the whole-number part: ``(1,10]``, ``(10,100]`` ...; 1 and less give NULL."""
    return bin_right(x.cast("long"), DECADE_BREAKS, digits=10)


def pentad(year: Column) -> Column:
    """Five-year class ``(1980,1985]`` ... ``(2035,2040]`` of a year."""
    low = F.floor((year - 1 - PENTAD_FIRST) / PENTAD_WIDTH) * PENTAD_WIDTH + PENTAD_FIRST
    label = F.concat(F.lit("("), low.cast("string"), F.lit(","), (low + PENTAD_WIDTH).cast("string"), F.lit("]"))
    return F.when((year > PENTAD_FIRST) & (year <= PENTAD_LAST), label)


def pretty(lo: float, hi: float, n: int) -> list[float]:
    """About ``n`` round-numbered steps covering ``lo`` to ``hi``: steps of 1, 2 or 5 times a power of ten."""
    if hi <= lo:
        return [lo, lo + 1.0]
    raw = (hi - lo) / n
    base = 10.0 ** math.floor(math.log10(raw))
    unit = base
    for mult, limit in PRETTY_LIMITS:
        if raw > limit * base:
            unit = mult * base
    first, last = math.floor(lo / unit + 1e-7), math.ceil(hi / unit - 1e-7)
    return [round(k * unit, 12) for k in range(first, last + 1)]


def log_breaks(lo: float, hi: float, n: int) -> list[float]:
    """Break points for a log scale: about ``n``, and ``n - 2`` at least within the range where that can be.

    Powers of ten, every so many decades that there are about ``n``, or more closely if
    too few lie within the range. If all of them are too few, multiples 2 to 9 are added
    one by one, always the one that leaves the widest smallest gap on the log scale
    (3 comes first), and the list is cut to the range with one break beyond each end.
    """
    def within(points: list[float]) -> int:
        return sum(lo * (1 - 1e-12) <= p <= hi * (1 + 1e-12) for p in points)

    first, last = math.floor(math.log10(lo)), math.ceil(math.log10(hi))
    if first == last:
        return [10.0**first]
    for step in range((last - first) // n + 1, 0, -1):
        powers = [10.0**k for k in range(first, last + 1, step)]
        if within(powers) >= n - 2:
            return powers
    used, left = [1], list(range(2, 10))
    points = powers
    while left and within(points) < n - 2:
        def smallest_gap(m: int) -> float:
            marks = sorted([*used, m, 10])
            return round(min(math.log10(b / a) for a, b in zip(marks, marks[1:])), 9)

        best = max(left, key=lambda m: (smallest_gap(m), -m))
        used.append(best)
        left.remove(best)
        points = sorted(m * 10.0**k for k in range(first, last + 1) for m in used)
    if within(points) < n - 2:
        return pretty(lo, hi, n)
    start = max(next(i for i, p in enumerate(points) if p >= lo * (1 - 1e-12)) - 1, 0)
    stop = max(i for i, p in enumerate(points) if p <= hi * (1 + 1e-12)) + 2
    return points[start:stop]


def auto_breaks(df: DataFrame, col: str, n: int, kind: str = "log", floor: float | None = None) -> list[float]:
    """Break points from one min/max aggregate of the data.

    ``floor`` replaces the minimum (a log scale usually starts at 1). The top edge
    is raised to cover the maximum, so no value is left out.
    """
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if hi is None:
        return [0.0, 1.0]
    if floor is not None:
        lo = floor
    return log_breaks(lo, max(hi, lo), n) if kind == "log" else pretty(lo, hi, n)


def bin_auto(df: DataFrame, col: str, n: int, kind: str = "log", out: str | None = None,
             floor: float | None = None) -> DataFrame:
    """Right-closed classes on break points taken from the data; values below the first edge give NULL."""
    breaks = auto_breaks(df, col, n, kind, floor)
    if len(breaks) < 2:
        breaks = breaks + [breaks[0] * 10.0]
    return df.withColumn(out or f"{col}_cat", bin_right(F.col(col), breaks, include_lowest=True, digits=10))


def geo_bin(lon: Column, lat: Column, dx: float = 1.0, dy: float = 0.5) -> tuple[Column, Column]:
    """Mid-points of the grid cell that holds a position."""
    return (F.floor(lon / dx) + 0.5) * dx, (F.floor(lat / dy) + 0.5) * dy


def cell_key(lon_mid: Column, lat_mid: Column) -> Column:
    """``lon:lat`` text key of a grid cell."""
    return F.concat_ws(":", lon_mid.cast("string"), lat_mid.cast("string"))
