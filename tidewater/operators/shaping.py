"""Column shaping: names, casts, recodes, corrections and fills."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.operators.joins import left_join

# Fixed value: characters dropped from column headers.
HEADER_NOISE = r"[?\s._()]"
# Fixed value: the survey headers lose a closing bracket only before a slash.
SURVEY_HEADER_NOISE = r"\?|\s+|\.+|_+|\(|\)/"
# Fixed value: first calendar year behind a year index counted from 1.
YEAR_INDEX_BASE = 1994
# Rows of a grouping with nearly as many groups as rows that one task holds, about.
TASK_ROWS = 500_000


def deal_out(df: DataFrame, keys: Sequence[str], rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """The same rows dealt out by ``keys``, about ``task_rows`` of the ``rows`` (an estimate) to a task.

    For groupings, windows and joins by these keys that hold nearly every row in memory: tasks filled up to a size in
    bytes, as adaptive execution does, would hold several million rows of few columns.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows))
    return df.repartition(tasks, *keys)


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns collide after renaming: {twice}")
    return df.toDF(*names)


def normalize_names(df: DataFrame, noise: str = HEADER_NOISE) -> DataFrame:
    """Lower-case the headers and drop blanks, dots, underscores, brackets and question marks."""
    return _renamed(df, [re.sub(noise, "", c.lower()) for c in df.columns])


def rename_regex(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rename columns by regular expression, rules applied in turn."""
    names = list(df.columns)
    for pattern, new in rules.items():
        names = [re.sub(pattern, new, n) for n in names]
    return _renamed(df, names)


def cast_all(df: DataFrame, cols: Iterable[str], kind: str) -> DataFrame:
    """Cast columns; text that does not parse becomes NULL. Numbers cast to ``int`` truncate."""
    def convert(c: str) -> Column:
        if kind in ("int", "bigint") and dict(df.dtypes)[c] == "string":
            return F.col(c).try_cast("double").try_cast(kind)
        return F.col(c).try_cast(kind)

    return df.withColumns({c: convert(c) for c in cols})


def failed_casts(df: DataFrame, casts: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Per text column, how many values are present but would not parse."""
    bad = [F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), 1)).alias(c) for c, t in casts.items()]
    return df.groupBy(*keys).agg(*bad)


def map_columns(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one Column function to several columns."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def recode(value: Column, rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """First matching rule wins; the rest take ``otherwise`` or keep ``value``."""
    out = None
    for cond, new in rules:
        out = F.when(cond, new) if out is None else out.when(cond, new)
    return out.otherwise(value if otherwise is None else otherwise)


def apply_corrections(df: DataFrame, rules: Sequence[tuple[Column, Mapping[str, Column]]]) -> DataFrame:
    """Repair known bad records: each rule is a condition and new values for some columns."""
    for cond, changes in rules:
        df = df.withColumns({c: F.when(cond, new).otherwise(F.col(c)) for c, new in changes.items()})
    return df


def repair_year(year: Column, also: Column | None = None, base: int = YEAR_INDEX_BASE) -> Column:
    """Turn a year index into a calendar year: when below 1000, or where ``also`` says so."""
    return F.when((year < 1000) if also is None else also, year + base).otherwise(year)


def with_rank(df: DataFrame, col: str, levels: Sequence[object], rank: str = "rank") -> DataFrame:
    """Give ordered categories a rank from 1; values outside the levels get NULL."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col))
    return df.withColumn(rank, F.nullif(place, F.lit(0)).cast("int"))


def zero_fill(df: DataFrame, cols: Iterable[str], default: object = 0) -> DataFrame:
    """Replace NULL by a default, or by another column when ``default`` is a Column."""
    fill = default if isinstance(default, Column) else F.lit(default)
    return df.withColumns({c: F.coalesce(F.col(c), fill.cast(dict(df.dtypes)[c])) for c in cols})


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def convert_length(df: DataFrame, factors: DataFrame, default: float = 1.2, total_areas: Sequence[str] = ("27", "34"),
                   fork_areas: Sequence[str] = ("87",), jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """Turn standard lengths into total or fork lengths by species and area, rounded down.

    ``factors`` holds ``species, sltottl, sltofl``. A species without a total-length
    factor takes ``default``. ``jitter`` is the relative spread of a random factor;
    it is off by default so that results repeat.
    """
    df = left_join(df, factors, ["species"])
    noise = F.lit(1.0) + jitter * F.randn(seed) if jitter else F.lit(1.0)
    is_sl = F.col("lengthtype") == "SL"
    to_total = is_sl & F.col("area").isin(*total_areas)
    to_fork = is_sl & F.col("area").isin(*fork_areas)
    length = (
        F.when(to_total, F.col("length") * F.coalesce(F.col("sltottl"), F.lit(default)) * noise)
        .when(to_fork, F.col("length") * F.col("sltofl") * noise)
        .otherwise(F.col("length"))
    )
    kind = F.when(to_total, "TTL").when(to_fork, "FL").otherwise(F.col("lengthtype"))
    return df.withColumns({"length": F.floor(length), "lengthtype": kind}).drop("sltottl", "sltofl")
