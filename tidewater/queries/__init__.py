"""Registry of the queries the driver runs, each with its SQL twin where one can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None) -> Callable[[Query], Query]:
    """Register a query.

    ``digits`` rounds columns the same way on both sides, since sums of doubles differ
    in their last bits with the order of the rows.
    """
    digits = digits or {}

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(f"`{c}`"), d) for c, d in digits.items()}) if digits else df

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f'round("{c}", {d}) AS "{c}"' for c, d in digits.items())
            ORACLES[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if digits else sql
        return fn

    return register


def load_all() -> None:
    """Import every query module, which fills the registry."""
    from tidewater.queries import (  # noqa: F401
        catches, columns, cpue, forecasts, joins, lengths, models, runs, shapes, texts,
    )
