"""Gamma-family functions as Column expressions over a column name.

Spark has none of them. Each one shifts its argument up by the recurrence and then
sums the asymptotic series, which at ``x + 8`` is exact to about 1e-13. They are
written as SQL text because the expressions are long; pass the name of a column, so
that the argument is worked out once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SHIFT = 8


def _series(x: str, coefs: tuple[str, ...]) -> str:
    """Alternating Horner sum in 1 / z^2 with z = x + SHIFT."""
    r = f"(1D / (({x} + {SHIFT}D) * ({x} + {SHIFT}D)))"
    out = coefs[-1]
    for c in reversed(coefs[:-1]):
        out = f"({c} - {r} * {out})"
    return out


def _shifted(x: str, term: str, join: str) -> str:
    return "(" + join.join(term.format(x=f"({x} + {k}D)") for k in range(SHIFT)) + ")"


def lgamma(x: str) -> Column:
    """log of the gamma function, x > 0."""
    z = f"({x} + {SHIFT}D)"
    series = _series(x, ("(1D/12D)", "(1D/360D)", "(1D/1260D)", "(1D/1680D)", "(1D/1188D)"))
    half_log_2pi = 0.5 * math.log(2 * math.pi)
    return F.expr(f"({z} - 0.5D) * ln({z}) - {z} + {half_log_2pi!r}D + {series} / {z} - ln({_shifted(x, '{x}', ' * ')})")


def digamma(x: str) -> Column:
    """Derivative of :func:`lgamma`, x > 0."""
    z = f"({x} + {SHIFT}D)"
    series = _series(x, ("(1D/12D)", "(1D/120D)", "(1D/252D)", "(1D/240D)", "(1D/132D)"))
    return F.expr(f"ln({z}) - 0.5D / {z} - {series} / ({z} * {z}) - {_shifted(x, '1D / {x}', ' + ')}")


def trigamma(x: str) -> Column:
    """Derivative of :func:`digamma`, x > 0."""
    z = f"({x} + {SHIFT}D)"
    series = _series(x, ("(1D/6D)", "(1D/30D)", "(1D/42D)", "(1D/30D)", "(5D/66D)"))
    return F.expr(f"1D / {z} + 0.5D / ({z} * {z}) + {series} / ({z} * {z} * {z}) + {_shifted(x, '1D / ({x} * {x})', ' + ')}")
