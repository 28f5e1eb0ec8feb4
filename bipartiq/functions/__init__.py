"""Column functions that results analysis needs and Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of Abramowitz and Stegun's approximation 7.1.26 of erf, good to 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """1 - erf(x) for x >= 0."""
    t = 1 / (1 + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x)


def erfc_sql(x: str) -> str:
    """The same in SQL."""
    t, poly = f"(1 / (1 + {ERF_P} * ({x})))", "0.0::DOUBLE"
    for a in reversed(ERF_A):
        poly = f"(({poly}) + ({a})::DOUBLE) * {t}"
    return f"({poly}) * exp(-({x}) * ({x}))"


def falling(n: Column, r: int) -> Column:
    """n (n-1) ... (n-r+1) as a double; 0 where n < r."""
    product = F.lit(1.0)
    for i in range(r):
        product = product * F.greatest(n - i, F.lit(0)).cast("double")
    return product


def geometric_mean(col: Column) -> Column:
    """exp of the mean logarithm; 0 if any value is 0 or less."""
    return F.when(F.min(col) <= 0, 0.0).otherwise(F.exp(F.avg(F.when(col > 0, F.ln(col)))))


def finite_time(col: Column) -> Column:
    """A time, or null where it is NaN, infinite or negative."""
    return F.when(~F.isnan(col) & (col >= 0) & (col < float("inf")), col)
