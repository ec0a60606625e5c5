"""The normal distribution as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's rational approximation of the normal quantile.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425
# Abramowitz and Stegun 7.1.26, erf to 1.5e-7.
E_P = 0.3275911
E = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _poly(coefs, x, one: float | None = None):
    out = 0.0
    for c in coefs:
        out = out * x + c
    return out * x + one if one is not None else out


def ppf(p: float) -> float:
    """Normal quantile of a number in (0, 1)."""
    if not 0.0 < p < 1.0:
        raise ValueError(f"quantile of {p}")
    if p > 1 - TAIL:
        return -ppf(1 - p)
    if p < TAIL:
        q = math.sqrt(-2 * math.log(p))
        return _poly(C, q) / _poly(D, q, 1.0)
    q = p - 0.5
    r = q * q
    return _poly(A, r) * q / _poly(B, r, 1.0)


def ppf_column(p: Column) -> Column:
    """Normal quantile; raises outside (0, 1)."""

    def tail(x: Column) -> Column:
        q = F.sqrt(F.lit(-2.0) * F.log(x))
        return _poly(C, q) / _poly(D, q, 1.0)

    q = p - 0.5
    r = q * q
    middle = _poly(A, r) * q / _poly(B, r, 1.0)
    bad = F.raise_error(F.concat(F.lit("quantile of "), p.cast("string"))).cast("double")
    return F.when((p <= 0) | (p >= 1), bad).when(p < TAIL, tail(p)).when(p > 1 - TAIL, -tail(1 - p)).otherwise(middle)


def pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def cdf(z: Column) -> Column:
    """Normal distribution function, to about 1e-7, without leaving the JVM."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + E_P * x)
    erf = 1.0 - _poly(E[::-1], t) * t * F.exp(-x * x)
    return F.when(z < 0, (1.0 - erf) / 2).otherwise((1.0 + erf) / 2)


def cdf_exact(z: Column) -> Column:
    """The same by the error function, in Arrow batches."""
    @F.pandas_udf("double")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))

    return f(z)


def cdf_sql(z: str) -> str:
    """``cdf`` as SQL over an expression."""
    x, t = f"(abs({z}) / sqrt(2.0::DOUBLE))", f"(1.0::DOUBLE / (1.0::DOUBLE + {E_P}::DOUBLE * (abs({z}) / sqrt(2.0::DOUBLE))))"
    poly = "0.0::DOUBLE"
    for c in E[::-1]:
        poly = f"({poly} * {t} + ({c})::DOUBLE)"
    erf = f"(1.0::DOUBLE - {poly} * {t} * exp(-{x} * {x}))"
    return f"CASE WHEN {z} < 0 THEN (1.0::DOUBLE - {erf}) / 2 ELSE (1.0::DOUBLE + {erf}) / 2 END"


def ppf_sql(p: str) -> str:
    def poly(coefs, x, one=None):
        out = "0.0::DOUBLE"
        for c in coefs:
            out = f"({out} * {x} + ({c})::DOUBLE)"
        return f"({out} * {x} + {one}::DOUBLE)" if one is not None else out

    def tail(x):
        q = f"sqrt(-2.0::DOUBLE * ln({x}))"
        return f"{poly(C, q)} / {poly(D, q, '1.0')}"

    r = f"(({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    return f"CASE WHEN {p} < {TAIL} THEN {tail(p)} WHEN {p} > {1 - TAIL} THEN -({tail(f'(1.0::DOUBLE - {p})')}) ELSE {poly(A, r)} * ({p} - 0.5::DOUBLE) / {poly(B, r, '1.0')} END"
