"""Special functions and losses as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients, g = 7, n = 9.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# Chebyshev fit of erfc, relative error below 1.2e-7.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, by Lanczos on x + 1."""
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        series = series + F.lit(c) / (x + (i + 1))
    t = x + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.log(t) - t + F.log(series) - F.log(x)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.5)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = F.lit(c) + t * poly
    y = t * F.exp(-z * z + poly)
    return F.when(x >= 0, y).otherwise(F.lit(2.0) - y)


def erfc_sql(x: str) -> str:
    """The same fit in SQL, for oracles."""
    t, poly = f"(1 / (1 + abs({x}) * 0.5))", str(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    y = f"{t} * exp(-{x} * {x} + {poly})"
    return f"(CASE WHEN {x} >= 0 THEN {y} ELSE 2 - {y} END)"


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution."""
    return erfc(z / math.sqrt(2)) * 0.5


def nb_nll(y: Column, mu: Column, theta: Column, scale: float = 1.0, eps: float = 1e-10) -> Column:
    """Negative log likelihood of a negative binomial count."""
    mu, theta = mu * scale, F.least(theta, F.lit(1e6))
    gammas = lgamma(theta + eps) + lgamma(y + 1.0) - lgamma(y + theta + eps)
    return gammas + (theta + y) * F.log(F.lit(1.0) + mu / (theta + eps)) + y * (F.log(theta + eps) - F.log(mu + eps))


def zinb_nll(y: Column, mu: Column, theta: Column, pi: Column, scale: float = 1.0, eps: float = 1e-10, ridge: float = 0.0) -> Column:
    """Negative log likelihood of a zero-inflated negative binomial count, plus ridge * pi^2."""
    mu, theta, pi = mu * scale, F.least(theta, F.lit(1e6)), F.least(F.greatest(pi, F.lit(eps)), F.lit(1 - eps))
    zero = -F.log(pi + (F.lit(1.0) - pi) * F.pow(theta / (theta + mu + eps), theta) + eps)
    return F.when(y < eps, zero).otherwise(nb_nll(y, mu, theta, 1.0, eps)) + F.lit(ridge) * pi * pi


def squared_error(y: Column, pred: Column, scale: float = 1.0) -> Column:
    return F.pow(pred * scale - y, F.lit(2.0))


def log_cosh(y: Column, pred: Column) -> Column:
    """ln cosh of the difference, in the form that doesn't overflow."""
    d = F.abs(pred - y)
    return d + F.log1p(F.exp(d * -2.0)) - math.log(2)
