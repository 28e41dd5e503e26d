"""Normal-theory helpers: inverse error function and confidence half-widths."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def erf_inv(x: float) -> float:
    """The y with erf(y) = x; infinite at -1 and 1, NaN outside."""
    if not -1 <= x <= 1:
        return math.nan
    if abs(x) == 1:
        return math.copysign(math.inf, x)
    y = NormalDist().inv_cdf((1 + x) / 2) / math.sqrt(2)
    # one Newton step against erf takes the last digits
    return y - (math.erf(y) - x) / (2 / math.sqrt(math.pi) * math.exp(-y * y))


#: Coefficients of the standard single-precision approximation of the inverse error function, in
#: powers of w - 2.5 for w = -ln((1-x)(1+x)) < 5 and of sqrt(w) - 3 beyond, highest power first.
_CENTRE = (2.81022636e-08, 3.43273939e-07, -3.5233877e-06, -4.39150654e-06, 0.00021858087, -0.00125372503, -0.00417768164, 0.246640727, 1.50140941)
_TAIL = (-0.000200214257, 0.000100950558, 0.00134934322, -0.00367342844, 0.00573950773, -0.0076224613, 0.00943887047, 1.00167406, 2.83297682)


def erf_column(x: Column) -> Column:
    """erf by its series below 3 and the continued fraction of erfc beyond; about 1e-12."""
    a = F.abs(x)
    # exp(-a^2) times the sum of 2^k a^(2k+1) / (1 * 3 * .. * (2k+1)), in Horner form
    square = a * a
    series = F.lit(1.0)
    for k in range(60, 0, -1):
        series = F.lit(1.0) + series * square * F.lit(2.0 / (2 * k + 1))
    near = F.exp(-square) * a * series * F.lit(2 / math.sqrt(math.pi))
    tail = F.lit(0.0)
    for k in range(40, 0, -1):
        tail = F.lit(k / 2) / (a + tail)
    far = F.lit(1.0) - F.exp(-square) / (F.lit(math.sqrt(math.pi)) * (a + tail))
    return F.signum(x) * F.when(a < 3, near).otherwise(far)


def erf_inv_column(x: Column) -> Column:
    """The inverse error function of a column: a polynomial in the logarithm, to about 1e-7."""
    poly = lambda t, cs: reduce(lambda acc, c: acc * t + F.lit(c), cs[1:], F.lit(cs[0]))
    w = -F.log((F.lit(1.0) - x) * (F.lit(1.0) + x))
    y = x * F.when(w < 5, poly(w - 2.5, _CENTRE)).otherwise(poly(F.sqrt(w) - 3.0, _TAIL))
    return F.when(F.abs(x) == 1, F.signum(x) * F.lit(math.inf)).when(F.abs(x) > 1, F.lit(math.nan)).otherwise(y)


def clt_half_width(accepted: Column, total: Column, squares: Column, draws: Column, confidence: float) -> Column:
    """Half-width of the mean of ``draws`` values of which ``accepted`` are not zero.

    ``total`` is the sum of the accepted values and ``squares`` their sum of
    squared deviations from their own mean. Null for one draw or none.
    """
    n, all_ = accepted.cast("double"), draws.cast("double")
    between = F.when(n > 0, n * (all_ - n) / all_ * F.pow(total / n, F.lit(2))).otherwise(F.lit(0.0))
    spread = F.when(n == 0, F.lit(0.0)).when(all_ > n, squares + between).otherwise(squares)
    return F.when(all_ > 1, F.lit(erf_inv(confidence)) * F.sqrt(2 * spread / (all_ * (all_ - 1))))


def half_width(variance: Column, confidence: float) -> Column:
    """Half-width of an estimate with this variance."""
    return F.lit(erf_inv(confidence) * math.sqrt(2)) * F.sqrt(variance)
