"""Tail probabilities that Spark has no function for, as column expressions: continued fractions and series of a fixed number of steps."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: steps of a series or continued fraction; enough for full precision where each of them is used
STEPS = 160
_TINY = 1e-300
#: coefficients of Stirling's series for the logarithm of the gamma function, 1 / (12 x), -1 / (360 x^3) ..
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def _lit(x: float) -> Column:
    return F.lit(float(x))


def log_gamma(x: Column) -> Column:
    """For x > 0: Stirling's series at x + 8, taken back by the product of the eight steps."""
    z = x + 8
    series = sum((c / F.pow(z, _lit(2 * k + 1)) for k, c in enumerate(_STIRLING)), _lit(0.0))
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * log(2 * pi) + series - F.log(product)


def _steps() -> Column:
    return F.sequence(F.lit(1), F.lit(STEPS))


def _away(x: Column) -> Column:
    return F.when(F.abs(x) > _TINY, x).otherwise(_TINY)


def _lentz(start: Column, first_d: Column, term, denominator) -> Column:
    """A continued fraction forwards: ``term`` and ``denominator`` give the k-th numerator and denominator."""
    def step(state, k):
        d = 1.0 / _away(denominator(k) + term(k) * state["d"])
        c = _away(denominator(k) + term(k) / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["f"] * c * d).alias("f"))

    begin = F.struct(start.alias("c"), first_d.alias("d"), first_d.alias("f"))
    return F.aggregate(_steps(), begin, step, lambda s: s["f"])


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    first = 1.0 / _away(1.0 - (a + b) * x / (a + 1.0))

    def term(k):
        m = F.floor((k + 1) / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        n = F.floor(k / 2).cast("double")
        odd = -(a + n) * (a + b + n) * x / ((a + 2 * n) * (a + 2 * n + 1))
        return F.when(k % 2 == 1, even).otherwise(odd)

    return _lentz(_lit(1.0), first, term, lambda k: _lit(1.0))


def beta_ratio(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b)."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    near = x < (a + 1.0) / (a + b + 2.0)
    p, q, z = F.when(near, a).otherwise(b), F.when(near, b).otherwise(a), F.when(near, x).otherwise(1.0 - x)
    value = front * _beta_fraction(p, q, z) / p
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(near, value).otherwise(1.0 - value))


def gamma_ratio(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma Q(a, x): by the series up to a + 1, by the continued fraction beyond."""
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    series = F.aggregate(_steps(), F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s")), lambda s, k: F.struct(
        (s["t"] * x / (a + k)).alias("t"), (s["s"] + s["t"] * x / (a + k)).alias("s")), lambda s: s["s"])
    first = 1.0 / _away(x + 1.0 - a)
    fraction = _lentz(_lit(1 / _TINY), first, lambda k: -k * (k - a), lambda k: x + 1.0 - a + 2 * k)
    return F.when(x <= 0, 1.0).when(x < a + 1, 1.0 - front * series).otherwise(front * fraction)


def chi_square_tail(stat: Column, freedom: Column) -> Column:
    """Upper tail of a chi-square statistic."""
    return gamma_ratio(freedom.cast("double") / 2, stat.cast("double") / 2)


def normal_tail(z: Column) -> Column:
    """Two-sided normal tail: that of z squared with one degree of freedom."""
    return chi_square_tail(z * z, F.lit(1))


def student_tail(t: Column, freedom: Column) -> Column:
    """Two-sided Student t tail."""
    nu = freedom.cast("double")
    return beta_ratio(nu / 2, _lit(0.5), nu / (nu + t * t))


def p_value(stat: Column | str, nu: Column | None = None) -> Column:
    """Two-sided p-value of a statistic: Student t with ``nu`` degrees of freedom, normal where ``nu`` is NULL."""
    s = (F.col(stat) if isinstance(stat, str) else stat).cast("double")
    found = normal_tail(s) if nu is None else F.when(nu.isNull(), normal_tail(s)).otherwise(student_tail(s, nu))
    return F.when(s.isNotNull() & ~F.isnan(s), found)


# --- the same for one number, on the driver --------------------------------------------------------------------

def normal_p(x: float) -> float:
    """Two-sided normal tail."""
    return erfc(abs(x) / sqrt(2.0))


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1.0 - x) / b


def student_p(t: float, nu: float) -> float:
    """Two-sided Student t tail."""
    return incomplete_beta(nu / 2.0, 0.5, nu / (nu + t * t))
