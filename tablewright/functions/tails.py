"""Tail probabilities of the chi-square, t and F distributions from the incomplete gamma and beta functions.

They are evaluated on the driver for one value per feature, never per row. Degrees of freedom go up to 1e15: leading
factors come from Stirling differences, so large terms never cancel, and arguments come with their complement. Where a series
would need too many terms an expansion in the large parameter takes over; a sum that does not settle is an error.
"""

from __future__ import annotations

import math

_EPS = 1e-16
_TINY = 1e-300
_MAX_TERMS = 300_000
_LARGE = 1e5  # above it the expansions are good to more digits than are shown
_HUGE = 1e9  # above it the series would need too many terms


def _lentz(b0: float, terms) -> float:
    """Continued fraction b0 + a1/(b1 + a2/(b2 + ...)) for an iterable of (a, b)."""
    f = b0 or _TINY
    c, d = f, 0.0
    for a, b in terms:
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        step = c * d
        f *= step
        if abs(step - 1.0) < 4 * _EPS:
            return f
    raise ArithmeticError("the continued fraction did not settle")


def _stirling(z: float) -> float:
    """log Gamma(z) less its leading terms (z - 1/2) log z - z + log(2 pi) / 2."""
    if z < 10:
        return math.lgamma(z) - ((z - 0.5) * math.log(z) - z + 0.5 * math.log(2 * math.pi))
    r = 1 / (z * z)
    return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z


def _log1p_less(d: float) -> float:
    """log(1 + d) - d."""
    if abs(d) > 0.1:
        return math.log1p(d) - d
    total, power = 0.0, d
    for k in range(2, 40):
        power *= -d
        total += power / k
        if abs(power) < _EPS * abs(total):
            break
    return total


def _normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(s, x)."""
    if x <= 0:
        return 1.0
    if s > _HUGE:  # Wilson and Hilferty: the cube root of x / s is normal up to terms of order 1 / s
        return _normal_sf(((x / s) ** (1 / 3) - (1 - 1 / (9 * s))) * 3 * math.sqrt(s))
    log_front = s * _log1p_less((x - s) / s) + 0.5 * math.log(s / (2 * math.pi)) - _stirling(s)
    if x < s + 1:
        term = total = 1.0 / s
        for k in range(1, _MAX_TERMS):
            term *= x / (s + k)
            total += term
            if term < total * _EPS:
                return max(0.0, 1.0 - total * math.exp(log_front))
        raise ArithmeticError("the series did not settle")
    fraction = _lentz(x + 1 - s, ((-k * (k - s), x + 2 * k + 1 - s) for k in range(1, _MAX_TERMS)))
    return math.exp(log_front) / fraction


def beta_lower(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function I_x(a, b); ``y`` is 1 - x where the caller knows it better."""
    y = 1.0 - x if y is None else y
    if x <= 0:
        return 0.0
    if y <= 0:
        return 1.0
    if min(a, b) > _LARGE and max(a, b) > _HUGE:  # Paulson: cube roots of the two gamma variables are normal
        u, v = (b * x) ** (1 / 3), (a * y) ** (1 / 3)
        return _normal_sf(-3 * (u * (1 - 1 / (9 * b)) - v * (1 - 1 / (9 * a))) / math.sqrt(u * u / b + v * v / a))
    middle = a + (b - 1) / 2
    if a > _LARGE and b**3 < 1e-4 * middle * middle:  # -log(x) times the large parameter is nearly a gamma variable
        return gamma_upper(b, -middle * (math.log1p(-y) if y < 0.5 else math.log(x)))
    if b > _LARGE and a**3 < 1e-4 * (b + (a - 1) / 2) ** 2:
        return 1.0 - beta_lower(b, a, y, x)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower(b, a, y, x)
    # x^a y^b / B(a, b), each power beside the matching power of its share of a + b
    n = a + b
    log_front = (
        a * (math.log(x) - math.log(a / n)) + b * (math.log(y) - math.log(b / n))
        + 0.5 * math.log(a * b / (2 * math.pi * n)) + _stirling(n) - _stirling(a) - _stirling(b)
    )

    def terms():
        for m in range(_MAX_TERMS):
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            k = m + 1
            yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), 1.0

    return math.exp(log_front) / (a * _lentz(1.0, terms()))


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    """Probability of a t value at least as far from zero."""
    whole = df + t * t
    return beta_lower(df / 2, 0.5, df / whole, t * t / whole)


def f_sf(f: float, df1: float, df2: float) -> float:
    if f <= 0:
        return 1.0
    whole = df2 + df1 * f
    return beta_lower(df2 / 2, df1 / 2, df2 / whole, df1 * f / whole)
