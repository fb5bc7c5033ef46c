"""Numeric expressions: squeeze/logit, normal distribution, hash-seeded uniforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Abramowitz & Stegun 7.1.26: rational approximation of erf, |error| < 1.5e-7.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
Z_975 = 1.959964  # 97.5 % point of the standard normal
# Terms of the asymptotic series of digamma and trigamma, by rising even powers.
DIGAMMA_TERMS = [1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760]
TRIGAMMA_TERMS = [1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730]
GAMMA_SHIFT = 10        # the series are used from here on; below, the recurrence leads up to it
LOG_LOSS_EPS = 2.220446049250313e-16  # machine epsilon of a double
# Rational approximations of the normal quantile, relative error below 1.2e-9: numerator and
# denominator for the middle and for the tails beyond QUANTILE_TAIL, by falling powers.
QUANTILE_TAIL = 0.02425
QUANTILE_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
QUANTILE_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
QUANTILE_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
QUANTILE_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
# ----------------------------------------------------------------------------


def squeeze_logit(y: Column, n: Column) -> Column:
    """Logit of a score in [0, 1] after pulling exact 0 and 1 inside by half a row in n."""
    inner = (y * (n - 1) + 0.5) / n
    return F.log(inner / (1 - inner))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    a = F.abs(x) / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * a)
    poly = F.lit(0.0)
    for coefficient in reversed(ERF_A):
        poly = (poly + coefficient) * t
    erf = 1.0 - poly * F.exp(-a * a)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    value = F.lit(0.0)
    for c in coefficients:
        value = value * x + c
    return value


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function for 0 < p < 1; null elsewhere."""
    q, near = p - 0.5, F.least(p, 1 - p)
    middle = q * _polynomial(q * q, QUANTILE_A) / _polynomial(q * q, QUANTILE_B)
    t = F.sqrt(-2.0 * F.log(near))
    tail = F.signum(-q) * _polynomial(t, QUANTILE_C) / _polynomial(t, QUANTILE_D)
    return F.when((p > 0) & (p < 1), F.when(near < QUANTILE_TAIL, tail).otherwise(middle))


def hash_uniform(*parts, word: int = 0) -> Column:
    """Uniform in (0, 1) from one 32-bit word of the md5 of the joined parts: the same on every
    engine and on every retry."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 8 * word + 1, 8)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(2**32)


def hash_normal(*parts) -> Column:
    """Standard normal fixed by the parts (Box-Muller on two words of one hash)."""
    u1, u2 = hash_uniform(*parts, word=0), hash_uniform(*parts, word=1)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def digamma(x: Column) -> Column:
    """Logarithmic derivative of the gamma function for x > 0."""
    z = x + GAMMA_SHIFT
    series = sum((F.lit(t) / F.pow(z, F.lit(2 * k + 2)) for k, t in enumerate(DIGAMMA_TERMS)), F.lit(0.0))
    return F.log(z) - 0.5 / z - series - sum((1 / (x + k) for k in range(GAMMA_SHIFT)), F.lit(0.0))


def trigamma(x: Column) -> Column:
    """Derivative of digamma for x > 0."""
    z = x + GAMMA_SHIFT
    series = sum((F.lit(t) / F.pow(z, F.lit(2 * k + 3)) for k, t in enumerate(TRIGAMMA_TERMS)), F.lit(0.0))
    return 1 / z + 0.5 / (z * z) + series + sum((1 / ((x + k) * (x + k)) for k in range(GAMMA_SHIFT)), F.lit(0.0))
