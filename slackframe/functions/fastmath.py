"""Approximate mathematics as column expressions, built from exponent and mantissa arithmetic.

Spark can't reinterpret the bits of a float, so the exponent comes from log2 and the mantissa from
a division by a power of two; the approximations are then the usual rational ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the approximations.
LOG2 = (124.22551499, 1.498030302, 1.72587999, 0.3520887068)
POW2 = (121.2740575, 27.7280233, 4.84252568, 1.49012907)
COARSE = 126.94269504
LN2 = 0.69314718
LOG2_E = 1.442695040
COARSE_LN = (8.2629582881927490e-8, 87.989971088)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def over(a: Column, b: Column) -> Column:
    """a / b of doubles where b may be 0: infinite there with the sign that floating point has, and NaN for 0 / 0."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def _split(x: Column) -> tuple[Column, Column]:
    """Biased position 127 + e + (m - 1) on the float number line, and m / 2, for x = m * 2^e."""
    e = F.floor(F.log2(x)).cast("double")
    m = x / F.pow(F.lit(2.0), e)
    return e + 127 + m - 1, m / 2


def fastlog2(x) -> Column:
    line, half = _split(_c(x))
    return line - LOG2[0] - LOG2[1] * half - LOG2[2] / (LOG2[3] + half)


def fastlog(x) -> Column:
    return LN2 * fastlog2(x)


def fasterlog2(x) -> Column:
    return _split(_c(x))[0] - COARSE


def fasterlog(x) -> Column:
    return _split(_c(x))[0] * (1 << 23) * COARSE_LN[0] - COARSE_LN[1]


def _from_line(line: Column) -> Column:
    """The number at a place on the float number line, cut to 23 bits of mantissa."""
    bits = ((1 << 23) * line).cast("long")
    return F.pow(F.lit(2.0), F.shiftright(bits, 23).cast("double") - 127) * (1 + bits.bitwiseAND(F.lit(0x7FFFFF)).cast("double") / (1 << 23))


def fastpow2(p) -> Column:
    p = _c(p)
    c = F.greatest(p, F.lit(-126.0))
    whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")
    z = c - whole + F.when(p < 0, 1.0).otherwise(0.0)
    return _from_line(c + POW2[0] + POW2[1] / (POW2[2] - z) - POW2[3] * z)


def fastexp(x) -> Column:
    return fastpow2(LOG2_E * _c(x))


def fasterpow2(p) -> Column:
    return _from_line(F.greatest(_c(p), F.lit(-126.0)) + COARSE)


def fasterexp(x) -> Column:
    return fasterpow2(LOG2_E * _c(x))


def fastpow(x, p) -> Column:
    return fastpow2(_c(p) * fastlog2(x))


def fasterpow(x, p) -> Column:
    return fasterpow2(_c(p) * fasterlog2(x))


def fastsigmoid(x) -> Column:
    return 1 / (1 + fastexp(-_c(x)))


def fastersigmoid(x) -> Column:
    return 1 / (1 + fasterexp(-_c(x)))


def fastsinh(x) -> Column:
    return 0.5 * (fastexp(x) - fastexp(-_c(x)))


def fastcosh(x) -> Column:
    return 0.5 * (fastexp(x) + fastexp(-_c(x)))


def fasttanh(x) -> Column:
    return -1 + 2 / (1 + fastexp(-2 * _c(x)))


def fastersinh(x) -> Column:
    return 0.5 * (fasterexp(x) - fasterexp(-_c(x)))


def fastercosh(x) -> Column:
    return 0.5 * (fasterexp(x) + fasterexp(-_c(x)))


def fastertanh(x) -> Column:
    return -1 + 2 / (1 + fasterexp(-2 * _c(x)))


def fastlgamma(x) -> Column:
    x = _c(x)
    return -2.081061466 - x + 0.0833333 / (3 + x) - fastlog(x * (1 + x) * (2 + x)) + (2.5 + x) * fastlog(3 + x)


def fasterlgamma(x) -> Column:
    x = _c(x)
    return -0.0810614667 - x - fasterlog(x) + (0.5 + x) * fasterlog(1 + x)


def fastdigamma(x) -> Column:
    x = _c(x)
    up = 2 + x
    return over(-48 - 157 * x - 127 * x * x - 30 * x * x * x, 12 * x * (1 + x) * up * up) + fastlog(up)


def fasterdigamma(x) -> Column:
    x = _c(x)
    up = 1 + x
    return over(F.lit(-1.0), x) - over(F.lit(1.0), 2 * up) + fasterlog(up)
