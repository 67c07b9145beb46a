"""Special functions, draws and vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series in odd powers of 1 / x, and its constant; from SHIFT on they give double precision.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360_360, 1 / 156)
HALF_LN_TWO_PI = 0.9189385332046727
SHIFT = 10
# Fixed value.
CUTOFF = 1e-15


def ln_gamma(x: Column) -> Column:
    """ln |gamma(x)| in double precision: infinite at 0 and at negative whole numbers, by reflection between those."""
    y = F.when(x < 0, 1 - x).otherwise(x)
    z = F.when(y < SHIFT, y + SHIFT).otherwise(y)
    series, passed = F.lit(STIRLING[-1]), y
    for a in STIRLING[-2::-1]:
        series = series / (z * z) + a
    for k in range(1, SHIFT):
        passed = passed * (y + k)
    g = (z - 0.5) * (F.ln(z) - 1) + (HALF_LN_TWO_PI - 0.5 + series / z) - F.when(y < SHIFT, F.ln(passed)).otherwise(0.0)
    reflected = F.ln(F.pi() / F.abs(F.sin(F.pi() * (x % 2)))) - g
    return F.when((x <= 0) & (x % 1 == 0), F.lit(float("inf"))).when(x < 0, reflected).otherwise(g)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def axpy(scale, x: Column, y: Column) -> Column:
    """y + scale * x."""
    return F.zip_with(x, y, lambda u, v: v + scale * u)


def relative_probabilities(logs: Column) -> Column:
    """Log-probabilities, centred at their maximum, as relative probabilities."""
    return F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))


def softmax(scores: Column) -> Column:
    """Softmax by log-sum-exp, with tiny scores raised to the cutoff and results kept within 1."""
    raised = F.transform(scores, lambda v: F.when(F.abs(v) < CUTOFF, F.lit(CUTOFF)).otherwise(v))
    top = F.array_max(raised)
    total = top + F.ln(F.aggregate(F.transform(raised, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v))
    return F.transform(raised, lambda v: F.least(F.exp(v - total), F.lit(1.0)))


def argmax(values: Column) -> Column:
    """Place of the maximum from 0; the first of several."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def safe_log(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(CUTOFF)))


def next_power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long")


def unit(*parts: Column) -> Column:
    """A deterministic number in [0, 1) from integers, the same in any engine."""
    mixed = F.lit(12_345)
    for p in parts:
        mixed = F.pmod(mixed * 7_919 + p.cast("long") * 104_729 + 17, F.lit(1_000_003))
    return mixed / F.lit(1_000_003.0)


def exponential(u: Column, rate: float) -> Column:
    """An exponential draw of a rate from a uniform one."""
    return -F.ln(1 - u) / rate


def sum_apart(v: Column) -> Column:
    """A sum of doubles that doesn't depend on their order: whole parts, exact below 2^53, and the rest apart."""
    rest = F.nanvl(v % 1.0, F.lit(0.0))
    return F.sum(v - rest) + F.sum(rest)


def number_text(x: Column) -> Column:
    """A double of up to 6 decimals as the SQL writes it: in full from 1e-4 to 1e16, beyond that with an exponent such as 1e-05 or 1.5e+16."""
    full = F.regexp_replace(x.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.regexp_replace(F.regexp_replace(F.lower(x.cast("string")), r"e(\d)", "e+$1"), r"(?<=e[+-])(?=\d$)", "0")
    return F.when((F.abs(x) < 1e16) & ((F.abs(x) >= 1e-4) | (x == 0)), full).otherwise(F.regexp_replace(power, r"\.0e", "e"))


def rounded(x: Column, digits: int) -> Column:
    """x rounded as the SQL does: its multiple of 10^digits in floating point to a whole number, halves away from zero, and back; -0.0 stays."""
    y = x * 10.0**digits
    whole = F.rint(y)
    away = F.when((y > 0) & (y - whole == 0.5), whole + 1).when((y < 0) & (y - whole == -0.5), whole - 1).otherwise(whole)
    return F.when(F.abs(y) == float("inf"), x).otherwise(away / 10.0**digits)


def key_mix(*parts: Column) -> Column:
    """60 well mixed bits of a key, the same in any engine: the head of a digest of its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def normal(u: Column, v: Column) -> Column:
    """A standard normal draw from two uniform ones."""
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * F.pi() * v)


def gamma_half(halves: int, draw) -> Column:
    """A gamma draw of shape halves / 2 from uniform draws draw(0), draw(1) ...: exponentials, and half the square of a normal one if halves is odd."""
    parts = [exponential(draw(k), 1.0) for k in range(halves // 2)]
    if halves % 2:
        n = normal(draw(halves // 2), draw(halves // 2 + 1))
        parts.append(n * n / 2)
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total
