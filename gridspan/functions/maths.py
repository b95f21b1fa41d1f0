"""Mathematical, trigonometric and rounding functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import DIV0, NUM, VALUE, Val, finite, first_error, fx, guarded, number, numeric


def _fold(values: list[Column], f) -> Column:
    out = values[0]
    for v in values[1:]:
        out = f(out, v)
    return out


# One-argument functions with no rule of their own.
for _names, _f in {
    ("ABS",): F.abs, ("EXP",): F.exp, ("DEGREES",): F.degrees, ("RADIANS",): F.radians, ("SIGN",): F.signum, ("INT",): lambda x: F.floor(x).cast("double"),
    ("SIN",): F.sin, ("COS",): F.cos, ("TAN",): F.tan, ("COT",): F.cot, ("CSC",): F.csc, ("SINH",): F.sinh, ("COSH",): F.cosh, ("TANH", "FISHERINV"): F.tanh,
    ("ASIN",): F.asin, ("ACOS",): F.acos, ("ATAN",): F.atan, ("ASINH",): F.asinh, ("ACOSH",): F.acosh, ("ATANH", "FISHER"): F.atanh, ("COTH",): lambda x: F.try_divide(F.lit(1.0), F.tanh(x)),
}.items():
    numeric(*_names)(_f)


@numeric("LN")
def ln(x):
    """Natural logarithm; no number for what is not positive."""
    return finite(Val(F.ln(x)))


@numeric("LOG10")
def log10(x):
    """Decimal logarithm."""
    return finite(Val(F.log10(x)))


@numeric("LOG", most=2)
def log(x, base=None):
    """Logarithm to a base, 10 unless given."""
    base = F.lit(10.0) if base is None else base
    return guarded(F.try_divide(F.ln(x), F.ln(base)), ((x <= 0) | (base <= 0) | (base == 1), NUM))


@numeric("SQRT")
def sqrt(x):
    """Square root."""
    return guarded(F.sqrt(x), (x < 0, NUM))


@numeric("SQRTPI")
def sqrtpi(x):
    """Square root of x times pi."""
    return guarded(F.sqrt(x * math.pi), (x < 0, NUM))


@numeric("POWER", least=2)
def power(x, y):
    """x to the y; no number where that is not finite."""
    return finite(Val(F.pow(x, y)))


@numeric("MOD", least=2)
def mod(n, d):
    """Remainder with the divisor's sign."""
    return guarded(n - d * F.floor(F.try_divide(n, d)), (d == 0, DIV0))


def toward_zero(x: Column) -> Column:
    """The whole part."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


@numeric("QUOTIENT", least=2)
def quotient(n, d):
    """Whole part of a quotient."""
    return guarded(toward_zero(F.try_divide(n, d)), (d == 0, DIV0))


@fx("PI", least=0)
def pi():
    """The circle constant."""
    return Val(F.lit(math.pi))


def factorial(n: Column) -> Column:
    """n! as a double, in one expression: exact while products are."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(171)).cast("int"))), F.lit(1.0), lambda a, i: a * i)


@numeric("FACT")
def fact(x):
    """Factorial of the whole part."""
    return guarded(factorial(F.floor(x)), ((x < 0) | (x >= 171), NUM))


@numeric("FACTDOUBLE")
def factdouble(x):
    """Product of every second number down from x."""
    n = F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(300)).cast("int")
    return guarded(F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / 2)).cast("int")), F.lit(1.0), lambda a, i: a * F.greatest(F.lit(1), n - 2 * i)), ((x < 0) | (x > 300), NUM))


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a running product."""
    steps = F.least(k, n - k).cast("int")
    terms = F.when(steps > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), steps))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.lit(1.0), lambda a, i: a * (n - steps + i) / i)


@numeric("COMBIN", least=2)
def combin(n, k):
    """Combinations."""
    n, k = F.floor(n), F.floor(k)
    return guarded(F.round(choose(n, k)), ((n < 0) | (k < 0) | (k > n) | (k > 10_000), NUM))


@numeric("PERMUT", least=2)
def permut(n, k):
    """Permutations."""
    n, k = F.floor(n), F.floor(k)
    terms = F.when(k > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(k, F.lit(10_000)).cast("int") - 1))).otherwise(F.array().cast("array<int>"))
    return guarded(F.aggregate(terms, F.lit(1.0), lambda a, i: a * (n - i)), ((n < 0) | (k < 0) | (k > n), NUM))


def gcd_of(a: Column, b: Column) -> Column:
    """Euclid's steps; 90 suffice for 64 bits."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0)).otherwise(s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).cast("long").alias("b")), lambda s: s["a"].cast("double"))


@numeric("GCD", most=None)
def gcd(*xs):
    """Greatest common divisor of whole parts."""
    return guarded(_fold([F.floor(x).cast("double") for x in xs], gcd_of), (F.least(*xs, F.lit(0.0)) < 0, NUM))


@numeric("LCM", most=None)
def lcm(*xs):
    """Least common multiple of whole parts."""
    return guarded(_fold([F.floor(x).cast("double") for x in xs], lambda a, b: F.coalesce(F.try_divide(a * b, gcd_of(a, b)), F.lit(0.0))), (F.least(*xs, F.lit(0.0)) < 0, NUM))


@numeric("MULTINOMIAL", most=None)
def multinomial(*xs):
    """(sum)! over the product of factorials, as a product of binomials."""
    total, out = F.lit(0.0), F.lit(1.0)
    for x in xs:
        total = total + F.floor(x)
        out = out * choose(total, F.floor(x))
    return guarded(F.round(out), (F.least(*xs, F.lit(0.0)) < 0, NUM))


@numeric("STANDARDIZE", least=3)
def standardize(x, mean, sd):
    """Distance from the mean in deviations."""
    return guarded(F.try_divide(x - mean, sd), (sd <= 0, NUM))


@numeric("ATAN2", least=2)
def atan2(x, y):
    """Angle of the point (x, y)."""
    return guarded(F.atan2(y, x), ((x == 0) & (y == 0), DIV0))


# Rounding.


def scaled(x: Column, digits: Column, f) -> Column:
    """Apply a whole-number rounding at so many decimal digits."""
    p = F.pow(F.lit(10.0), toward_zero(digits))
    return f(x * p) / p


@numeric("ROUND", least=2)
def round_half(x, digits):
    """Half away from zero."""
    return scaled(x, digits, lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5))


@numeric("ROUNDDOWN", least=2)
def rounddown(x, digits):
    """Toward zero."""
    return scaled(x, digits, toward_zero)


@numeric("ROUNDUP", least=2)
def roundup(x, digits):
    """Away from zero."""
    return scaled(x, digits, lambda v: F.signum(v) * F.ceil(F.abs(v)))


@numeric("TRUNC", most=2)
def trunc(x, digits=None):
    """Toward zero, at 0 digits unless given."""
    return scaled(x, F.lit(0.0) if digits is None else digits, toward_zero)


@numeric("CEILING", least=2)
def ceiling(x, step):
    """Up to a multiple of the step."""
    return guarded(F.when((x == 0) | (step == 0), 0.0).otherwise(F.ceil(F.try_divide(x, step)) * step), (x * step < 0, NUM))


@numeric("FLOOR", least=2)
def floor(x, step):
    """Down to a multiple of the step."""
    return guarded(F.when((x == 0) | (step == 0), 0.0).otherwise(F.floor(F.try_divide(x, step)) * step), (x * step < 0, NUM))


@numeric("MROUND", least=2)
def mround(x, step):
    """To the nearest multiple."""
    q = F.try_divide(x, step)
    return guarded(F.when(step == 0, 0.0).otherwise(F.signum(q) * F.floor(F.abs(q) + 0.5) * step), (x * step < 0, NUM))


@numeric("EVEN")
def even(x):
    """Away from zero to an even number."""
    return F.signum(x) * 2 * F.ceil(F.abs(x) / 2)


@numeric("ODD")
def odd(x):
    """Away from zero to an odd number."""
    return F.when(x == 0, 1.0).otherwise(F.signum(x) * (2 * F.ceil((F.abs(x) - 1) / 2) + 1))


@fx("RAND", least=0)
def rand(seed=None):
    """Uniform in [0, 1)."""
    return Val(F.rand(seed) if seed is not None else F.rand())


@fx("RANDBETWEEN", least=2)
def randbetween(low, high):
    """A whole number from low to high."""
    a, b = number(low), number(high)
    first, last = F.ceil(a.value), F.floor(b.value)
    return guarded((first + F.floor(F.rand() * (last - first + 1))).cast("double"), (last < first, NUM), args=(a, b))


@fx("ISEVEN")
def iseven(x):
    """Parity of the whole part; text is #VALUE!."""
    v = number(x)
    return Val(F.abs(toward_zero(v.value)) % 2 == 0, v.err)


@fx("ISODD")
def isodd(x):
    """Negated parity."""
    v = number(x)
    return Val(F.abs(toward_zero(v.value)) % 2 == 1, v.err)


__all__ = ["VALUE", "choose", "first_error", "toward_zero"]
