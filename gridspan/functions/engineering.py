"""Number bases, bits and complex numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import NUM, UNKNOWN, VALUE, Val, first_error, fx, guarded, lift, number, numeric, text, text_of

#: Base and the number of bits of ten digits.
BASES = {"BIN": (2, 10), "OCT": (8, 30), "HEX": (16, 40)}
DIGITS = {"BIN": "[01]{1,10}", "OCT": "[0-7]{1,10}", "HEX": "[0-9A-Fa-f]{1,10}"}


def to_decimal(kind: str, s: Column) -> Column:
    """The number that ten digits of two's complement stand for; null where the text is none."""
    base, bits = BASES[kind]
    half = 2.0 ** (bits - 1)
    n = F.conv(F.nullif(F.regexp_extract(s, f"^({DIGITS[kind]})$", 1), F.lit("")), base, 10).cast("double")
    return (n + half) % (2 * half) - half  # names n once: nested calls stay one expression each


def from_decimal(kind: str, n: Column, places: Column | None, err: Column) -> Val:
    """Digits of a whole number, ten for a negative one, padded on demand."""
    base, bits = BASES[kind]
    whole = F.floor(n).cast("long")
    low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    plain = F.conv(F.when(whole < 0, whole + 2**bits).otherwise(whole).cast("string"), 10, base)
    out, bad = plain, ~whole.between(low, high)
    if places is not None:
        p = F.floor(places).cast("int")
        bad = bad | (whole >= 0) & ((p > 10) | (p < F.length(plain)))
        out = F.when(whole < 0, plain).otherwise(F.call_function("lpad", plain, p, F.lit("0")))
    return Val(out, F.coalesce(err, F.when(bad, NUM)), "text")


def _conversion(a: str, b: str) -> None:
    def run(x, places=None):
        v = text(x) if a != "DEC" else number(x)
        p = None if places is None else number(places)
        err = first_error(v, *([p] if p else []))
        n = v.value if a == "DEC" else to_decimal(a, v.value)
        err = F.coalesce(err, F.when(n.isNull(), NUM))
        return Val(n, err) if b == "DEC" else from_decimal(b, n, p and p.value, err)

    run.__doc__ = f"{a} to {b}."
    fx(f"{a}2{b}", most=1 if b == "DEC" else 2)(run)


for _a in ("BIN", "OCT", "HEX", "DEC"):
    for _b in ("BIN", "OCT", "HEX", "DEC"):
        if _a != _b:
            _conversion(_a, _b)

LIMIT = 2.0**48


def _bits(name: str, f) -> None:
    @numeric(name, least=2)
    def run(a, b):
        x, y = F.floor(a), F.floor(b)
        fine = x.between(0, LIMIT - 1) & y.between(0, LIMIT - 1)
        return guarded(f(F.when(fine, x).cast("long"), F.when(fine, y).cast("long")).cast("double"), (~fine, NUM))


_bits("BITAND", lambda a, b: a.bitwiseAND(b))
_bits("BITOR", lambda a, b: a.bitwiseOR(b))
_bits("BITXOR", lambda a, b: a.bitwiseXOR(b))


@numeric("BITLSHIFT", least=2)
def bitlshift(a, k):
    """Left shift of a whole number by 0 to 53 bits."""
    return guarded(F.floor(a) * F.pow(F.lit(2.0), F.floor(k)), ((a < 0) | (a > LIMIT) | ~F.floor(k).between(0, 53), NUM))


@numeric("BITRSHIFT", least=2)
def bitrshift(a, k):
    """Right shift of a whole number by 0 to 53 bits."""
    return guarded(F.floor(F.floor(a) / F.pow(F.lit(2.0), F.floor(k))).cast("double"), ((a < 0) | (a > LIMIT) | ~F.floor(k).between(0, 53), NUM))


@numeric("DELTA", most=2)
def delta(a, b=None):
    """1 where equal."""
    return F.when(a == (F.lit(0.0) if b is None else b), 1.0).otherwise(0.0)


@numeric("GESTEP", most=2)
def gestep(a, b=None):
    """1 from the step on."""
    return F.when(a >= (F.lit(0.0) if b is None else b), 1.0).otherwise(0.0)


# Complex numbers: text at the edges, a pair of doubles between.

REAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
COMPLEX_TEXT = rf"^\s*(?:({REAL})(?![0-9.]*\s*[ij]\s*$))?\s*(?:([+-]?\s*(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)?)\s*([ij]))?\s*$"


class Complex:
    """Real and imaginary part with the error and the suffix."""

    def __init__(self, re: Column, im: Column, err: Column, suffix: Column):
        self.re, self.im, self.err, self.suffix = re, im, err, suffix


class ComplexText(Val):
    """Text of a complex number that keeps its parts, so that a nested call need not read the text again."""

    def __init__(self, value: Column, re: Column, im: Column, err: Column, suffix: Column):
        super().__init__(value, err, "text")
        self.re, self.im, self.suffix = re, im, suffix


def parse(x, bad: str = NUM) -> Complex:
    """a+bi, a+bj, a number or blank (0); booleans are #VALUE!."""
    v = lift(x)
    if isinstance(v, ComplexText):
        # what the text of such parts cannot say: they are no numbers, or "+-0i"
        unread = F.isnan(v.re) | F.isnan(v.im) | (F.greatest(F.abs(v.re), F.abs(v.im)) == float("inf")) | (v.im.cast("string") == "-0.0")
        return Complex(v.re, v.im, F.coalesce(v.err, F.when(unread, bad)), v.suffix)
    s = F.when(v.value.isNull(), "0").otherwise(text_of(v.value))
    fits = s.rlike(COMPLEX_TEXT) & s.rlike("[0-9ij]")
    part = lambda i: F.regexp_extract(s, COMPLEX_TEXT, i)
    sign = F.regexp_replace(part(2), r"\s", "")
    im = F.when(part(3) == "", 0.0).when(sign.isin("", "+"), 1.0).when(sign == "-", -1.0).otherwise(sign.try_cast("double"))
    err = F.when(F.typeof(v.value) == "boolean", VALUE).when(~fits, bad)
    return Complex(F.coalesce(part(1).try_cast("double"), F.lit(0.0)), F.coalesce(im, F.lit(0.0)), F.coalesce(v.err, err), F.when(part(3) == "j", "j").otherwise("i"))


def write(re: Column, im: Column, err: Column, suffix: Column) -> Val:
    """re+imi text."""
    r, i = (F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"^(-?[0-9]+)\.0$", "$1") for x in (re, im))
    return ComplexText(F.concat(r, F.when(im < 0, "").otherwise("+"), i, suffix), re, im, err, suffix)


def _out(z: Complex, re: Column, im: Column) -> Val:
    bad = re.isNull() | im.isNull() | F.isnan(re) | F.isnan(im)
    return write(re, im, F.coalesce(z.err, F.when(bad, NUM)), z.suffix)


@fx("COMPLEX", least=2, most=3)
def complex_text(re, im, suffix="i"):
    """Text of two parts."""
    a, b, s = number(re), number(im), lift(suffix)
    got = write(a.value, b.value, F.coalesce(first_error(a, b, s), F.when(~s.value.cast("string").isin("i", "j"), VALUE)), s.value.cast("string"))
    return got if isinstance(suffix, str) else Val(got.value, got.err)  # a suffix from the data may be blank


def _real(name: str, f) -> None:
    def run(x):
        z = parse(x, UNKNOWN)
        return Val(f(z.re, z.im), z.err)

    run.__doc__ = f"{name} of a complex number."
    fx(name)(run)


_real("IMABS", lambda a, b: F.hypot(a, b))
_real("IMREAL", lambda a, b: a)
_real("IMAGINARY", lambda a, b: b)


def _times(a, b, c, d):
    return a * c - b * d, a * d + b * c


def _over(a, b, c, d):
    n = c * c + d * d
    return F.try_divide(a * c + b * d, n), F.try_divide(b * c - a * d, n)


_SIN = lambda a, b: (F.sin(a) * F.cosh(b), F.cos(a) * F.sinh(b))
_COS = lambda a, b: (F.cos(a) * F.cosh(b), -F.sin(a) * F.sinh(b))
_SINH = lambda a, b: (F.sinh(a) * F.cos(b), F.cosh(a) * F.sin(b))
_COSH = lambda a, b: (F.cosh(a) * F.cos(b), F.sinh(a) * F.sin(b))
_LN = lambda a, b: (F.ln(F.hypot(a, b)), F.atan2(b, a))


def _log_base(base: float):
    import math

    return lambda a, b: tuple(x / math.log(base) for x in _LN(a, b))


for _name, _f in {
    "IMCONJUGATE": lambda a, b: (a, -b),
    "IMEXP": lambda a, b: (F.exp(a) * F.cos(b), F.exp(a) * F.sin(b)),
    "IMLN": _LN,
    "IMLOG10": _log_base(10),
    "IMLOG2": _log_base(2),
    "IMSIN": _SIN,
    "IMCOS": _COS,
    "IMSINH": _SINH,
    "IMCOSH": _COSH,
    "IMTAN": lambda a, b: _over(*_SIN(a, b), *_COS(a, b)),
    "IMTANH": lambda a, b: _over(*_SINH(a, b), *_COSH(a, b)),
    "IMCOT": lambda a, b: _over(*_COS(a, b), *_SIN(a, b)),
    "IMSEC": lambda a, b: _over(F.lit(1.0), F.lit(0.0), *_COS(a, b)),
    "IMCSC": lambda a, b: _over(F.lit(1.0), F.lit(0.0), *_SIN(a, b)),
}.items():

    def _one(x, f=_f):
        z = parse(x, UNKNOWN)
        return _out(z, *f(z.re, z.im))

    fx(_name)(_one)


def _many(name: str, f, least: int, most: int | None) -> None:
    def run(*xs):
        zs = [parse(x) for x in xs]
        re, im = zs[0].re, zs[0].im
        for z in zs[1:]:
            re, im = f(re, im, z.re, z.im)
        return _out(Complex(re, im, F.coalesce(*(z.err for z in zs)), zs[0].suffix), re, im)

    run.__doc__ = f"{name}: a left fold."
    fx(name, least=least, most=most)(run)


_many("IMSUM", lambda a, b, c, d: (a + c, b + d), 1, None)
_many("IMPRODUCT", _times, 1, None)
_many("IMSUB", lambda a, b, c, d: (a - c, b - d), 2, 2)
_many("IMDIV", _over, 2, 2)
