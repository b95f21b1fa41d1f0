"""Values with an error lane, coercion rules and the registry that all formula functions share.

A spreadsheet value may be an error, and errors travel through formulas as data. Spark has no such type, so a value is a
pair of Columns: the value, and the error's text or null. Functions take such pairs, plain Columns or Python literals,
and stay Column expressions: Catalyst sees one projection however many functions are nested.

Two modes: COMPAT returns what the reference behaviour pins down, EXCEL what Excel documents where the two differ.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPAT, EXCEL = "compat", "excel"
DIV0, NA, NAME, NULL, NUM, REF, VALUE, GETTING, UNKNOWN, PLACEHOLDER = ERRORS = [
    "#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!", "#GETTING_DATA", "#UNKNOWN!", "#PLACEHOLDER",
]
#: Numbers nearer to zero than this count as zero in divisions and conditions.
TINY = 1e-10


def no_error() -> Column:
    """The error lane of a good value."""
    return F.lit(None).cast("string")


class Val:
    """A value Column with its error Column. `kind` is "number", "text" or "bool" where the value's type is known."""

    def __init__(self, value: Column, err: Column | None = None, kind: str | None = None):
        self.value, self.kind = value, kind
        self.err = no_error() if err is None else err

    def column(self) -> Column:
        """The value, null where there is an error."""
        return F.when(self.err.isNull(), self.value)

    def struct(self) -> Column:
        """Both lanes, for storing."""
        return F.struct(self.column().alias("value"), self.err.alias("err"))

    def shown(self) -> Column:
        """What a cell shows: the error's name or the value's text."""
        return F.coalesce(self.err, text_of(self.value))


def error(name: str) -> Val:
    """A constant error."""
    return Val(F.lit(None).cast("double"), F.lit(name))


def lift(x: Any) -> Val:
    """Any argument as a pair."""
    if isinstance(x, Val):
        return x
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return Val(F.lit(float(x)), kind="number")
    kind = {str: "text", bool: "bool"}.get(type(x))
    return Val(x if isinstance(x, Column) else F.lit(x), kind=kind)


def first_error(*vals: Val) -> Column:
    """The first argument's error that there is."""
    return F.coalesce(*(v.err for v in vals), no_error())


def number(x: Any) -> Val:
    """Operand of arithmetic: blank is 0, booleans 1 and 0, numeric text is parsed, other text is #VALUE!."""
    v = lift(x)
    if v.kind == "number":
        return v
    got = v.value.try_cast("double")
    return Val(F.coalesce(got, F.lit(0.0)), F.coalesce(v.err, F.when(v.value.isNotNull() & got.isNull(), VALUE)), "number")


def text_of(value: Column) -> Column:
    """Text of a value: whole numbers without a point, booleans upper-case, blank empty."""
    plain = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(plain.isin("true", "false"), F.upper(plain)).otherwise(F.regexp_replace(plain, r"^(-?[0-9]+)\.0$", "$1"))


def text(x: Any) -> Val:
    """Operand of text functions."""
    v = lift(x)
    return v if v.kind == "text" else Val(text_of(v.value), v.err, "text")


def alike(*vals: Val) -> list[Val]:
    """The values in one type, so that they can stand in one column: text where kinds are mixed."""
    kinds = {v.kind for v in vals}
    if len(kinds) == 1 or kinds == {None, "number"} or kinds == {None, "bool"}:
        return list(vals)
    return [v if v.kind == "text" else Val(v.value.cast("string") if v.kind is None else text_of(v.value), v.err, "text") for v in vals]


def truth(x: Any) -> Val:
    """Condition: a number is false within TINY of zero, text other than a number's is #VALUE!."""
    v = number(x)
    return Val(F.abs(v.value) >= TINY, v.err)


def guarded(value: Column, *rules: tuple[Column, str], args: tuple[Val, ...] = ()) -> Val:
    """A value with the errors of its arguments, then the first rule that holds."""
    err = first_error(*args)
    own = no_error()
    for when, name in reversed(rules):
        own = F.when(when, name).otherwise(own)
    return Val(value, F.coalesce(err, own))


def finite(v: Val, name: str = NUM) -> Val:
    """#NUM! (or another error) for what is no finite number."""
    bad = v.value.isNull() | F.isnan(v.value) | (F.abs(v.value) == float("inf"))
    return Val(v.value, F.coalesce(v.err, F.when(bad, name)))


FUNCTIONS: dict[str, tuple[Callable[..., Val], int, int | None]] = {}


def fx(*names: str, least: int = 1, most: int | None = -1):
    """Register a formula function under its names. most: None for any number, -1 for as many as at least."""

    def put(f):
        for n in names:
            FUNCTIONS[n] = (f, least, least if most == -1 else most)
        return f

    return put


def call(name: str, *args: Any) -> Val:
    """Apply a function by name: an unknown one is #NAME?, a wrong number of arguments #UNKNOWN!."""
    name = name.upper().removeprefix("_XLFN.").removeprefix("_XLWS.")
    if name not in FUNCTIONS:
        return error(NAME)
    f, least, most = FUNCTIONS[name]
    if len(args) < least or most is not None and len(args) > most:
        return error(UNKNOWN)
    return f(*args)


def numeric(*names: str, least: int = 1, most: int | None = -1):
    """Register a function of coerced numbers that returns a Column or a guarded value."""

    def put(f):
        def run(*args):
            vals = [number(a) for a in args]
            got = f(*(v.value for v in vals))
            got = got if isinstance(got, Val) else Val(got)
            return Val(got.value.cast("double"), F.coalesce(*(v.err for v in vals), got.err) if vals else got.err, "number")

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return fx(*names, least=least, most=most)(run)

    return put


# The operators.


def add(a: Any, b: Any) -> Val:
    """a + b."""
    a, b = number(a), number(b)
    return Val(a.value + b.value, first_error(a, b), "number")


def subtract(a: Any, b: Any) -> Val:
    """a - b."""
    a, b = number(a), number(b)
    return Val(a.value - b.value, first_error(a, b), "number")


def multiply(a: Any, b: Any) -> Val:
    """a * b."""
    a, b = number(a), number(b)
    return Val(a.value * b.value, first_error(a, b), "number")


def divide(a: Any, b: Any) -> Val:
    """a / b; #DIV/0! within TINY of zero."""
    a, b = number(a), number(b)
    return guarded(F.try_divide(a.value, b.value), (F.abs(b.value) < TINY, DIV0), args=(a, b))


def power(a: Any, b: Any) -> Val:
    """a ^ b, untrapped: infinities and NaN stay."""
    a, b = number(a), number(b)
    return Val(F.pow(a.value, b.value), first_error(a, b))


def negate(a: Any) -> Val:
    """-a."""
    return subtract(0, a)


def percent(a: Any) -> Val:
    """a%."""
    a = number(a)
    return Val(a.value / 100, a.err)


def concat(a: Any, b: Any) -> Val:
    """a & b."""
    a, b = text(a), text(b)
    return Val(F.concat(a.value, b.value), first_error(a, b), "text")


def _rank(value: Column) -> Column:
    """Numbers before texts before booleans, for comparing values of several types."""
    kind = F.typeof(value)
    return F.when(kind == "boolean", 2).when(kind == "string", 1).otherwise(0)


def compare(a: Any, op: str, b: Any, mode: str = COMPAT) -> Val:
    """A typed comparison: numbers < texts < booleans; text is case-sensitive in COMPAT mode; blanks are zero or empty."""
    a, b = lift(a), lift(b)
    fold = (lambda c: F.lower(c.cast("string"))) if mode == EXCEL else (lambda c: c.cast("string"))
    ra, rb = _rank(a.value), _rank(b.value)
    gap = F.coalesce(a.value.try_cast("double"), F.lit(0.0)) - F.coalesce(b.value.try_cast("double"), F.lit(0.0))
    numbers = F.when(F.abs(gap) < TINY, 0).when(gap < 0, -1).otherwise(1)
    ta, tb = F.coalesce(fold(a.value), F.lit("")), F.coalesce(fold(b.value), F.lit(""))
    texts = F.when(ta == tb, 0).when(ta < tb, -1).otherwise(1)
    order = F.when(ra != rb, F.when(ra < rb, -1).otherwise(1)).when(ra == 1, texts).otherwise(numbers)
    test = {"=": order == 0, "<>": order != 0, "<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[op]
    return Val(test, first_error(a, b))
