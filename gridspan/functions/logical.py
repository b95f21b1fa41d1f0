"""Logical and type-information functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import NA, VALUE, Val, alike, compare, error, first_error, fx, lift, no_error, number, truth


@fx("TRUE", least=0)
def true():
    """The constant."""
    return Val(F.lit(True))


@fx("FALSE", least=0)
def false():
    """The constant."""
    return Val(F.lit(False))


@fx("NOT")
def negation(x):
    """Negated condition."""
    v = truth(x)
    return Val(~v.value, v.err)


def _folded(xs, f, start: bool) -> Val:
    """Fold of booleans and numbers; texts and blanks are left out, and with nothing left it is #VALUE!."""
    vals = [lift(x) for x in xs]
    marks = [v.value.try_cast("double") for v in vals]
    out, some = F.lit(start), F.lit(False)
    for m in marks:
        out = f(out, F.coalesce(m != 0, F.lit(start)))
        some = some | m.isNotNull()
    return Val(out, F.coalesce(first_error(*vals), F.when(~some, VALUE)))


@fx("AND", most=None)
def conjunction(*xs):
    """Whether all hold."""
    return _folded(xs, lambda a, b: a & b, True)


@fx("OR", most=None)
def disjunction(*xs):
    """Whether any holds."""
    return _folded(xs, lambda a, b: a | b, False)


@fx("XOR", most=None)
def parity(*xs):
    """Whether an odd number hold."""
    return _folded(xs, lambda a, b: a != b, False)


@fx("IF", least=2, most=3)
def choice(test, yes, no=False):
    """One of two values; the other one's error does not show."""
    t, (y, n) = truth(test), alike(lift(yes), lift(no))
    return Val(F.when(t.value, y.value).otherwise(n.value), F.when(t.err.isNotNull(), t.err).when(t.value, y.err).otherwise(n.err))


@fx("IFERROR", least=2)
def iferror(x, other):
    """The second value where the first is an error."""
    v, o = alike(lift(x), lift(other))
    return Val(F.when(v.err.isNotNull(), o.value).otherwise(v.value), F.when(v.err.isNotNull(), o.err), v.kind)


@fx("IFNA", least=2)
def ifna(x, other):
    """The second value where the first is #N/A."""
    v, o = alike(lift(x), lift(other))
    missing = v.err.eqNullSafe(F.lit(NA))
    return Val(F.when(missing, o.value).otherwise(v.value), F.when(missing, o.err).otherwise(v.err))


@fx("IFS", least=2, most=None)
def ifs(*pairs):
    """The value of the first condition that holds, else #N/A."""
    if len(pairs) % 2:
        return error("#UNKNOWN!")
    value, err = F.lit(None), F.lit(NA)
    for test, v in reversed(list(zip(pairs[::2], alike(*map(lift, pairs[1::2])), strict=True))):
        t = truth(test)
        value = F.when(t.err.isNull() & t.value, v.value).otherwise(value)
        err = F.when(t.err.isNotNull(), t.err).when(t.value, v.err).otherwise(err)
    return Val(value, err)


@fx("SWITCH", least=3, most=None)
def switch(x, *rest):
    """The value beside the first equal case, then the default, else #N/A."""
    v = lift(x)
    cases, values = rest[: len(rest) // 2 * 2 : 2], alike(*map(lift, (*rest[1::2], *(rest[-1:] if len(rest) % 2 else ()))))
    pairs, default = list(zip(cases, values, strict=False)), values[-1] if len(rest) % 2 else Val(F.lit(None), F.lit(NA))
    value, err = default.value, default.err
    for case, then in reversed(pairs):
        same, t = compare(v, "=", case), then
        value = F.when(same.value, t.value).otherwise(value)
        err = F.when(same.value, t.err).otherwise(err)
    return Val(value, F.coalesce(v.err, err))


@fx("CHOOSE", least=2, most=None)
def pick(k, *xs):
    """The k-th of the following values."""
    n, vals = number(k), alike(*map(lift, xs))
    at = F.floor(n.value)
    value, err = F.lit(None), F.lit(VALUE)
    for i, v in reversed(list(enumerate(vals, 1))):
        value, err = F.when(at == i, v.value).otherwise(value), F.when(at == i, v.err).otherwise(err)
    return Val(value, F.coalesce(n.err, err))


def _is(test):
    return lambda x: Val(test(lift(x)), no_error())


def kind(v: Val) -> Column:
    """blank, error, boolean, text or number."""
    name = F.typeof(v.value)
    return F.when(v.err.isNotNull(), "error").when(v.value.isNull(), "blank").when(name == "boolean", "boolean").when(name == "string", "text").otherwise("number")


for _name, _test in {
    "ISBLANK": lambda v: kind(v) == "blank",
    "ISERROR": lambda v: v.err.isNotNull(),
    "ISERR": lambda v: v.err.isNotNull() & (v.err != NA),
    "ISNA": lambda v: v.err.eqNullSafe(F.lit(NA)),
    "ISLOGICAL": lambda v: kind(v) == "boolean",
    "ISNUMBER": lambda v: kind(v) == "number",
    "ISTEXT": lambda v: kind(v) == "text",
    "ISNONTEXT": lambda v: kind(v) != "text",
}.items():
    fx(_name)(_is(_test))


@fx("NA", least=0)
def missing():
    """The error #N/A."""
    return error(NA)


@fx("N")
def as_number(x):
    """Numbers and booleans as numbers, anything else 0."""
    v = lift(x)
    return Val(F.when(kind(v).isin("number", "boolean"), v.value.try_cast("double")).otherwise(0.0), v.err)


@fx("T")
def as_text(x):
    """Text as it is, anything else empty."""
    v = lift(x)
    return Val(F.when(kind(v) == "text", v.value.cast("string")).otherwise(""), v.err)


@fx("TYPE")
def type_code(x):
    """1 number or blank, 2 text, 4 boolean, 16 error."""
    k = kind(lift(x))
    return Val(F.when(k == "text", 2.0).when(k == "boolean", 4.0).when(k == "error", 16.0).otherwise(1.0))


@fx("ISFORMULA")
def isformula(formula):
    """Whether the formula column of a cell is filled."""
    return Val(lift(formula).value.isNotNull())


@fx("FORMULATEXT")
def formulatext(formula):
    """The formula column of a cell, #N/A where there is none."""
    v = lift(formula)
    return Val(v.value, F.coalesce(v.err, F.when(v.value.isNull(), NA)))
