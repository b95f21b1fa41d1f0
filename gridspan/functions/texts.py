"""Text and regular-expression functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import EXCEL, NA, NUM, VALUE, Val, first_error, fx, guarded, lift, number, text, truth

EDGE = r"^[\s ]+|[\s ]+$"


def _text(*names: str):
    """Register a one-argument text function."""

    def put(f):
        def run(x):
            v = text(x)
            return Val(f(v.value), v.err)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return fx(*names)(run)

    return put


def one_to_one(s: Column) -> Column:
    """Whether each character of a text is one a reader sees: ASCII without line break pairs."""
    return (F.octet_length(s) == F.char_length(s)) & ~F.contains(s, F.lit("\r\n"))


def clusters(s: Column) -> Column:
    """What a reader takes for the characters of a text, as an array."""
    return F.regexp_extract_all(s, F.lit(r"\X"), F.lit(0))


def part(s: Column, start: Column, n: Column) -> Column:
    """n characters from a place, as a reader counts them."""
    return F.when(one_to_one(s), F.substring(s, start, n)).otherwise(F.array_join(F.slice(clusters(s), start, n), ""))


_text("LOWER")(F.lower)
_text("UPPER")(F.upper)
_text("LEN")(lambda s: F.when(one_to_one(s), F.char_length(s)).otherwise(F.size(clusters(s))).cast("double"))
_text("LENB")(lambda s: F.octet_length(s).cast("double"))
_text("CLEAN")(lambda s: F.regexp_replace(s, r"[\x00-\x1F]", ""))


@fx("TRIM", most=2)
def trim(x, mode="compat"):
    """Spaces off both ends; EXCEL mode also makes inner runs single."""
    v = text(x)
    out = F.regexp_replace(v.value, EDGE, "")
    return Val(F.regexp_replace(out, " +", " ") if mode == EXCEL else out, v.err)


@_text("PROPER")
def proper(s):
    """A capital after every character that is no letter."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}+|[^\p{L}]+"), 0), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


@fx("CHAR")
def char(x):
    """The character of a code from 1 to 255."""
    v = number(x)
    code = F.floor(v.value).cast("long")
    return guarded(F.decode(F.when(code < 128, F.unhex(F.lpad(F.hex(code), 2, "0"))).otherwise(F.unhex(F.concat(F.hex(192 + F.shiftright(code, 6)), F.hex(128 + code.bitwiseAND(63))))), "UTF-8"), ((code < 1) | (code > 255), VALUE), args=(v,))


@fx("CODE")
def code(x):
    """The code point of the first character."""
    v = text(x)
    return guarded(F.ascii(v.value).cast("double"), (F.length(v.value) == 0, VALUE), args=(v,))


@fx("CONCAT", "CONCATENATE", least=0, most=None)
def joined(*xs):
    """All arguments in a row."""
    vals = [text(x) for x in xs]
    return Val(F.concat(*(v.value for v in vals)) if vals else F.lit(""), first_error(*vals))


@fx("TEXTJOIN", least=3, most=None)
def textjoin(delimiter, skip_empty, *xs):
    """Arguments between delimiters, empty ones left out on demand."""
    d, skip, vals = text(delimiter), truth(skip_empty), [text(x) for x in xs]
    items = F.array(*(v.value for v in vals))
    items = F.when(skip.value, F.filter(items, lambda s: s != "")).otherwise(items)
    return Val(F.aggregate(items, F.lit(None).cast("string"), lambda a, s: F.when(a.isNull(), s).otherwise(F.concat(a, d.value, s)), lambda a: F.coalesce(a, F.lit(""))), first_error(d, skip, *vals))


@fx("EXACT", least=2)
def exact(a, b):
    """Case-sensitive equality."""
    x, y = text(a), text(b)
    return Val(x.value == y.value, first_error(x, y))


def _located(a, b, start, fold: bool) -> Val:
    x, y, at = text(a), text(b), number(start)
    needle, hay = (F.lower(x.value), F.lower(y.value)) if fold else (x.value, y.value)
    first = F.floor(at.value).cast("int")
    found = F.call_function("locate", needle, hay, first)
    return guarded(found.cast("double"), ((first < 1) | (found == 0), VALUE), args=(x, y, at))


@fx("FIND", "FINDB", least=2, most=3)
def find(a, b, start=1):
    """Place of a text in another, with case."""
    return _located(a, b, start, False)


@fx("SEARCH", "SEARCHB", least=2, most=3)
def search(a, b, start=1):
    """Place of a text in another, without case."""
    return _located(a, b, start, True)


@fx("LEFT", "LEFTB", least=2)
def left(s, n):
    """The first characters."""
    x, k = text(s), number(n)
    return guarded(part(x.value, F.lit(1), F.greatest(F.floor(k.value).cast("int"), F.lit(0))), (k.value < 0, VALUE), args=(x, k))


@fx("RIGHT", "RIGHTB", least=2)
def right(s, n):
    """The last characters."""
    x, k = text(s), number(n)
    n = F.greatest(F.floor(k.value).cast("int"), F.lit(0))
    seen = clusters(x.value)
    far = F.array_join(F.slice(seen, F.greatest(F.size(seen) - n, F.lit(0)) + 1, n), "")
    return guarded(F.when(one_to_one(x.value), F.right(x.value, n)).otherwise(far), (k.value < 0, VALUE), args=(x, k))


@fx("MID", "MIDB", least=3)
def mid(s, start, n):
    """Characters from a place."""
    x, a, k = text(s), number(start), number(n)
    return guarded(part(x.value, F.greatest(F.floor(a.value).cast("int"), F.lit(1)), F.greatest(F.floor(k.value).cast("int"), F.lit(0))), ((a.value < 1) | (k.value < 0), VALUE), args=(x, a, k))


@fx("REPLACE", "REPLACEB", least=4)
def replace(s, start, n, new):
    """Characters from a place made others."""
    x, a, k, y = text(s), number(start), number(n), text(new)
    at, size = F.floor(a.value).cast("int"), F.floor(k.value).cast("int")
    return guarded(F.concat(F.substring(x.value, F.lit(1), at - 1), y.value, F.substring(x.value, at + size, F.length(x.value))), ((a.value < 1) | (k.value < 0), VALUE), args=(x, a, k, y))


@fx("REPT", least=2)
def rept(s, n):
    """A text so many times."""
    x, k = text(s), number(n)
    return guarded(F.repeat(x.value, F.floor(k.value).cast("int")), (k.value < 0, VALUE), args=(x, k))


@fx("SUBSTITUTE", least=3, most=4)
def substitute(s, old, new, nth=None):
    """All occurrences, or the n-th, made another text."""
    x, o, y = text(s), text(old), text(new)
    every = F.when(o.value == "", x.value).otherwise(F.replace(x.value, o.value, y.value))
    if nth is None:
        return Val(every, first_error(x, o, y))
    k = number(nth)
    n = F.floor(k.value).cast("int")
    parts = F.split(x.value, F.concat(F.lit("\\Q"), o.value, F.lit("\\E")), -1)
    one = F.concat(F.call_function("array_join", F.slice(parts, F.lit(1), n), o.value), y.value, F.call_function("array_join", F.slice(parts, n + 1, F.size(parts)), o.value))
    return guarded(F.when((o.value == "") | (F.size(parts) <= n), x.value).otherwise(one), (n < 1, VALUE), args=(x, o, y, k))


@fx("VALUE")
def value(x):
    """The number that a text shows, a trailing % divides by 100."""
    v = text(x)
    s = F.regexp_replace(v.value, EDGE, "")
    got = F.when(s.endswith("%"), F.regexp_replace(s, "%$", "").try_cast("double") / 100).otherwise(s.try_cast("double"))
    return guarded(got, (~s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?%?$") | got.isNull(), VALUE), args=(v,))


def grouped_digits(x: Column, digits: Column, commas: Column | bool = True) -> Column:
    """Half-away rounding to so many decimals, grouped by thousands."""
    p = F.pow(F.lit(10.0), digits)
    whole = F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p
    shown = F.call_function("format_number", whole, F.greatest(digits, F.lit(0)).cast("int"))
    return F.when(F.lit(commas) if isinstance(commas, bool) else commas, shown).otherwise(F.replace(shown, F.lit(","), F.lit("")))


@fx("FIXED", most=3)
def fixed(x, digits=2, no_commas=False):
    """A rounded number as text."""
    v, d, plain = number(x), number(digits), truth(no_commas)
    return guarded(grouped_digits(v.value, F.floor(d.value), ~plain.value), (d.value > 127, VALUE), args=(v, d, plain))


@fx("DOLLAR", "USDOLLAR", most=2)
def dollar(x, digits=2):
    """A rounded amount as text, negatives in parentheses."""
    v, d = number(x), number(digits)
    amount = F.concat(F.lit("$"), grouped_digits(F.abs(v.value), F.floor(d.value)))
    return Val(F.when(v.value < 0, F.concat(F.lit("("), amount, F.lit(")"))).otherwise(amount), first_error(v, d))


#: A number mask: literals before, digits with optional decimals and exponent, percent, literals after.
LITERALS = r'(?:"[^"]*"|\\.|[$€£() +-])*'
MASK = re.compile(rf"(?P<pre>{LITERALS})(?P<whole>#,##0|#,###|[#0]+)(?:\.(?P<digits>[0#]+))?(?P<exponent>E[+-]0+)?(?P<percent>%?)(?P<post>{LITERALS})")


def _literal(raw: str) -> Column:
    return F.lit(re.sub(r'"([^"]*)"|\\(.)', lambda m: m[1] if m[1] is not None else m[2], raw))


def _masked(x: Column, mask: str) -> Column | None:
    """Text of a number that is not negative by one section of a mask; null if the mask is none."""
    m = MASK.fullmatch(mask)
    if not m:
        return None
    digits = len(m["digits"] or "")
    optional = len(m["digits"] or "") - len((m["digits"] or "").rstrip("#"))
    least = m["whole"].replace("#,##", "").count("0")
    x = x * 100 if m["percent"] else x
    tail = F.lit("")
    if m["exponent"]:
        power = F.when(x == 0, F.lit(0.0)).otherwise(F.floor(F.log10(x)).cast("double"))
        x = F.try_divide(x, F.pow(F.lit(10.0), power))
        sign = F.when(power < 0, "-").otherwise("+" if "+" in m["exponent"] else "")
        tail = F.concat(F.lit("E"), sign, F.lpad(F.abs(power).cast("int").cast("string"), m["exponent"].count("0"), "0"))
    out = grouped_digits(x, F.lit(float(digits)), "," in m["whole"])
    if optional:
        out = F.regexp_replace(F.regexp_replace(out, f"0{{1,{optional}}}$", ""), r"\.$", "")
    if least > 1:
        short = least - F.length(F.regexp_extract(out, r"^[0-9]*", 0))
        out = F.when(short > 0, F.concat(F.repeat(F.lit("0"), short), out)).otherwise(out)
    if least == 0:
        out = F.regexp_replace(out, r"^0(?=\.|$)", "")
    return F.concat(_literal(m["pre"]), out, tail, F.lit(m["percent"]), _literal(m["post"]))


@fx("TEXT", least=2)
def shown(x, mask):
    """A number in a mask of up to three sections (positive; negative; zero): 000, #,##0.0#, 0%, 0.00E+00, literals in
    quotes or after a backslash, signs and currency; @ and General; and date masks of y, m, d, h, s.

    The mask is a Python string: it is read when the plan is made. Other masks are #VALUE!.
    """
    from .dates import moment_of

    if mask in ("@", "General"):
        return text(x)
    v = number(x)
    if re.fullmatch(r"[ymdhs/:\- .,]+", mask):
        java = re.sub(r"(?<=h)(:)m+|m+(?=:s)", lambda k: k[0].replace("mm", "\0\0").replace("m", "\0"), mask).replace("m", "M").replace("\0", "m").replace("h", "H")
        return guarded(F.date_format(moment_of(v.value), java), (v.value < 0, VALUE), args=(v,))
    parts = [_masked(F.abs(v.value), p) for p in re.findall(r'(?:"[^"]*"|\\.|[^;"\\])+', mask)]
    if not 1 <= len(parts) <= 3 or any(p is None for p in parts):
        return Val(F.lit(None).cast("string"), F.lit(VALUE))
    negative = parts[1] if len(parts) > 1 else F.concat(F.lit("-"), parts[0])
    zero = parts[2] if len(parts) > 2 else parts[0]
    return Val(F.when(v.value < 0, negative).when(v.value == 0, zero).otherwise(parts[0]), v.err, "text")


def _flag(pattern: Val, insensitive: Val) -> Column:
    return F.when(insensitive.value != 0, F.concat(F.lit("(?i)"), pattern.value)).otherwise(pattern.value)


@fx("REGEXTEST", least=2, most=3)
def regextest(s, pattern, insensitive=0):
    """Whether a pattern occurs."""
    x, p, i = text(s), text(pattern), number(insensitive)
    return Val(F.rlike(x.value, _flag(p, i)), first_error(x, p, i))


@fx("REGEXEXTRACT", least=2, most=4)
def regexextract(s, pattern, what=0, insensitive=0):
    """The first match (0), all matches (1) or the first match's groups (2; a Python pattern, read when the plan is made)."""
    x, p, i = text(s), text(pattern), number(insensitive)
    used = _flag(p, i)
    found = F.rlike(x.value, used)
    if what == 1:
        out = F.regexp_extract_all(x.value, used, F.lit(0))
    elif what == 2:
        groups = re.compile(pattern).groups
        out = F.array(*(F.call_function("regexp_extract", x.value, used, F.lit(g)) for g in range(1, groups + 1)))
    else:
        out = F.call_function("regexp_extract", x.value, used, F.lit(0))
    return Val(out, F.coalesce(first_error(x, p, i), F.when(~found, NA)))


@fx("REGEXREPLACE", least=3, most=5)
def regexreplace(s, pattern, new, nth=0, insensitive=0):
    """All matches made another text, or the n-th (a negative n counts from the end; its text is taken literally)."""
    x, p, y, k, i = text(s), text(pattern), text(new), number(nth), number(insensitive)
    used = _flag(p, i)
    every = F.regexp_replace(x.value, used, y.value)
    found, between = F.regexp_extract_all(x.value, used, F.lit(0)), F.split(x.value, used, -1)
    n = F.floor(k.value).cast("int")
    at = F.when(n < 0, F.size(found) + n).otherwise(n - 1)
    swapped = F.transform(found, lambda m, j: F.when(j == at, y.value).otherwise(m))
    one = F.array_join(F.flatten(F.zip_with(between, swapped, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return Val(F.when(n == 0, every).otherwise(one), first_error(x, p, y, k, i))


@fx("ADDRESS", least=2, most=5)
def address(row, column, kind=1, a1=True, sheet=None):
    """Reference text of a cell; `kind` 1 to 4 sets which parts are absolute."""
    r, c, k = number(row), number(column), number(kind)
    style = truth(a1)
    n = F.floor(c.value).cast("int")
    letters = column_letters(n)
    row_abs, col_abs = k.value.isin(1.0, 2.0), k.value.isin(1.0, 3.0)
    rows = F.floor(r.value).cast("int").cast("string")
    one = F.concat(F.when(col_abs, "$").otherwise(""), letters, F.when(row_abs, "$").otherwise(""), rows)
    other = F.concat(F.lit("R"), F.when(row_abs, rows).otherwise(F.concat(F.lit("["), rows, F.lit("]"))), F.lit("C"), F.when(col_abs, n.cast("string")).otherwise(F.concat(F.lit("["), n.cast("string"), F.lit("]"))))
    out = F.when(style.value, one).otherwise(other)
    if sheet is not None:
        out = F.concat(lift(sheet).value, F.lit("!"), out)
    return guarded(out, ((r.value < 1) | (c.value < 1) | ~k.value.between(1, 4), VALUE), args=(r, c, k, style))


def column_letters(n: Column) -> Column:
    """Bijective base-26 letters of a column number up to 18278."""
    letter = lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), i.cast("int") + 1, F.lit(1))
    last = letter((n - 1) % 26)
    second = F.floor((n - 1) / 26)
    third = F.floor((second - 1) / 26)
    return F.concat(F.when(second > 26, letter((third - 1) % 26)).otherwise(""), F.when(second > 0, letter((second - 1) % 26)).otherwise(""), last)


__all__ = ["NUM", "column_letters", "grouped_digits"]
