"""The criteria language and conditional aggregates: many formulas with one range become one grouped aggregate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.functions.core import COMPAT

COMPARISON = re.compile(r"(>=|<=|<>|>|<|=)(.*)", re.DOTALL)
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity|nan)")


def glob(pattern: str) -> str:
    """A regular expression of a pattern with * and ?; a tilde takes the next character as it is."""
    out = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        i += 1
    return f"(?s)^{''.join(out)}$"


def _number(s: str) -> float | None:
    """The number that an operand is: digits as they stand, without blanks or separators."""
    return float(s) if NUMBER.fullmatch(s) else None


def _like(text: Column, pattern: str) -> Column:
    """Whether a text meets a pattern, case-sensitively."""
    return text.rlike(glob(pattern)) if re.search(r"[*?~]", pattern) else text == F.lit(pattern)


def matches(cell: Column, criterion: object, is_text: bool) -> Column:
    """Whether cells meet a criterion: a number, or text with a comparison or a pattern; never null.

    The criterion is trimmed, its operand is not. A null cell is a blank, which is the empty text in any column. Patterns,
    also those behind = and <>, are case-sensitive and never match numbers; of a number and a text only <> holds. An
    empty criterion matches nothing.
    """
    if isinstance(criterion, (int, float)) and not isinstance(criterion, bool):
        return F.lit(False) if is_text else F.coalesce(cell == float(criterion), F.lit(False))
    criterion = str(criterion).upper() if isinstance(criterion, bool) else criterion.strip()
    if not criterion:
        return F.lit(False)
    text = F.coalesce(cell, F.lit("")) if is_text else F.lit("")
    found = COMPARISON.match(criterion)
    op, operand = found.groups() if found else ("=", criterion)
    n = _number(operand) if found else None
    if n is None:
        of_number = F.lit(op == "<>")
        of_text = {"=": _like(text, operand), "<>": ~_like(text, operand), ">": text > operand, ">=": text >= operand, "<": text < operand, "<=": text <= operand}[op]
    else:
        of_text = F.lit(op == "<>")
        of_number = of_text if is_text else {"=": cell == n, "<>": cell != n, ">": cell > n, ">=": cell >= n, "<": cell < n, "<=": cell <= n}[op]
    return of_text if is_text else F.when(cell.isNotNull(), of_number).otherwise(of_text)


def condition(df: DataFrame, pairs: dict[str, object]) -> Column:
    """All criteria (column name to criterion) of a table."""
    out = F.lit(True)
    kinds = dict(df.dtypes)
    for name, criterion in pairs.items():
        cell = F.upper(F.col(name).cast("string")) if kinds[name] == "boolean" else F.col(name)
        out = out & matches(cell, criterion, kinds[name] in ("string", "boolean"))
    return out


def sumifs(x: Column, test: Column) -> Column:
    """Sum where the test holds."""
    return F.coalesce(F.sum(F.when(test, x)), F.lit(0.0))


def countifs(test: Column) -> Column:
    """How many rows meet the test."""
    return F.count(F.when(test, 1))


def averageifs(x: Column, test: Column) -> Column:
    """Mean where the test holds; matches that are no number count as 0; null (#DIV/0!) without a match."""
    return F.try_divide(F.coalesce(F.sum(F.when(test, x)), F.lit(0.0)), F.count(F.when(test, 1)).cast("double"))


def maxifs(x: Column, test: Column, mode: str = COMPAT) -> Column:
    """Largest match; COMPAT never goes below 0."""
    found = F.coalesce(F.max(F.when(test, x)), F.lit(0.0))
    return F.greatest(F.lit(0.0), found) if mode == COMPAT else found


def minifs(x: Column, test: Column, mode: str = COMPAT) -> Column:
    """Smallest match; COMPAT never goes above 0."""
    found = F.coalesce(F.min(F.when(test, x)), F.lit(0.0))
    return F.least(F.lit(0.0), found) if mode == COMPAT else found


def by_key(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """A column of conditional formulas, one for each key, as one pass: N formulas over M rows cost M, not N times M."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))
