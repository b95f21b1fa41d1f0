"""Aggregate functions as aggregate Columns for groupBy().agg() or agg(): partial on the map side, like any Spark sum.

Where the reference behaviour differs from the documented one, `mode` chooses; see each function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import COMPAT


def lane(value: Column, empty: str | None = None, fallback: float | None = None) -> tuple[Column, Column]:
    """A value and an error lane: a null aggregate becomes the fallback or the error."""
    if fallback is not None:
        return F.coalesce(value, F.lit(fallback)), F.lit(None).cast("string")
    return value, F.when(value.isNull(), empty)


def first_error(err: Column, position: Column) -> Column:
    """The error of the first cell that has one: aggregates propagate it."""
    return F.min_by(err, F.when(err.isNotNull(), position))


def SUM(x: Column) -> Column:
    """Sum of numbers, 0 where there is none."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def AVERAGE(x: Column) -> Column:
    """Mean, null (#DIV/0!) where there is no number."""
    return F.avg(x)


def COUNT(x: Column) -> Column:
    """How many numbers."""
    return F.count(x)


def COUNTA(x: Column) -> Column:
    """How many cells that are not blank."""
    return F.count(x)


def COUNTBLANK(x: Column) -> Column:
    """How many blank cells or empty texts."""
    return F.count(F.when(x.isNull() | (x.cast("string") == ""), 1))


def MAX(x: Column) -> Column:
    """Largest number, 0 where there is none."""
    return F.coalesce(F.max(x), F.lit(0.0))


def MIN(x: Column) -> Column:
    """Smallest number, 0 where there is none."""
    return F.coalesce(F.min(x), F.lit(0.0))


def PRODUCT(x: Column) -> Column:
    """Product, 0 where there is no number."""
    return F.coalesce(F.product(x), F.lit(0.0))


def MEDIAN(x: Column) -> Column:
    """Exact median."""
    return F.median(x)


def STDEV(x: Column) -> Column:
    """Sample deviation, null (#N/A) for fewer than two."""
    return F.when(F.count(x) > 1, F.stddev_samp(x))


def STDEV_P(x: Column) -> Column:
    """Population deviation."""
    return F.stddev_pop(x)


def VAR(x: Column) -> Column:
    """Sample variance, null for fewer than two."""
    return F.when(F.count(x) > 1, F.var_samp(x))


def VAR_P(x: Column) -> Column:
    """Population variance."""
    return F.var_pop(x)


def SUMSQ(x: Column, mode: str = COMPAT) -> Column:
    """Sum of squares; COMPAT squares the sum of a range."""
    return F.pow(SUM(x), F.lit(2.0)) if mode == COMPAT else F.coalesce(F.sum(x * x), F.lit(0.0))


def GEOMEAN(x: Column, mode: str = COMPAT) -> Column:
    """Geometric mean; COMPAT takes a range as the one number that is its sum."""
    return SUM(x) if mode == COMPAT else F.exp(F.avg(F.ln(x)))


def HARMEAN(x: Column, mode: str = COMPAT) -> Column:
    """Harmonic mean; COMPAT gives the reciprocal of a range's sum."""
    return F.try_divide(F.lit(1.0), SUM(x)) if mode == COMPAT else F.try_divide(F.count(x).cast("double"), F.sum(F.try_divide(F.lit(1.0), x)))


def DEVSQ(x: Column) -> Column:
    """Sum of squared distances from the mean."""
    return F.var_pop(x) * F.count(x)


def SKEW(x: Column) -> Column:
    """Sample skewness, null for fewer than three."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def SKEW_P(x: Column) -> Column:
    """Population skewness, null for fewer than three."""
    return F.when(F.count(x) >= 3, F.skewness(x))


def KURT(x: Column) -> Column:
    """Sample excess kurtosis, null for fewer than four."""
    n = F.count(x).cast("double")
    return F.when(n >= 4, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def PERCENTILE(x: Column, k: float) -> Column:
    """Inclusive interpolated percentile."""
    return F.percentile(x, k)


def QUARTILE(x: Column, q: int) -> Column:
    """Inclusive quartile."""
    return F.percentile(x, q / 4)


def PERCENTILE_EXC(x: Column, k: float) -> Column:
    """Exclusive percentile: the inclusive one at a shifted place, null outside 1/(n+1) to n/(n+1)."""
    n = F.count(x).cast("double")
    rank = k * (n + 1)
    values = F.sort_array(F.collect_list(x))
    low = F.floor(rank).cast("int")
    a, b = F.get(values, low - 1), F.get(values, low)
    return F.when((rank >= 1) & (rank <= n), a + F.coalesce((b - a) * (rank - low), F.lit(0.0)))


def AND(x: Column) -> Column:
    """Whether all hold."""
    return F.bool_and(x)


def OR(x: Column) -> Column:
    """Whether any holds."""
    return F.bool_or(x)


def XOR(x: Column) -> Column:
    """Whether an odd number hold."""
    return F.sum(x.cast("int")) % 2 == 1


def TEXTJOIN(delimiter: str, x: Column, position: Column) -> Column:
    """Texts of a group by position."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), x.alias("x")))), lambda s: s["x"]), delimiter)


# Two columns; pairs count only where both are numbers.


def _pair(f):
    return lambda y, x: f(F.when(x.isNotNull(), y), F.when(y.isNotNull(), x))


CORREL = PEARSON = _pair(F.corr)
COVAR = COVARIANCE_P = _pair(F.covar_pop)
COVARIANCE_S = _pair(F.covar_samp)
SLOPE = _pair(F.regr_slope)
INTERCEPT = _pair(F.regr_intercept)
RSQ = _pair(lambda y, x: F.pow(F.corr(y, x), F.lit(2.0)))
SUMX2MY2 = _pair(lambda x, y: F.sum(x * x - y * y))
SUMX2PY2 = _pair(lambda x, y: F.sum(x * x + y * y))
SUMXMY2 = _pair(lambda x, y: F.sum((x - y) * (x - y)))


def FORECAST(at: float, y: Column, x: Column) -> Column:
    """Value of the regression line."""
    return INTERCEPT(y, x) + SLOPE(y, x) * at


def SUMPRODUCT(*xs: Column) -> Column:
    """Sum of the products of columns; what is no number counts as 0."""
    out = F.lit(1.0)
    for x in xs:
        out = out * F.coalesce(x, F.lit(0.0))
    return F.coalesce(F.sum(out), F.lit(0.0))


#: SUBTOTAL's codes; 100 more means the same.
SUBTOTALS = {1: AVERAGE, 2: COUNT, 3: COUNTA, 4: MAX, 5: MIN, 6: PRODUCT, 7: STDEV, 8: STDEV_P, 9: SUM, 10: VAR, 11: VAR_P}


def SUBTOTAL(code: int, x: Column) -> Column:
    """An aggregate by code."""
    return SUBTOTALS[code % 100](x)


def _top(x: Column, k: int, largest: bool) -> Column:
    every = F.sort_array(F.collect_list(x), asc=not largest)
    return F.slice(every, 1, k)


def LARGE(x: Column, k: int) -> Column:
    """k-th largest, null (#NUM!) where there are fewer. For whole tables use operators.ranking.top_k."""
    return F.get(_top(x, k, True), F.lit(k - 1))


def SMALL(x: Column, k: int) -> Column:
    """k-th smallest, null (#NUM!) where there are fewer."""
    return F.get(_top(x, k, False), F.lit(k - 1))


#: AGGREGATE's codes beyond SUBTOTAL's.
ORDERED = {14: LARGE, 15: SMALL, 16: PERCENTILE, 17: QUARTILE, 18: PERCENTILE_EXC, 19: lambda x, q: PERCENTILE_EXC(x, q / 4)}


def AGGREGATE(code: int, option: int, x: Column, err: Column | None = None, k: float | None = None) -> Column:
    """An aggregate by code; options 2, 3, 6 and 7 leave cells with errors out (others propagate through the error lane)."""
    used = F.when(err.isNull(), x) if err is not None and option in (2, 3, 6, 7) else x
    if code == 12:
        return MEDIAN(used)
    return SUBTOTALS[code](used) if code in SUBTOTALS else ORDERED[code](used, k)



STDEV_S, STDEVP = STDEV, STDEV_P
VAR_S, VARP = VAR, VAR_P
PERCENTILE_INC, QUARTILE_INC = PERCENTILE, QUARTILE
