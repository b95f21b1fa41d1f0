"""Conditional-format and validation rules as Columns: each rule is a predicate or a position, evaluated in one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules a cell can carry in its bit mask.
MOST_RULES = 53


def cell_is(x: Column, op: str, a: object, b: object = None) -> Column:
    """Comparison of a cell: = <> < <= > >= between notBetween containsText notContains beginsWith endsWith."""
    text = x.cast("string")
    tests = {
        "=": lambda: x == a, "<>": lambda: x != a, "<": lambda: x < a, "<=": lambda: x <= a, ">": lambda: x > a, ">=": lambda: x >= a,
        "between": lambda: (x >= a) & (x <= b), "notBetween": lambda: ~((x >= a) & (x <= b)),
        "containsText": lambda: F.contains(F.lower(text), F.lower(F.lit(a))), "notContains": lambda: ~F.contains(F.lower(text), F.lower(F.lit(a))),
        "beginsWith": lambda: text.startswith(a), "endsWith": lambda: text.endswith(a),
    }
    return F.coalesce(tests[op](), F.lit(False))


def blanks(x: Column) -> Column:
    """Whether a cell shows nothing."""
    return x.isNull() | (F.length(x.cast("string")) == 0)


def duplicates(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with whether the value occurs more than once: a grouped count and a join, without a window over hot values."""
    many = df.filter(F.col(x).isNotNull()).groupBy(x).count().select(F.col(x).alias("_x"), (F.col("count") > 1).alias(out))
    return df.join(many, F.col(x) == F.col("_x"), "left").drop("_x").withColumn(out, F.coalesce(out, F.lit(False)))


def top(df: DataFrame, x: str, n: float, out: str, percent: bool = False, bottom: bool = False) -> DataFrame:
    """df with whether the value is among the n (or n percent) largest or smallest, ties at the threshold included."""
    from .ranking import top_k

    if percent:
        rows = df.select(F.count(x)).first()[0]
        n = -(-rows * n // 100)
    n = int(n)
    found = df.select(F.count(x)).first()[0]
    threshold = top_k(df, x, max(1, min(n, found)), largest=not bottom).first()["value"] if found and n > 0 else None
    if threshold is None:
        return df.withColumn(out, F.lit(False))
    return df.withColumn(out, F.coalesce(F.col(x) <= threshold if bottom else F.col(x) >= threshold, F.lit(False)))


def above_average(df: DataFrame, x: str, out: str, below: bool = False, equal: bool = False, deviations: float = 0.0) -> DataFrame:
    """df with whether the value lies above (below) the mean, or so many population deviations off it: one aggregate row joined."""
    sign = -1 if below else 1
    edge = df.agg((F.avg(x) + sign * deviations * F.coalesce(F.stddev_pop(x), F.lit(0.0))).alias("_edge"))
    c, e = F.col(x), F.col("_edge")
    test = (c <= e if equal else c < e) if below else (c >= e if equal else c > e)
    return df.crossJoin(F.broadcast(edge)).withColumn(out, F.coalesce(test, F.lit(False))).drop("_edge")  # one row


def time_period(x: Column, period: str, today: Column | None = None) -> Column:
    """Whether a date lies in a period about today; weeks start on Monday."""
    t = F.current_date() if today is None else today
    month = lambda k: F.trunc(F.add_months(t, k), "month")
    week = lambda k: F.date_add(F.trunc(t, "week"), 7 * k)
    spans = {
        "today": (t, F.date_add(t, 1)), "yesterday": (F.date_sub(t, 1), t), "tomorrow": (F.date_add(t, 1), F.date_add(t, 2)), "last7Days": (F.date_sub(t, 6), F.date_add(t, 1)),
        "thisWeek": (week(0), week(1)), "lastWeek": (week(-1), week(0)), "nextWeek": (week(1), week(2)),
        "thisMonth": (month(0), month(1)), "lastMonth": (month(-1), month(0)), "nextMonth": (month(1), month(2)),
    }
    low, high = spans[period]
    return F.coalesce((x >= low) & (x < high), F.lit(False))


def position(x: Column, low: Column, high: Column) -> Column:
    """Place of a value between two bounds, 0 to 1, for data bars and color scales."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - low).cast("double"), (high - low).cast("double")), F.lit(0.0)))))


def scaled(df: DataFrame, x: str, out: str, low: str = "min", high: str = "max", low_at: float = 0, high_at: float = 100) -> DataFrame:
    """df with the place of each value between bounds that are min, max, num, percent or percentile of the column."""

    def bound(kind: str, at: float) -> Column:
        return {"min": F.min(x), "max": F.max(x), "num": F.lit(float(at)), "percent": F.min(x) + (F.max(x) - F.min(x)) * at / 100, "percentile": F.percentile(x, at / 100)}[kind]

    edges = df.agg(bound(low, low_at).alias("_low"), bound(high, high_at).alias("_high"))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, position(F.col(x), F.col("_low"), F.col("_high"))).drop("_low", "_high")  # one row


def icon(place: Column, thresholds: list[float]) -> Column:
    """Number of the icon of a place: how many thresholds it reaches."""
    return sum(((place >= t).cast("int") for t in thresholds), F.lit(0))


def color(place: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """#rrggbb between color stops at places 0 to 1."""

    def channel(i: int) -> Column:
        out = F.lit(float(stops[-1][1][i]))
        for (p, a), (q, b) in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(place <= q, a[i] + (b[i] - a[i]) * (place - p) / ((q - p) or 1)).otherwise(out)
        return F.lpad(F.lower(F.hex(F.round(F.greatest(F.lit(0.0), out)).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(1), channel(2))


def mask(rules: list[tuple[Column, bool]]) -> Column:
    """Bits of the rules that apply, by priority; a rule that stops hides later ones."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out, stopped = F.lit(0).cast("long"), F.lit(False)
    for i, (test, stops) in enumerate(rules):
        hit = F.coalesce(test, F.lit(False)) & ~stopped
        out = out + F.when(hit, F.lit(1 << i).cast("long")).otherwise(F.lit(0))
        stopped = stopped | hit if stops else stopped
    return out


# Validation.


def in_list(x: Column, values: list) -> Column:
    """One of the listed values."""
    return reduce(lambda a, b: a | b, (F.coalesce(x == v, F.lit(False)) for v in values), F.lit(False))


def not_in_table(df: DataFrame, x: str, source: DataFrame, column: str) -> DataFrame:
    """Rows whose value no row of the source has: list validation and foreign keys as an anti join."""
    return df.filter(F.col(x).isNotNull()).join(source.select(F.col(column).alias(x)), x, "left_anti")


def valid(x: Column, kind: str, op: str, a: object, b: object = None) -> Column:
    """whole, decimal, date, time and textLength rules."""
    n = F.length(x.cast("string")) if kind == "textLength" else x.try_cast("double") if kind in ("whole", "decimal", "time") else x
    test = cell_is(n, op, a, b)
    if kind == "whole":
        test = test & F.coalesce(F.floor(n) == n, F.lit(False))
    return test & n.isNotNull()


def field_checks(df: DataFrame, key: str, x: str, ordinal: str, required: bool = False, unique: bool = False, members: DataFrame | None = None) -> DataFrame:
    """(key, status): the first failing check of each row among required, unique (later copies only) and membership."""
    out = df.select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(ordinal).alias("o"))
    status = F.when(blanks(F.col("x")), "required") if required else F.lit(None).cast("string")
    if unique:
        firsts = out.filter(F.col("x").isNotNull()).groupBy("x").agg(F.min("o").alias("first"))
        out = out.join(firsts, "x", "left")
        status = F.coalesce(status, F.when(F.col("o") > F.col("first"), "unique"))
    if members is not None:
        known = members.toDF("x").distinct().withColumn("known", F.lit(True))
        out = out.join(known, "x", "left")
        status = F.coalesce(status, F.when(F.col("x").isNotNull() & F.col("known").isNull(), "membership"))
    return out.select("key", status.alias("status")).filter(F.col("status").isNotNull())


