"""Ranks, order statistics and filled-down formulas as window functions; whole-table order statistics without one big window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.functions.core import NUM, VALUE


#: Ranges that an ordered column is cut into, so that no task runs through all of its rows.
PARTS = 200


def cumulative(df: DataFrame, value: str, order: str, out: str, by: list[str] | None = None, descending: bool = False, parts: int = PARTS, ties: list[str] | None = None) -> DataFrame:
    """df with the running sum of a column along a numeric order, within groups or over the whole table.

    Rows are cut into ranges of the order; a window runs inside each range of a group and starts at the sum of the ranges
    before it. Rows that tie in the order follow the columns `ties`; without them their order among themselves is not determined.
    """
    by = by or []
    place = F.col(order).cast("double")
    cuts = sorted(set(df.agg(F.percentile_approx(place, [i / parts for i in range(1, parts)], 10_000).alias("b")).first()["b"] or []))
    slot = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= place)), F.lit(0)) if cuts else F.lit(0)
    rows = df.withColumn("_slot", -slot if descending else slot)
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_slot").agg(F.sum(value).alias("_s"))
    before = sums.select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)), F.col("_slot").alias("_at"), F.sum("_s").over(earlier).alias("_before"))
    on = F.col("_slot") == F.col("_at")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*by, "_slot").orderBy(F.col(order).desc() if descending else F.col(order).asc(), *(ties or []))
    run = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = rows.join(before if by else F.broadcast(before), on)  # without groups at most `parts` rows
    return joined.withColumn(out, F.coalesce("_before", F.lit(0)) + run).drop("_slot", "_at", "_before", *(f"_k{i}" for i in range(len(by))))


def rank_of(df: DataFrame, x: str, out: str, descending: bool = True, average: bool = False, by: list[str] | None = None) -> DataFrame:
    """RANK or RANK.AVG of every row within its group.

    Ranks come from running counts of the distinct values, joined back to the rows.
    """
    by = by or []
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    rank = F.col("_upto") - F.col("_n") + 1 + ((F.col("_n") - 1) / 2 if average else 0)
    ranked = cumulative(counts, "_n", x, "_upto", by, descending).select(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), F.col(x).alias("_x"), rank.cast("double" if average else "long").alias(out))
    on = F.col(x) == F.col("_x")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    return df.join(ranked, on, "left").drop("_x", *(f"_b{i}" for i in range(len(by))))


def rank_value(df: DataFrame, x: str, value: float, descending: bool = True, average: bool = False) -> DataFrame:
    """RANK of one value: counts only. One row (value, err); a value that is not there is #VALUE!."""
    c = F.col(x)
    same = F.abs(c - value) < 1e-6
    ahead = F.count(F.when(~same & ((c > value) if descending else (c < value)), 1))
    equal = F.count(F.when(same, 1))
    rank = ahead + 1 + ((equal - 1) / 2 if average else 0)
    return df.agg(F.when(equal > 0, rank.cast("double")).alias("value"), F.when(equal == 0, VALUE).alias("err"))


def top_k(df: DataFrame, x: str, k: int, largest: bool = True) -> DataFrame:
    """LARGE or SMALL of a whole table: Spark's bounded top-k, then the last of it. One row (value, err)."""
    order = F.col(x).desc() if largest else F.col(x).asc()
    first = df.filter(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v")).orderBy(order if x == "v" else (F.col("v").desc() if largest else F.col("v").asc())).limit(max(k, 0))
    n = F.count("*")
    return first.agg(F.when(n == k, F.min("v") if largest else F.max("v")).alias("value"), F.when((n < k) | F.lit(k < 1), NUM).alias("err"))


def percent_rank(df: DataFrame, x: str, value: float, digits: int = 3) -> DataFrame:
    """PERCENTRANK.INC of one value: interpolated between its neighbours, cut to so many digits. One row."""
    c = F.col(x)
    below, equal, n = F.count(F.when(c < value, 1)), F.count(F.when(c == value, 1)), F.count(c)
    low, high = F.max(F.when(c <= value, c)), F.min(F.when(c >= value, c))
    exact = F.try_divide(below.cast("double"), n - 1)
    low_rank = F.try_divide((below - 1).cast("double"), n - 1)
    # the rank of the lower neighbour is that of its first copy
    between = F.try_divide((below - 1).cast("double") + F.try_divide(value - low, high - low), n - 1)
    rank = F.when(equal > 0, F.when(n == 1, 1.0).otherwise(exact)).otherwise(F.coalesce(between, low_rank))
    cut = F.floor(rank * 10**digits + 1e-9) / 10**digits
    return df.agg(F.when(low.isNotNull() & high.isNotNull(), cut).alias("value"), F.when(low.isNull() | high.isNull(), "#N/A").alias("err"))


def trim_mean(df: DataFrame, x: str, share: float, by: list[str]) -> DataFrame:
    """TRIMMEAN of each group: whole counts off both ends, by the running count of distinct values."""
    c = F.col(x)
    counts = df.filter(c.isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total")).withColumnsRenamed({b: f"_g{i}" for i, b in enumerate(by)})
    on = F.lit(True)
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    rows = cumulative(counts, "_n", x, "_upto", by).join(totals, on)
    cut = F.floor(F.col("_total") * share / 2)
    left = F.greatest(F.lit(0), F.least(F.col("_upto"), F.col("_total") - cut) - F.greatest(F.col("_upto") - F.col("_n"), cut))
    return rows.withColumn("_w", left).groupBy(*by).agg(F.try_divide(F.sum(c * F.col("_w")), F.sum("_w").cast("double")).alias("value"))


def mode_of(df: DataFrame, x: str, position: str, by: list[str]) -> DataFrame:
    """MODE of each group: the most frequent value, the first seen of equals."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"), F.min(position).alias("_p"))
    return counts.groupBy(*by).agg(F.max_by(x, F.struct(F.col("_n"), -F.col("_p"))).alias("value"))


def mean_deviation(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """AVEDEV of each group: two aggregates and a join on the group, without a window over its rows."""
    means = df.groupBy(*by).agg(F.avg(x).alias("_m")) if by else df.agg(F.avg(x).alias("_m"))
    joined = df.join(means, by) if by else df.crossJoin(F.broadcast(means))  # one row
    return joined.groupBy(*by).agg(F.avg(F.abs(F.col(x) - F.col("_m"))).alias("value"))


# Formulas filled down a column: relative references become frames.


def filled(by: list[str], order: list[str]) -> Window:
    """The window that rows of a fill run through."""
    return Window.partitionBy(*by).orderBy(*order)


def previous(x: str, by: list[str], order: list[str], k: int = 1) -> Column:
    """The cell k rows above."""
    return F.lag(x, k).over(filled(by, order))


def following(x: str, by: list[str], order: list[str], k: int = 1) -> Column:
    """The cell k rows below."""
    return F.lead(x, k).over(filled(by, order))


def running(aggregate: Column, by: list[str], order: list[str]) -> Column:
    """An aggregate from the first row to this one, as =SUM(A$1:A5)."""
    return aggregate.over(filled(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def sliding(aggregate: Column, by: list[str], order: list[str], back: int) -> Column:
    """An aggregate of this row and so many above it."""
    return aggregate.over(filled(by, order).rowsBetween(-back, Window.currentRow))


def occurrence(by: list[str], order: list[str]) -> Column:
    """How often the key occurred so far, as =COUNTIF(A$1:A5,A5)."""
    return F.row_number().over(filled(by, order))


#: Rows of a key that are folded as one array.
BLOCK = 1000


def recurrence(df: DataFrame, by: list[str], order: str, start: float, factor: str, addend: str, out: str, block: int = BLOCK) -> DataFrame:
    """X[r] = factor[r] * X[r-1] + addend[r] within each key.

    Affine steps compose, so a long key is cut into blocks of rows: each block is one affine step itself, the same
    recurrence over these steps gives the value that enters each block, and only blocks are folded row by row.
    """
    rows = df.select(*by, F.col(order).alias("_o"), F.col(factor).cast("double").alias("_a"), F.col(addend).cast("double").alias("_b"))
    ends = _ends(rows, by, start, block)
    return ends.select(*by, F.col("_o").cast(df.schema[order].dataType).alias(order), F.col("_x").alias(out))


def _ends(rows: DataFrame, by: list[str], start: float, block: int) -> DataFrame:
    """rows (by, _o, _a, _b) with the value _x after each step."""
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most <= block:
        return _folded(_blocks(rows.withColumn("_block", F.lit(0).cast("long")), by).withColumn("_x0", F.lit(float(start))), by)
    place = F.col("_o").cast("double")
    # ranges of the order first, so that no window holds all rows of a key, then blocks of rows in each range; a key has
    # far fewer blocks than rows, so the rounds end
    parts = min(PARTS, most // (4 * block))
    cuts = sorted(set(rows.agg(F.percentile_approx(place, [i / parts for i in range(1, parts)], 10_000).alias("b")).first()["b"] or [])) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= place)).cast("long") if cuts else F.lit(0).cast("long")
    inside = Window.partitionBy(*by, "_part").orderBy("_o", "_a", "_b")
    number = F.floor((F.row_number().over(inside) - 1) / block)
    blocks = _blocks(rows.withColumn("_part", F.coalesce(part, F.lit(-1).cast("long"))).withColumn("_block", F.col("_part") * (1 << 40) + number), by)
    step = lambda acc, r: F.struct((acc["a"] * r["a"]).alias("a"), (acc["b"] * r["a"] + r["b"]).alias("b"))
    whole = blocks.select(*by, F.col("_block").alias("_o"), F.aggregate("_s", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), step).alias("_w")).select(*by, "_o", F.col("_w.a").alias("_a"), F.col("_w.b").alias("_b"))
    after = _ends(whole, by, start, block)
    entering = after.select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)), F.col("_o").alias("_at"), F.lag("_x", 1, float(start)).over(Window.partitionBy(*by).orderBy("_o")).alias("_x0"))
    on = F.col("_block") == F.col("_at")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    return _folded(blocks.join(entering, on), by)


def _blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row a block with its steps in order, at most a block's rows."""
    return rows.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_a").alias("a"), F.col("_b").alias("b")))).alias("_s"))


def _folded(blocks: DataFrame, by: list[str]) -> DataFrame:
    """The steps of each block run from the value that enters it."""
    kind = blocks.schema["_s"].dataType.elementType["o"].dataType.simpleString()
    reached = F.aggregate(
        "_s",
        F.struct(F.col("_x0").alias("x"), F.array().cast(f"array<struct<o:{kind},x:double>>").alias("out")),
        lambda acc, r: F.struct((acc["x"] * r["a"] + r["b"]).alias("x"), F.concat(acc["out"], F.array(F.struct(r["o"].alias("o"), (acc["x"] * r["a"] + r["b"]).alias("x")))).alias("out")),
        lambda acc: acc["out"],
    )
    return blocks.select(*by, F.explode(reached).alias("_e")).select(*by, F.col("_e.o").alias("_o"), F.col("_e.x").alias("_x"))
