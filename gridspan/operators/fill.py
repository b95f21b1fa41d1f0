"""Autofill, goal seek and what-if scenarios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fill(spark: SparkSession, pattern: list, rows: int, start: int = 0) -> DataFrame:
    """(ordinal, value) continued from a pattern: numbers go on in a line from the first to the last, other values repeat."""
    n = len(pattern)
    line = spark.range(start, start + rows).withColumnRenamed("id", "ordinal")
    at = F.col("ordinal") - start
    if n >= 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in pattern):
        step = (pattern[-1] - pattern[0]) / (n - 1)
        return line.withColumn("value", F.lit(float(pattern[-1])) + step * (at + 1))
    return line.withColumn("value", F.get(F.array(*map(F.lit, pattern)), (at % n).cast("int")))


def goal_seek(df: DataFrame, f: Callable[[Column], Column], target: Column | float, low: float, high: float, out: str, rounds: int = 60) -> DataFrame:
    """df with the input at which f meets the target, for every row at once: bisection as an in-row fold, null without a sign change."""
    goal = target if isinstance(target, Column) else F.lit(float(target))
    gap = lambda x: f(x) - goal
    start = F.struct(F.lit(float(low)).alias("a"), F.lit(float(high)).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["a"] + s["b"]) / 2
        left = F.signum(gap(s["a"])) * F.signum(gap(middle)) <= 0
        return F.struct(F.when(left, s["a"]).otherwise(middle).alias("a"), F.when(left, middle).otherwise(s["b"]).alias("b"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["a"] + s["b"]) / 2)
    return df.withColumn(out, F.when(F.signum(gap(F.lit(float(low)))) * F.signum(gap(F.lit(float(high)))) <= 0, root))


def what_if(df: DataFrame, scenarios: list[dict[str, float]], results: dict[str, Column]) -> DataFrame:
    """Results of each scenario's trial values, in one pass: rows are repeated for the scenarios in the row, not joined."""
    names = sorted({n for s in scenarios for n in s})
    kinds = {n: df.schema[n].dataType for n in names}
    trials = F.array(*(F.struct(F.lit(i).alias("scenario"), *(F.lit(s[n]).cast(kinds[n]).alias(n) if n in s else F.col(n).alias(n) for n in names)) for i, s in enumerate(scenarios)))
    kept = [c for c in df.columns if c not in names]
    rows = df.select(*kept, F.explode(trials).alias("_t")).select(*kept, "_t.scenario", *(F.col(f"_t.{n}").alias(n) for n in names))
    return rows.groupBy("scenario").agg(*(c.alias(n) for n, c in results.items()))
