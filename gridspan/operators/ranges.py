"""Reference operators over rectangles of a long relation: hull, intersection, union."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.functions.core import NULL, VALUE


@dataclass(frozen=True)
class Range:
    """A rectangle of a sheet, 0-based with both ends inside."""

    sheet: str
    r0: int
    c0: int
    r1: int
    c1: int

    def holds(self) -> Column:
        """Whether a cell lies in it."""
        return (F.col("sheet") == self.sheet) & F.col("r").between(self.r0, self.r1) & F.col("c").between(self.c0, self.c1)

    def of(self, cells: DataFrame) -> DataFrame:
        """Its cells."""
        return cells.filter(self.holds())


def hull(a: Range, b: Range) -> Range | str:
    """The bounding rectangle; of two sheets it is #VALUE!."""
    if a.sheet != b.sheet:
        return VALUE
    return Range(a.sheet, min(a.r0, b.r0), min(a.c0, b.c0), max(a.r1, b.r1), max(a.c1, b.c1))


def intersection(a: Range, b: Range) -> Range | str:
    """The common rectangle; disjoint ones give #NULL!."""
    out = Range(a.sheet, max(a.r0, b.r0), max(a.c0, b.c0), min(a.r1, b.r1), min(a.c1, b.c1))
    return out if a.sheet == b.sheet and out.r0 <= out.r1 and out.c0 <= out.c1 else NULL


def union(cells: DataFrame, ranges: list[Range]) -> DataFrame:
    """The cells of all ranges, those in several as often: one scan, each cell repeated by its count."""
    times = reduce(lambda a, b: a + b, (F.coalesce(r.holds().cast("int"), F.lit(0)) for r in ranges))
    return cells.withColumn("_n", times).filter("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_i")


def sheets_between(cells: DataFrame, order: list[str], first: str, last: str) -> DataFrame:
    """Cells of the sheets from one to another (a cube reference)."""
    a, b = sorted((order.index(first), order.index(last)))
    return cells.filter(F.col("sheet").isin(order[a : b + 1]))


def zipped(cells: DataFrame, a: Range, b: Range) -> DataFrame:
    """(r, c, a, b): values at equal offsets of two ranges; only the overlap, nothing is broadcast along an axis."""
    left = a.of(cells).select((F.col("r") - a.r0).alias("r"), (F.col("c") - a.c0).alias("c"), F.col("value").alias("a"))
    right = b.of(cells).select((F.col("r") - b.r0).alias("r"), (F.col("c") - b.c0).alias("c"), F.col("value").alias("b"))
    return left.join(right, ["r", "c"])
