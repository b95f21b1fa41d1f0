"""Spans of pattern matches as Columns: what stands between matches gives their places, in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters before a match that labelers may read.
CONTEXT = 40
TYPE = "array<struct<start:int,stop:int,match:string,before:string>>"


def found(text: Column, pattern: str, needs: Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, stop, match, before>>; where `needs` fails there is none."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, F.lit(pattern), -1)
    gaps = F.zip_with(matches, between, lambda m, gap: F.struct(m.alias("m"), F.coalesce(F.length(gap), F.lit(0)).alias("gap"), F.coalesce(F.right(gap, F.lit(CONTEXT)), F.lit("")).alias("before")))
    # zip_with pads the shorter side: the text after the last match has no match of its own
    gaps = F.filter(gaps, lambda g: g["m"].isNotNull())
    placed = F.aggregate(
        gaps,
        F.struct(F.lit(0).alias("at"), F.array().cast(TYPE).alias("out")),
        lambda acc, g: F.struct(
            (acc["at"] + g["gap"] + F.length(g["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + g["gap"]).alias("start"), (acc["at"] + g["gap"] + F.length(g["m"])).alias("stop"), g["m"].alias("match"), g["before"].alias("before")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(needs, placed).otherwise(F.array().cast(TYPE))


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    return F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")),
        lambda acc, c: F.struct(
            (acc["i"] + 1).alias("i"),
            (acc["s"] + F.when(acc["i"] % 2 == 0, F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(F.coalesce(F.floor(c.try_cast("int") * 2 / 10).cast("int") + c.try_cast("int") * 2 % 10, F.lit(0)))).alias("s"),
        ),
        lambda acc: acc["s"] % 10 == 0,
    )
