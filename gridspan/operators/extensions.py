"""Host functions computed once for each distinct argument, field templates, and navigation over occupied cells."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def memoised(df: DataFrame, arguments: list[str], f: Callable[[pd.DataFrame], pd.Series], out: str, kind: str) -> DataFrame:
    """df with a host function's result: computed for distinct arguments only, joined back. Nulls match nulls.

    f gets a frame of the arguments, a batch at a time, and returns one value a row.
    """
    distinct = df.select(*arguments).distinct()
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in distinct.schema), f"`{out}` {kind}"])

    def run(frames):
        for frame in frames:
            yield frame.assign(**{out: f(frame)})

    results = distinct.mapInPandas(run, schema).withColumnsRenamed({a: f"_a{i}" for i, a in enumerate(arguments)})
    on = F.lit(True)
    for i, a in enumerate(arguments):
        on = on & F.col(a).eqNullSafe(F.col(f"_a{i}"))
    return df.join(results, on, "left").drop(*(f"_a{i}" for i in range(len(arguments))))


def templates(df: DataFrame, fields: dict[str, Column], uses: dict[str, list[str]]) -> DataFrame:
    """df with derived fields, each after those it uses; a cycle is an error."""
    done, left = set(df.columns) - set(fields), dict(fields)
    while left:
        ready = [n for n in left if not set(uses.get(n, ())) & set(left)]
        if not ready:
            raise ValueError(f"fields use each other: {sorted(left)}")
        df = df.withColumns({n: left.pop(n) for n in ready})
        done |= set(ready)
    return df


def next_occupied(cells: DataFrame, along: str = "r") -> DataFrame:
    """(sheet, r, c, next, edge): the next occupied cell down (or right), and whether the cell ends a run."""
    across = "c" if along == "r" else "r"
    line = Window.partitionBy("sheet", across).orderBy(along)
    following = F.lead(along).over(line)
    return cells.select("sheet", "r", "c", following.alias("next"), F.coalesce(following != F.col(along) + 1, F.lit(True)).alias("edge"))


def neighbours(df: DataFrame, arguments: list[str], value: str, by: list[str], order: list[str]) -> DataFrame:
    """df with the value of the keyed row before and after, as keyed field references to neighbours give."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select(*arguments, F.lag(value).over(w).alias("before"), F.lead(value).over(w).alias("after"))
