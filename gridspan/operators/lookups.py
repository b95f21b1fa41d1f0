"""Lookups as joins: a column of lookups is one join, never a scan for each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.functions.core import NA, VALUE

from .criteria import glob

#: Rows of a lookup table up to which it is broadcast, and their bytes; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 << 20


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The table, marked for broadcast if it is proved small in rows and bytes: the count stops at the bound."""
    width = F.lit(0).cast("long")
    for field in table.schema.fields:
        cell, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("struct", "array", "map"):
            cell, kind = F.to_json(F.struct(cell)), "string"
        width = width + (F.coalesce(F.octet_length(cell), F.lit(0)) if kind in ("string", "binary") else 16)
    n, held = table.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(table) if n <= rows and held <= size else table


def first_match(table: DataFrame, key: str, fields: list[str], position: str | None) -> DataFrame:
    """One row a key: the first by position, or the smallest fields where rows have no order."""
    order = F.struct(position) if position else F.struct(*fields)
    picked = table.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("hit"))
    return picked.select(F.col(key).alias("lookup_key"), *(F.col(f"hit.{f}").alias(f) for f in fields), F.lit(True).alias("lookup_hit"))


def exact(df: DataFrame, on: str, table: DataFrame, key: str, fields: list[str], position: str | None = None, miss: str = NA, broadcast: bool = True) -> DataFrame:
    """df with the fields of the first row of equal key, and `err` where there is none."""
    hits = first_match(table, key, fields, position)
    hits = bounded(hits) if broadcast else hits
    out = df.join(hits, F.col(on) == F.col("lookup_key"), "left")
    return out.withColumn("err", F.when(F.col("lookup_hit").isNull(), miss)).drop("lookup_key", "lookup_hit")


def vlookup(df: DataFrame, on: str, table: DataFrame, key: str, field: str, position: str | None = None) -> DataFrame:
    """Exact VLOOKUP (or HLOOKUP over a transposed table); a miss is #N/A."""
    return exact(df, on, table, key, [field], position, NA)


def blockref(df: DataFrame, on: str, block: DataFrame, key: str, field: str, position: str | None = None) -> DataFrame:
    """Keyed reference into a block; a miss is #VALUE!."""
    return exact(df, on, block, key, [field], position, VALUE)


def approximate(df: DataFrame, on: str, table: DataFrame, key: str, field: str, position: str | None = None, ranges: int = 1024) -> DataFrame:
    """df with the field of the largest key at or below each value, the first row of equal keys; #N/A below all keys.

    An as-of join by union and running last value over the distinct values, joined back to the rows. Both sides are dealt
    into at most `ranges` ranges of the key, so that no task holds all of them; what a range inherits is the last key of
    the ranges before it, one row a range.
    """
    extra = [position] if position and position not in (key, field) else []
    keys = first_match(table.filter(F.col(key).isNotNull()).select(key, field, *extra), key, [field], position)
    right = keys.select(F.col("lookup_key").cast("double").alias("k"), F.struct(F.lit(True).alias("found"), F.col(field).alias("v")).alias("hit"))
    cuts = sorted(set(right.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10_000).alias("b")).first()["b"] or []))
    slot = _slot(F.col("k"), cuts).alias("slot")
    right = right.select("k", slot, "hit")
    tails = right.groupBy("slot").agg(F.max_by("hit", "k").alias("hit"))
    spine = df.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("slot")).join(tails, "slot", "left")
    before = spine.select("slot", F.last("hit", True).over(Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    # each distinct value is looked up once, so a frequent one is one row of a range's window
    wanted = df.select(F.col(on).cast("double").alias("k")).filter("k is not null").distinct().select("k", slot)
    wanted = wanted.join(F.broadcast(before), "slot", "left")  # at most `ranges` rows
    merged = wanted.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(0)), allowMissingColumns=True)
    run = Window.partitionBy("slot").orderBy("k", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = merged.withColumn("hit", F.coalesce(F.last("hit", True).over(run), "before")).filter("side = 1").select(F.col("k").alias("_k"), F.col("hit").alias("_hit"))
    names = df.columns
    out = df.select(F.struct(*names).alias("row"), F.col(on).cast("double").alias("k")).join(answers, F.col("k") == F.col("_k"), "left")
    return out.select(*(F.col("row")[n].alias(n) for n in names), F.col("_hit.v").alias(field), F.when(F.col("_hit").isNull(), NA).alias("err"))


def _slot(c: Column, cuts: list) -> Column:
    """Number of cuts at or below a value."""
    return F.coalesce(F.size(F.filter(F.array(*(F.lit(float(x)) for x in cuts)), lambda b: b <= c)), F.lit(0)) if cuts else F.lit(0)


def wildcard(df: DataFrame, on: str, table: DataFrame, key: str, field: str, position: str) -> DataFrame:
    """Approximate lookup of text: the first row, by position, whose key matches the pattern.

    Each distinct pattern meets the keys once; the patterns are a bounded set of the formulas, checked.
    """
    patterns = [r[0] for r in df.select(on).filter(F.col(on).isNotNull()).distinct().limit(1001).collect()]
    if len(patterns) > 1000:
        raise ValueError("more than 1000 distinct patterns: join on exact keys instead")
    hits = table.agg(*(F.min_by(F.struct(F.col(field).alias("v")), F.when(F.col(key).rlike(glob(p)), F.col(position))).alias(f"h{i}") for i, p in enumerate(patterns)))
    if not patterns:
        return df.withColumn(field, F.lit(None).cast(table.schema[field].dataType)).withColumn("err", F.lit(NA))
    rows = hits.select(F.explode(F.array(*(F.struct(F.lit(p).alias("lookup_key"), F.col(f"h{i}").alias("hit")) for i, p in enumerate(patterns)))).alias("x")).select("x.*")
    out = df.join(F.broadcast(rows), F.col(on) == F.col("lookup_key"), "left")
    return out.withColumn(field, F.col("hit.v")).withColumn("err", F.when(F.col("hit").isNull(), NA)).drop("lookup_key", "hit")


def match(table: DataFrame, key: str, position: str, value: object, kind: int = 1) -> DataFrame:
    """Position of a value: 0 equal (text without case, with wildcards), 1 the largest at or below, -1 the smallest at or above.

    A later tie wins for 1 and -1. One row; null is #N/A.
    """
    k, p = F.col(key), F.col(position)
    if kind == 0:
        test = F.lower(k).rlike(glob(value.lower())) if isinstance(value, str) else k == value
        return table.agg(F.min(F.when(test, p)).alias("position"))
    test = k <= value if kind == 1 else k >= value
    order = F.struct(k, p) if kind == 1 else F.struct(-k, p)
    return table.agg(F.max_by(F.when(test, p), F.when(test, order)).alias("position"))


def index(cells: DataFrame, row: int, column: int) -> DataFrame:
    """INDEX over a long relation (r, c, value), 1-based; 0 stands for all rows or columns."""
    out = cells
    out = out.filter(F.col("r") == row - 1) if row else out
    return out.filter(F.col("c") == column - 1) if column else out


def indirect(cells: DataFrame, refs: DataFrame, ref: str) -> DataFrame:
    """refs with the value of the cell that an A1 or R1C1 text names: a join on (r, c)."""
    a1, rc = r"^\$?([A-Za-z]{1,3})\$?([0-9]+)$", r"^[Rr]([0-9]+)[Cc]([0-9]+)$"
    letters = F.upper(F.regexp_extract(ref, a1, 1))
    number = F.aggregate(F.filter(F.split(letters, ""), lambda s: s != ""), F.lit(0), lambda n, s: n * 26 + F.ascii(s) - 64)
    r = F.when(F.col(ref).rlike(rc), F.regexp_extract(ref, rc, 1).try_cast("int")).otherwise(F.regexp_extract(ref, a1, 2).try_cast("int")) - 1
    c = F.when(F.col(ref).rlike(rc), F.regexp_extract(ref, rc, 2).try_cast("int")).otherwise(number) - 1
    return refs.withColumns({"r": r, "c": c}).join(cells.select("r", "c", "value"), ["r", "c"], "left").withColumn("err", F.when(F.col("r").isNull(), "#REF!"))


def offset(cells: DataFrame, r: int, c: int, rows: int, columns: int, height: int = 1, width: int = 1) -> DataFrame:
    """OFFSET: the rectangle shifted and resized, as a filter."""
    return cells.filter(F.col("r").between(r + rows, r + rows + height - 1) & F.col("c").between(c + columns, c + columns + width - 1))


def transposed(cells: DataFrame) -> DataFrame:
    """A long relation with rows and columns exchanged: HLOOKUP is VLOOKUP of it."""
    return cells.select(F.col("c").alias("r"), F.col("r").alias("c"), "value")


def extent(cells: DataFrame) -> DataFrame:
    """First row and column (1-based), and counts of rows and columns, of a range: ROW, COLUMN, ROWS, COLUMNS."""
    return cells.agg((F.min("r") + 1).alias("row"), (F.min("c") + 1).alias("column"), (F.max("r") - F.min("r") + 1).alias("rows"), (F.max("c") - F.min("c") + 1).alias("columns"))
