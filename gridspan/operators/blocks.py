"""Blocks: keyed, schema-carrying tables registered by name, and what can be done to them.

A block is a DataFrame with a key column and an ordinal. Edits return new DataFrames; nothing is changed in place, so a
version is a plan and undo is a reference to the one before.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .criteria import condition, matches

ORDINAL = "ordinal"


@dataclass(frozen=True)
class Block:
    """A table with its name, key field, derived fields and checks."""

    name: str
    df: DataFrame
    key: str
    derived: dict[str, Column] = field(default_factory=dict)
    checks: dict[str, Column] = field(default_factory=dict)
    locks: dict[str, Column] = field(default_factory=dict)

    def view(self) -> DataFrame:
        """The rows with their derived fields, in the order in which these were given."""
        out = self.df
        for name, column in self.derived.items():
            out = out.withColumn(name, column)
        return out

    def describe(self) -> list[tuple[str, str]]:
        """Fields and types."""
        return self.view().dtypes

    def refs(self, key_condition: object = "*", fields: str = "*") -> DataFrame:
        """Rows whose key meets a condition, fields whose names meet a pattern (BLOCKREFS)."""
        from .criteria import glob
        import re

        view = self.view()
        names = [c for c in view.columns if c != ORDINAL and re.match(glob(fields), c)]
        is_text = dict(view.dtypes)[self.key] == "string"
        test = F.lit(True) if key_condition == "*" else matches(F.col(self.key), key_condition, is_text)
        return view.filter(test).select(*names)

    def ref(self, key: object, name: str) -> DataFrame:
        """One cell by key: one row (value, err), the first of equal keys; a miss is #VALUE!."""
        order = ORDINAL if ORDINAL in self.df.columns else name
        found = self.view().filter(F.col(self.key) == key).agg(F.min_by(name, order).alias("value"), F.count("*").alias("n"))
        return found.select("value", F.when(F.col("n") == 0, "#VALUE!").alias("err"))

    def export(self, keys: list | None = None, fields: list[str] | None = None) -> DataFrame:
        """Rows of some keys, some fields in schema order."""
        view = self.view()
        names = [c for c in view.columns if not fields or c in fields]
        return (view.filter(F.col(self.key).isin(keys)) if keys else view).select(*names)

    def where(self, pairs: dict[str, object]) -> DataFrame:
        """Rows that meet all criteria."""
        view = self.view()
        return view.filter(condition(view, pairs))

    # Edits.

    def set_cell(self, key: object, name: str, value: object) -> Block:
        """One field of the rows of a key."""
        at = F.col(self.key) == key
        return replace(self, df=self.df.withColumn(name, F.when(at, F.lit(value).cast(self.df.schema[name].dataType)).otherwise(F.col(name))))

    def upsert(self, rows: DataFrame) -> Block:
        """Rows of equal keys replaced, others added: an anti join and a union."""
        kept = self.df.join(rows.select(self.key), self.key, "left_anti").select(self.df.columns)
        return replace(self, df=kept.unionByName(rows, allowMissingColumns=True))

    def delete(self, keys: DataFrame) -> Block:
        """Without the rows of some keys."""
        return replace(self, df=self.df.join(keys.select(self.key), self.key, "left_anti").select(self.df.columns))

    def insert_lines(self, at: int, n: int) -> Block:
        """n blank lines at an ordinal; later ones move on."""
        moved = self.df.withColumn(ORDINAL, F.when(F.col(ORDINAL) >= at, F.col(ORDINAL) + n).otherwise(F.col(ORDINAL)))
        blank = self.df.sparkSession.range(at, at + n).select(F.col("id").cast(self.df.schema[ORDINAL].dataType).alias(ORDINAL))
        return replace(self, df=moved.unionByName(blank, allowMissingColumns=True))

    def delete_lines(self, at: int, n: int) -> Block:
        """Without n lines from an ordinal; later ones move up."""
        left = self.df.filter(~F.col(ORDINAL).between(at, at + n - 1))
        return replace(self, df=left.withColumn(ORDINAL, F.when(F.col(ORDINAL) >= at + n, F.col(ORDINAL) - n).otherwise(F.col(ORDINAL))))

    def move_line(self, source: int, target: int) -> Block:
        """One line to another place."""
        o = F.col(ORDINAL)
        between = F.when((source < target) & o.between(source + 1, target), o - 1).when(o.between(target, source - 1), o + 1).otherwise(o) if source != target else o
        return replace(self, df=self.df.withColumn(ORDINAL, F.when(o == source, target).otherwise(between).cast(self.df.schema[ORDINAL].dataType)))

    def reorder(self, permutation: DataFrame) -> Block:
        """Ordinals by a table (old, new)."""
        joined = self.df.join(permutation.withColumnsRenamed({"old": "_old", "new": "_new"}), F.col(ORDINAL) == F.col("_old"), "left")
        return replace(self, df=joined.withColumn(ORDINAL, F.coalesce("_new", ORDINAL)).select(self.df.columns))

    def resize(self, rows: int) -> Block:
        """The first so many lines, filled up with blank ones."""
        spine = self.df.sparkSession.range(rows).select(F.col("id").cast(self.df.schema[ORDINAL].dataType).alias(ORDINAL))
        return replace(self, df=spine.join(self.df, ORDINAL, "left").select(self.df.columns))

    def add_field(self, name: str, column: Column) -> Block:
        """A derived field."""
        return replace(self, derived={**self.derived, name: column})

    def drop_field(self, name: str) -> Block:
        """Without a field."""
        return replace(self, df=self.df.drop(name), derived={k: v for k, v in self.derived.items() if k != name})

    def rename(self, name: str) -> Block:
        """Under another name."""
        return replace(self, name=name)

    def sort(self, name: str, descending: bool = False) -> DataFrame:
        """Stable order by one field: blanks last either way, text without case, ties by ordinal."""
        c = F.lower(F.col(name)) if dict(self.view().dtypes)[name] == "string" else F.col(name)
        ties = [F.col(ORDINAL)] if ORDINAL in self.view().columns else [F.col(self.key)]
        return self.view().orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *ties)

    # Checks.

    def violations(self) -> DataFrame:
        """(key, field, status): a check that is false has failed, one that is null is fine."""
        view = self.view()
        out = F.array(*(F.when(~check, F.struct(F.lit(name).alias("field"), F.lit("failed").alias("status"))) for name, check in self.checks.items()))
        return view.select(F.col(self.key).alias("key"), F.explode(F.filter(out, lambda x: x.isNotNull())).alias("x")).select("key", "x.field", "x.status")

    def locked(self) -> DataFrame:
        """(key, field): cells whose editability rule is false."""
        out = F.array(*(F.when(~rule, F.lit(name)) for name, rule in self.locks.items()))
        return self.view().select(F.col(self.key).alias("key"), F.explode(F.filter(out, lambda x: x.isNotNull())).alias("field"))


class Catalog:
    """Blocks by name; lookups inside formulas go through it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.blocks: dict[str, Block] = {}

    def register(self, block: Block) -> Block:
        """Add or replace a block, and its temp view."""
        self.blocks[block.name] = block
        block.view().createOrReplaceTempView(block.name)
        return block

    def remove(self, name: str) -> None:
        """Drop a block and its view."""
        del self.blocks[name]
        self.spark.catalog.dropTempView(name)

    def __getitem__(self, name: str) -> Block:
        return self.blocks[name]

    def evaluate(self, expression: str, name: str) -> DataFrame:
        """An ad-hoc SQL expression over a block."""
        return self.blocks[name].view().selectExpr(f"{expression} AS value")


def from_cells(cells: DataFrame, fields: dict[int, str], by_rows: bool = True) -> DataFrame:
    """A wide block of a long relation (r, c, value); records are rows, or columns."""
    line, at = ("r", "c") if by_rows else ("c", "r")
    picked = cells.filter(F.col(at).isin(list(fields)))
    return picked.groupBy(F.col(line).alias(ORDINAL)).agg(*(F.max(F.when(F.col(at) == i, F.col("value"))).alias(n) for i, n in fields.items()))


def to_cells(df: DataFrame, fields: list[str]) -> DataFrame:
    """The long relation of a block with an ordinal."""
    cells = F.array(*(F.struct(F.lit(i).alias("c"), F.col(n).cast("string").alias("value")) for i, n in enumerate(fields)))
    return df.select(F.col(ORDINAL).alias("r"), F.explode(cells).alias("x")).select("r", "x.c", "x.value").filter(F.col("value").isNotNull())
