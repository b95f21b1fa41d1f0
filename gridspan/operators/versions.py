"""Versions of a table of cells: an edit log, its state at any version, undo and redo, checkpoints, branches and diffs.

The log is a DataFrame (version, sheet, r, c, value); the state at a version is the latest entry of each cell. An undo
is a bound on the version, so it costs nothing; a checkpoint is a written state from which later states start.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["sheet", "r", "c"]
#: Versions that undo can go back, and checkpoints that are kept.
UNDO_DEPTH, CHECKPOINTS = 50, 20


def state_at(log: DataFrame, version: int, base: DataFrame | None = None, base_version: int = -1) -> DataFrame:
    """Cells (sheet, r, c, value) after a version: one aggregate; deletions are null values and do not show."""
    edits = log.filter((F.col("version") <= version) & (F.col("version") > base_version))
    if base is not None:
        edits = edits.select(*CELL, "value", "version").unionByName(base.select(*CELL, "value", F.lit(base_version).cast("long").alias("version")))
    latest = edits.groupBy(*CELL).agg(F.max_by("value", "version").alias("value"))
    return latest.filter(F.col("value").isNotNull())


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sheet, r, c, before, after, change) of cells that differ: added, removed or changed. A full join on the cell."""
    a, b = before.select(*CELL, F.col("value").alias("before")), after.select(*CELL, F.col("value").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return a.join(b, CELL, "full").filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", change)


def shift_insert(cells: DataFrame, sheet: str, at: int, n: int, rows: bool = True) -> DataFrame:
    """Cells with n rows (columns) inserted."""
    x = "r" if rows else "c"
    return cells.withColumn(x, F.when((F.col("sheet") == sheet) & (F.col(x) >= at), F.col(x) + n).otherwise(F.col(x)))


def shift_delete(cells: DataFrame, sheet: str, at: int, n: int, rows: bool = True) -> DataFrame:
    """Cells with n rows (columns) deleted."""
    x = "r" if rows else "c"
    own = F.col("sheet") == sheet
    kept = cells.filter(~(own & F.col(x).between(at, at + n - 1)))
    return kept.withColumn(x, F.when(own & (F.col(x) >= at + n), F.col(x) - n).otherwise(F.col(x)))


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(sheet, r, c, value, conflict) of two branches from one base; ours wins where both changed to different values."""
    j = base.select(*CELL, F.col("value").alias("v0")).join(ours.select(*CELL, F.col("value").alias("v1")), CELL, "full").join(theirs.select(*CELL, F.col("value").alias("v2")), CELL, "full")
    one, two = ~F.col("v1").eqNullSafe(F.col("v0")), ~F.col("v2").eqNullSafe(F.col("v0"))
    value: Column = F.when(one, F.col("v1")).otherwise(F.col("v2"))
    return j.select(*CELL, value.alias("value"), (one & two & ~F.col("v1").eqNullSafe(F.col("v2"))).alias("conflict")).filter(F.col("value").isNotNull() | F.col("conflict"))


@dataclass
class History:
    """A place in a log with undo and redo."""

    log: DataFrame
    version: int
    newest: int
    checkpoints: dict[str, int] = field(default_factory=dict)

    def undo(self) -> bool:
        """One version back, within UNDO_DEPTH of the newest."""
        if self.version < 0 or self.newest - self.version >= UNDO_DEPTH:
            return False
        self.version -= 1
        return True

    def redo(self) -> bool:
        """One version on."""
        if self.version >= self.newest:
            return False
        self.version += 1
        return True

    def edit(self, cells: DataFrame) -> None:
        """Append cells (sheet, r, c, value) as the next version; versions undone are dropped."""
        kept = self.log.filter(F.col("version") <= self.version)
        self.version += 1
        self.newest = self.version
        self.log = kept.unionByName(cells.select(F.lit(self.version).cast("long").alias("version"), *CELL, "value"))

    def checkpoint(self, name: str) -> None:
        """Name the present version; the oldest names go."""
        self.checkpoints[name] = self.version
        while len(self.checkpoints) > CHECKPOINTS:
            del self.checkpoints[next(iter(self.checkpoints))]

    def restore(self, name: str) -> None:
        """Back to a named version."""
        self.version = self.checkpoints[name]

    def state(self) -> DataFrame:
        """The cells at the present version."""
        return state_at(self.log, self.version)
