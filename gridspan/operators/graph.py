"""Dependencies between cells: tracing over edges, and cycles of linear formulas solved by repeated joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of the cycle solver.
ROUNDS, CLOSE = 1000, 0.01
#: Steps between two tests of the largest move.
STEPS = 3


def _written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: a checkpoint in the session's folder, set here only where none is."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        if not sc.getConf().get("spark.checkpoint.dir") and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix=f"gridspan-{name}-"))
    return df.checkpoint()


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join in a round: dealt by key, since broadcasts of many rounds would all go through the driver."""
    return df.hint("merge")


def trace(edges: DataFrame, start: DataFrame, most_levels: int | None = None) -> DataFrame:
    """(cell, level) of all that depend on the start cells; edges are (cell, uses). A frontier join for each level.

    Runs until nothing new is reached; raises where `most_levels` is given and more levels than that are found.
    """
    seen = start.select(F.col("cell"), F.lit(0).alias("level"))
    front = seen.select("cell")
    for level in count(1):
        reached = edges.join(_shuffled(front.withColumnRenamed("cell", "uses")), "uses").select("cell").distinct()
        front = _written(reached.join(_shuffled(seen), "cell", "left_anti"), "front")
        if front.isEmpty():
            break
        if most_levels is not None and level > most_levels:
            raise ValueError(f"cells lie more than {most_levels} levels away")
        seen = _written(seen.unionByName(front.select("cell", F.lit(level).alias("level"))), "seen")
    return seen


def precedents(edges: DataFrame, start: DataFrame, most_levels: int | None = None) -> DataFrame:
    """(cell, level) of all that the start cells use."""
    return trace(edges.select(F.col("uses").alias("cell"), F.col("cell").alias("uses")), start, most_levels)


def levels(edges: DataFrame, cells: DataFrame, most_levels: int | None = None) -> DataFrame:
    """(cell, level): a cell's level is above those of all cells it uses; cells on or behind a cycle get null.

    Runs until no cell is ready; raises where `most_levels` is given and there are more levels than that.
    """
    left, done = cells.select("cell").distinct(), None
    for level in count():
        waiting = edges.join(_shuffled(left.withColumnRenamed("cell", "uses")), "uses", "left_semi").select("cell").distinct()
        ready = _written(left.join(_shuffled(waiting), "cell", "left_anti").withColumn("level", F.lit(level)), "ready")
        if ready.isEmpty():
            break
        if most_levels is not None and level >= most_levels:
            raise ValueError(f"there are more than {most_levels} levels")
        done = ready if done is None else done.unionByName(ready)
        left = _written(left.join(_shuffled(ready), "cell", "left_anti"), "left")
    behind = left.withColumn("level", F.lit(None).cast("int"))
    return behind if done is None else done.unionByName(behind)


def solve_linear(terms: DataFrame, constants: DataFrame, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """(cell, value) where value = constant + sum of weight times used value, cycles included: steps until no cell moves more than `close`.

    terms: (cell, uses, weight), constants: (cell, constant). Raises where the steps do not settle.
    """
    state = _written(constants.select("cell", F.col("constant").cast("double").alias("value")), "state")
    for _ in range(0, rounds, STEPS):
        new = state
        for _ in range(STEPS):  # so many steps in one plan: a checkpoint for each would cost more than the step
            before = new
            pulled = terms.join(before.withColumnRenamed("cell", "uses"), "uses").groupBy("cell").agg(F.sum(F.col("weight") * F.col("value")).alias("pull"))
            new = constants.join(pulled, "cell", "left").select("cell", (F.col("constant") + F.coalesce("pull", F.lit(0.0))).alias("value"))
        moved = before.withColumnRenamed("value", "old").join(new, "cell").select("cell", "value", F.abs(F.col("value") - F.col("old")).alias("step"))
        moved = _written(moved, "state")
        state = moved.select("cell", "value")
        if (moved.agg(F.max("step")).first()[0] or 0.0) < close:
            return state
    raise ValueError("the cycle does not settle")


def edges_of(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Edges (cell, uses) of a small graph."""
    return spark.createDataFrame(pairs, "cell string, uses string")
