"""What the corpus operators share: row splits, the shared folder, bounded look-ups, flushing counters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leading bits to which `floor_for` tells counts apart: counts up to 1023 exactly, larger ones to a fifth of a percent.
LEADING_BITS = 10
#: Words of 64 bits that a sieve has at most (one row each; about 64 MB in an executor where all are set, by estimate).
SIEVE_WORDS = 1 << 20


def rewritten(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs with the texts that `change` writes, under its own column names whatever they are.

    `change` gets `text` beside columns that no operator uses, and returns them with `changed`: whether the text is
    another one. Of these rows n_chars, where docs has it, becomes the length of the text.
    """
    names = docs.columns
    inner = ["text" if c == "text" else f"_c{i}" for i, c in enumerate(names)]
    out = change(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(names, inner, strict=True))))
    size = lambda n: F.when(F.col("changed"), F.length("text").cast(out.schema[n].dataType)).otherwise(F.col(n))
    return out.select(*((size(n) if c == "n_chars" else F.col(n)).alias(c) for c, n in zip(names, inner, strict=True)))


def crc_mod(key: str, by: int) -> Column:
    """crc32 of a key's text, modulo `by`; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % by


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Let tasks exchange so many rows at a time with Python: texts are kilobytes each, and 10,000 of them fill a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets one; a cluster must name it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridspan-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage is cut and no executor holds the only copy."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is dealt by key: tables that grow with the corpus must not be broadcast, since those go through the driver.

    Without it Spark judges a written table by its compressed files, of which a few MB can be a million rows.
    """
    return df.hint("merge")


def floor_for(counts: DataFrame, column: str, most: int, weight: str | None = None) -> int:
    """The smallest count such that at most `most` rows (or their summed weight) reach it: a bound on a model's size that drops ties as a whole.

    One aggregation over the counts; whatever their size, nothing but a histogram of at most 64 * 2**LEADING_BITS rows
    reaches the driver.
    """
    cut = f"greatest(0, length(bin({column})) - {LEADING_BITS})"
    rows = counts.groupBy(F.expr(f"shiftleft(shiftright({column}, {cut}), {cut})").alias("c")).agg((F.sum(weight) if weight else F.count("*")).alias("count")).collect()
    total, floor = 0, (1 << 63) - 1
    for c, n in sorted(((r["c"], r["count"]) for r in rows), reverse=True):
        total += n
        if total > most:
            break
        floor = c
    return floor


def marked(rows: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """rows and `marked`: true wherever keys holds the row's columns `by`, and by chance for a few other rows; never null.

    A bitmap of the keys' hashes is broadcast, at most SIEVE_WORDS rows of it whatever the number of keys: it spares what
    has no partner a shuffle. What is marked must meet the keys in a join yet, so where the bitmap fills, only the work grows.
    """
    digest = F.xxhash64(*by)
    word, bit = F.pmod(F.shiftrightunsigned(digest, 6), F.lit(SIEVE_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(digest, F.lit(64)).cast("int"))
    sieve = keys.select(word.alias("sieve_word"), bit.alias("bit")).groupBy("sieve_word").agg(F.bit_or("bit").alias("sieve_bits"))
    met = rows.withColumn("sieve_word", word).join(F.broadcast(sieve), "sieve_word", "left")
    return met.withColumn("marked", F.coalesce(F.col("sieve_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("sieve_word", "sieve_bits")
