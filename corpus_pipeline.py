"""A corpus pipeline over `documents`: each stage keeps the columns of documents and works on what the one before kept.

Every stage takes any further columns along, whatever their names, returns no row for an empty table, and treats rows
that repeat as rows: only the near-copy stage drops them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm import bpe, decontaminate, language_id, pii, simhash
from gridspan.llm.common import crc_mod, fresh_path, small_batches

#: A language with less than this posterior is rejected, as is a text without a letter.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough. The model is learnt from the rows outside the held-out fold.

    Edge cases: texts that are null or have no letter go, as do those whose languages tie below the floor. A null `lang`
    or doc_id teaches nothing and is predicted like any other. Where nothing teaches, no language is certain and all go.
    """
    small_batches(spark)
    names = docs.columns
    renamed = docs.withColumnsRenamed({c: f"own_{c}" for c in ("lang_pred", "score") if c in names})
    model = language_id.fit(docs.filter(crc_mod("doc_id", 5) != 0))
    out = language_id.predict(renamed, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).drop("lang_pred", "score")
    return out.withColumnsRenamed({f"own_{c}": c for c in ("lang_pred", "score") if c in names})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Groups are those of operator 7, SimHashes at two bits or fewer, joined by verified links of the wider search.

    Edge cases: null texts, empty ones and those without a word are one group. A null doc_id stays only where its group
    has no other. Of equal rows with equal ids one stays. Texts of fewer than five words are compared as one shingle.
    """
    small_batches(spark)
    return simhash.distinct_documents(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those made of them for the larger part go.

    Edge cases: null and empty texts hold no passage and stay as they are, as does everything where benchmark is empty.
    n_chars follows a text that was cut.
    """
    small_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind.

    Edge cases: null and empty texts stay as they are. n_chars follows a text that was changed.
    """
    return pii.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs but the text, with n_chars, the token ids, their number and whether they decode to the text.

    Edge cases: a null text has no token, a null n_chars, and decodes to the empty text. Columns of docs with the names of
    new ones are replaced.
    """
    small_batches(spark)
    new = {"n_chars", "n_tokens", "ids", "round_trip"}
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new | {"text", "decoded"}), F.length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark", remove_benchmark),
    ("personal_data", redact_personal_data),
    ("tokens", tokenize),
]

#: Learnt models and similarity groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
