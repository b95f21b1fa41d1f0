"""The registered corpus queries: thin digests of the operators' outputs, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, decontaminate, language_id, pii, quality_pu, quality_rules, secrets, simhash, warc
from .common import crc_mod, small_batches

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every item, joined to every run of as many document words.
DECONTAMINATE_SQL = f"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS rid, {_ITEM_WORDS} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT n FROM win),
word AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc),
pos AS (
  SELECT rid, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {decontaminate.WINDOW - 1} FOLLOWING) AS ahead FROM word
),
met AS (
  SELECT p.rid, p.i, p.n, item_id
  FROM (SELECT rid, i, n, array_to_string(list_slice(ahead, 1, n), ' ') AS win FROM pos CROSS JOIN sizes WHERE len(ahead) >= n) p JOIN win USING (n, win)
),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM met) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

#: What an archive must give back, without one.
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text."""
    out = language_id.language_of(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree and unigram log probability of every text."""
    return ctw.score_held_out(documents(spark, sf_dir).select("doc_id", "text"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text and what they decode to."""
    import public_tokenizers

    out = bpe.encode_decode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    out = pii.find(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda i: F.filter("spans", lambda x: x["base"] & (x["kind"] == i))
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return out.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every text."""
    out = quality_rules.keep_good(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    out = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda x: x["kind"] != "linked")).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text."""
    return quality_pu.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every text."""
    found = decontaminate.hits(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("ranges", F.lit(0), lambda n, r: n + r["b"] - r["a"]).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, archived and read back."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {
        "op1_language": op1_language,
        "op2_ctw": op2_ctw,
        "op3_bpe": op3_bpe,
        "op4_pii": op4_pii,
        "op5_quality_rules": op5_quality_rules,
        "op6_secrets": op6_secrets,
        "op7_simhash": op7_simhash,
        "op8_quality_pu": op8_quality_pu,
        "op9_decontaminate": op9_decontaminate,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the whole query."""
    return {"op9_decontaminate": DECONTAMINATE_SQL, "op10_warc": WARC_SQL}
