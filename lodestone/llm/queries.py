"""The queries that apply each operator to its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, oracle, packing, quality, rules, sharding, simhash, topk, warc
from .common import prepare, shared_folder, table


def op1_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return topk.top_k(e.where("vec_id % 50 = 0"), e, k=5)


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, min_payload=0)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    s = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=24)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = quality.train(docs, quality.learn_rows(table(spark, sf_dir, "labels")))
    return quality.score(docs, w).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.stored(rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), shared_folder(spark, "ledger"))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ledger(spark, sf_dir)
    d = rules.apply_policy(rules.apply_policy(d, rules.Policy("v1")), rules.Policy("base"), "base_ok")
    d = rules.apply_policy(d, rules.Policy("v2"), "v2_ok")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_ok")).alias("base_failed"), (F.col("base_ok") & F.col("kept")).alias("kept"), (F.col("base_ok") & F.col("v2_ok")).alias("kept_v2"), "fail_bits",
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, and what it alone rejects, from one stored ledger."""
    d, out = _ledger(spark, sf_dir), None
    for name in rules.POLICIES:
        part = rules.ablations(d, rules.Policy(name)).select(F.lit(name).alias("policy"), "rule", "failed", "failed_alone")
        out = part if out is None else out.union(part)
    return out


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def packing_files() -> tuple[str, str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), packing_files(), capacity=1024, end_id=2), capacity=1024)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "languages")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_threshold_topk, op2_warc_bundles, op3_byte_shards, op4_ftrl_quality, op5_rule_ledger, op6_simhash_groups, op7_license_diagonals, op8_segment_tree_bpe, op9_complement_packing, op10_language_mixture, rule_ablations)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
