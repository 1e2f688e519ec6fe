"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import (
    bpe, chat, codes, hosts, language, lines, mih, repair, secrets, sharding, simhash, templates, toxicity,
)
from ledgerlens.llm.common import table
from ledgerlens.sources.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op3_link_trust(spark: SparkSession, root: str) -> DataFrame:
    return hosts.judge_pages(table(spark, root, "pages"), RULES)


@query
def op4_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, root, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_texts(table(spark, root, "documents"), vocabulary_path(), keep=False)


@query
def op9_lpt_shards(spark: SparkSession, root: str) -> DataFrame:
    return sharding.shard_documents(table(spark, root, "documents"), shards=8)


@query
def op8_simhash_bktree(spark: SparkSession, root: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, root, "documents")).drop("text_hash")


@query
def op2_mih_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings").select(
        F.col("vec_id").alias("id"), mih.sign_code(F.col("embedding")).alias("code")
    )
    found = mih.top_k(rows, rows.where("id % 100 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("hamming"))


@query
def op6_secret_ownership(spark: SparkSession, root: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, root, "documents"))


@query
def op7_toxicity_viterbi(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, root, "labels")))


@query
def op10_language_ftrl(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return language.identify(docs, language.fit(docs))


@query
def op1_template_decontamination(spark: SparkSession, root: str) -> DataFrame:
    found = templates.find_contaminated(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select("doc_id", "items", "coverage", "changed")


@query
def op11_conversation_repair(spark: SparkSession, root: str) -> DataFrame:
    return repair.repair_report(table(spark, root, "conversations"))


@query
def op12_prefix_targets(spark: SparkSession, root: str) -> DataFrame:
    turns = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    # a conversation that speaks in control strings
    said = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.read_back(chat.prefix_examples(turns.unionByName(said)))


@query
def op13_bounded_codes(spark: SparkSession, root: str) -> DataFrame:
    coded, books = codes.compress(table(spark, root, "embeddings"))
    path = scratch_path(spark, "codes")
    coded.write.parquet(path)
    out = codes.with_label_error(spark.read.parquet(path))
    return out.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.codebook_digest(books)).alias("codebooks_sha256")
    )
