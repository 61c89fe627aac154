"""The queries of this subpackage: opN_<name> applies operator N to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat, classifier, divergence, near_dup, packing, patterns, pii, pipeline, quality_rules, search, secret_scan, sharding, token_count
from .common import table


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_chats(rows))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.pack(table(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "label")


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, docs.where("doc_id % 100 = 0"))


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = classifier.classify(docs, net)
    return scored.select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_codec.decode(bpe_codec.encode(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = quality_rules.ratios(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))
    return quality_rules.judge(docs, ratios).drop("text")


def op11_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.mine(patterns.click_events(table(spark, sf_dir, "clicks")))
    return found.select(F.concat_ws(">", "types").alias("pattern"), "length", "support", "clients_crc", "n_wider", "closed")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digests(secret_scan.detect(docs, secret_scan.train(secret_scan.samples(docs))))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_shard, op2_chat, op3_pack, op4_token_counts, op5_pii, op6_near_dup, op7_search, op8_classifier, op9_bpe, op10_quality, op11_patterns, op12_secrets, op13_divergence)
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_search": search.SQL, "op11_patterns": patterns.SQL, "op13_divergence": divergence.SQL}
