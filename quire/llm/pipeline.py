"""The corpus pipeline: quality rules, quality classifier, near-duplicates, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet
and read again as the next one's docs. Each works on every row its predecessor kept. All but the last return the columns
of documents (doc_id, text, lang, source, n_chars, and any others, as they came).

Defined results: rows with a null or empty text fail the quality rules and go; of repeated rows (equal id and text) one
stays; of each group of near-duplicates the document with the least id stays (a null id only where the group has no other), and
if that id names several texts of the group, one row of it; unrelated texts of one id all stay; rows without words are no
copies; n_chars follows the text that the personal-data stage rewrites; an empty table stays empty and
gives no sequence; columns of other names are carried along untouched, whatever they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, near_dup, packing, pii, quality_rules
from .common import shared_folder
from .quality_rules import named

#: A document of a lower score goes.
KEEP_SCORE = 0.5


def plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with numbered column names, which clash with nothing, and what doc_id and text are called then."""
    names = [f"in{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratios = quality_rules.ratios(docs, quality_rules.trusted_ids(labels))
    own, _, text = plain(docs)
    return quality_rules.judge(own, ratios, text_col=text).where("kept").select(*own.columns).toDF(*docs.columns)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # earlier stages drop most documents of label 0, so the network learns from the corpus as it came
    net = classifier.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.keep(docs, net, KEEP_SCORE)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, doc_id, text = plain(docs)
    found = near_dup.near_duplicates(own, doc_id, text)
    # one (id, text) stays of each component, a null id only where there is no other; a text without words is its own component
    pair = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "text_key")).alias("p")
    chosen = found.where("label is not null").groupBy("label").agg(pair).select("p.id", "p.text_key")
    chosen = chosen.unionByName(found.where(f"label is null and {doc_id} is not null").select(F.col(doc_id).alias("id"), "text_key")).distinct().toDF("id", "key")
    keyed = own.withColumn("key_of", F.xxhash64(text))
    alone = F.col(doc_id).isNull() & ~F.coalesce(F.col(text).rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    one = keyed.where(~alone).join(chosen, F.col(doc_id).eqNullSafe(F.col("id")) & (F.col("key_of") == F.col("key")), "left_semi")
    named_rows = one.dropDuplicates([doc_id, "key_of"]).select(*own.columns)
    return named_rows.unionByName(own.where(alone)).toDF(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return pii.mask(docs).select(*(size.alias(c) if c == "n_chars" else F.col(named(c)) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.pack(docs))


STAGES = [
    ("quality rules", quality_stage),
    ("quality classifier", classifier_stage),
    ("near-duplicates", near_dup_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: The hashed ratios, the network, and tokenisation have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again in the shared folder named by spark.checkpoint.dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
