"""The corpus pipeline: documents to token ids in five stages.

Each stage reads all that its predecessor kept; all but the last return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import bpe, line_dedup, mixing, near_dup, quality
from lettermill.llm.scratch import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees; null and empty texts go."""
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge_quality(docs, trees).where("kept").select(*docs.columns)


def line_dedup_by_site(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their site's boilerplate lines; ``n_chars`` follows the text."""
    out = line_dedup.drop_site_lines(docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the least id; rows without an id all stay.

    Rows of one id are one document, and go or stay together; of those that stay, equal texts become one row.
    """
    scratch = Scratch(spark, "near-dedup")
    judged = near_dup.near_duplicates(docs, shingle=5, percent=80)
    gone = scratch.save(judged.where("not kept").select("doc_id").distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= near_dup.BROADCAST_IDS else gone
    # Few ids repeat; only their rows are shuffled to be compared.
    twice = scratch.save(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    twice = F.broadcast(twice) if twice.count() <= near_dup.BROADCAST_IDS else twice
    stay = docs.join(gone, "doc_id", "left_anti")
    repeated = stay.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.join(twice, "doc_id", "left_anti").unionByName(repeated).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its leaf's budget reads it."""
    return mixing.mixture(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256) of every document."""
    spec = bpe.load_spec(TOKENIZER)
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), spec)
    return bpe.digests(coded).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_by_site),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_to_weights),
    ("BPE encoding and decoding", bpe_round_trip),
]

#: Boosted trees and BPE are beyond SQL; tests hold every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next stage."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
