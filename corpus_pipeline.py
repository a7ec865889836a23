"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again before the next.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but
for the last, returns the columns of documents. Rows with nulls, empty texts and repeated
rows pass through every stage as its operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathframe.llm import bpe, mixing, secrets_ledger, simhash, toxicity
from swathframe.llm.words import free_names, small_batches
from swathframe.plans.shipping import ship_package
from swathframe.plans.storage import saved

#: The scores, fingerprints, hashes and tree models have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def ready(spark: SparkSession) -> None:
    """Executors get the package, and Arrow batches that bound a worker's memory."""
    ship_package(spark)
    small_batches(spark)


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.5 or more) go."""
    ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    (score,) = free_names(docs.columns, "score")
    return model.score(docs, out=score).where(F.col(score) < 0.5).drop(score)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    ready(spark)
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; every document stays. n_chars follows the text where it was set."""
    blob, hit, spans = free_names(docs.columns, "blob", "hit", "spans")
    found, _ = secrets_ledger.scan(docs.select("doc_id", "text"))
    found = found.where(F.size("spans") > 0).groupBy(F.col("blob").alias(hit)).agg(F.first("spans").alias(spans))
    joined = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)).join(saved(found, "pipeline-secrets"), F.col(blob) == F.col(hit), "left")
    is_hit = F.col(hit).isNotNull()
    changed = joined.withColumn("text", F.when(is_hit, secrets_ledger.redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(is_hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once or twice; a document without words passes once."""
    mix, turn = free_names(docs.columns, "mix", "turn")
    mixed = mixing.mix(docs, weights=(5, 2, 1), budget=1.5, copies=2, out=mix)
    passes = F.when(F.col(f"{mix}.size") > 0, (F.col(f"{mix}.taken") / F.col(f"{mix}.size")).cast("int")).otherwise(1)
    repeated = mixed.where(passes > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), passes)))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def byte_bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row that is left."""
    ready(spark)
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("simhash near-dedup", one_of_near_copies),
    ("secret scan", without_secrets),
    ("source mix", mixed_sources),
    ("byte bpe", byte_bpe_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
