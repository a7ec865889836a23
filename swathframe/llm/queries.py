"""The operators over their whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch_path

from . import bpe, collocations, eps_grid, html_extract, mixing, pieces, secrets_ledger, simhash, spelling, token_store, topk_nra, toxicity, url_filter
from .words import small_batches

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, weights=(5, 2, 1), budget=1.5, copies=2)
    return mixed.select("doc_id", F.col("mix.size").alias("size"), F.col("mix.pattern_size").alias("source_size"), F.col("mix.quota").alias("target"), F.col("mix.taken").alias("taken"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, docs = secrets_ledger.RULES, table(spark, sf_dir, "documents")
    _, ledger = secrets_ledger.scan(docs, rules=secrets_ledger.BASE)
    found, _ = secrets_ledger.scan(docs, ledger, rules)  # of the ledger's blobs only the pairs with the added rules are unseen
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["k"] < len(secrets_ledger.BASE))
    return found.select(F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets_ledger.listed(base, rules), 256).alias("base_sha256"), secrets_ledger.listed(F.col("spans"), rules).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return model.score(docs).select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eps_grid.near_components(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.read_store(spark, path).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.simhash_components(table(spark, sf_dir, "documents"), radius=2, width=3)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_nra.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"), least=100, longest=5, best=2000)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    coded = pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), every=199), ratio=5)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_html_extraction, op2_url_filter, op3_source_mix, op4_secret_scan, op5_toxicity, op6_byte_bpe, op7_embedding_near_dedup, op8_token_store, op9_simhash_near_dedup, op10_exact_top_k, op11_phrase_collocations, op12_sentencepiece, op13_spelling_variants, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return SQL
