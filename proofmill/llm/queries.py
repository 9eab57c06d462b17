"""The queries opN_<name>: each applies its operator, with production parameters, to the whole of its table.

held_out is null where doc_id is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, decontam, dialogue, langid, licenses, packing, pivots, simhash, substring, tokenfile, toxicity, warc, whitening
from .common import table


def crc(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read(*tokenfile.write(table(spark, sf_dir, "documents")), with_ids=False)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivots.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs)).withColumnRenamed("id", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(*warc.write(table(spark, sf_dir, "pages")), with_payload=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("words_sha256").alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lang_model = langid.fit(docs.where(crc() % 3 != 1), max_docs=1500)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(crc() % 3 != 1), lang_model)
    found = toxicity.score(docs, model, lang_model).withColumn("held_out", crc("id") % 3 == 1)
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", F.when(F.col("score") >= toxicity.AT, 1).otherwise(0).alias("predicted"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc() % 5 != 0))
    found = langid.identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), (crc("id") % 5 == 0).alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue.damage(table(spark, sf_dir, "conversations"))
    return dialogue.digests(rows, dialogue.audits(rows))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it leaves 64 bits."""
    rows = whitening.integers(table(spark, sf_dir, "embeddings"))
    found = whitening.whitened(rows, whitening.fit(rows)).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
    return found.withColumnRenamed("id", "vec_id")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bytebpe.digests(bytebpe.encode(table(spark, sf_dir, "documents"), decoded=True))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_embedding_near_dedup, op3_license_scan, op4_packing, op5_warc, op6_substring_dedup, op7_decontamination, op8_toxicity,
        op9_simhash_near_dedup, op10_language_id, op11_conversation_repair, op12_embedding_whitening, op13_byte_bpe,
    )
}

ORACLE_SQL: dict[str, str] = {"op7_decontamination": decontam.ORACLE}
