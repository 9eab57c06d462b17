"""The corpus pipeline: language ID, SimHash near-dedup, substring dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
is written as Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.llm import decontam, langid, packing, simhash, substring
from proofmill.llm.common import stored, table
from proofmill.llm.queries import crc

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language has this mean probability over its bytes (noise takes the rest), or if it has no letter.
#: The least of 1,960 held-out documents is 0.10; random letters, digits and other scripts have 0.05 or less.
MIN_SCORE = 0.07


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the network can tell; they pass through unchanged, without a shuffle.

    Null and empty texts, texts without a letter and texts that the network takes for noise go. Rows are judged one by one,
    whatever their id, so repeated rows and null ids stay or go by their text.
    """
    model = langid.fit(docs.where(crc() % 5 != 0))
    named = langid.identify(docs, model, carry=COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return named.select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates, and every row without a doc_id.

    Of rows that repeat both doc_id and text one stays; rows that share a doc_id but not the text stay or go together if
    their groups do.
    """
    found = simhash.near_duplicates(docs.where("doc_id is not null"))
    kept = found.where("id = component").select(F.col("id").alias("doc_id")).distinct()
    rows = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source", "n_chars")
    first = rows.withColumn("again", F.row_number().over(again)).where("again = 1")
    return first.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of 50 words or more; a document of which nothing is left goes.

    Rows without a doc_id pass through and are no source; rows that share one never match each other.
    """
    found = substring.deduplicate(docs, carry=("lang", "source", "n_chars")).where("n_removed = 0 or n_removed < n_words")
    text = F.col("kept").alias("text")
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(F.col("id").alias("doc_id"), text, "lang", "source", chars).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Rows that share a doc_id are one document; rows without one are kept."""
    found = decontam.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; null texts and ids and repeated rows are packed row by row."""
    return packing.pack(docs, with_ids=False)


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("pack", pack)]

ORACLE_SQL = None  # recurrent networks and byte-pair encoding have no SQL form; tests hold stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
