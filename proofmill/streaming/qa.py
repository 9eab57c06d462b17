"""The rule checks over a stream of articles, an extension: every check of a document needs that document alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import findings
from ..sources import corpus


def article_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def run(articles: DataFrame, checks: list[Callable[[DataFrame], DataFrame]], out: str, checkpoint: str):
    """Appends the findings of each micro-batch to out, once: a repeated batch overwrites its own part."""

    def batch(df: DataFrame, number: int) -> None:
        el = corpus.from_text(df)
        findings.union([c(el) for c in checks]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return articles.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
