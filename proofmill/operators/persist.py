"""Documents, findings, comments and models to JSON and back. Readers have explicit schemas: new fields stay optional."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = (
    "doc_id long, check_name string, sub_check string, category string, severity string, confidence double, idx long, start_offset long, end_offset long, original_text string, "
    "proposed_text string, reasoning string, auto_applicable boolean, finding_id string, ordinal long, finding_key string"
)
ELEMENT = "doc_id long, brand string, article_type string, idx long, elem_type string, level int, text string, start_offset long, end_offset long"


def to_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def from_json(rows: DataFrame, schema: str) -> DataFrame:
    """Rows back from JSON texts; missing fields are null, texts that don't parse are dropped."""
    return rows.select(F.from_json("json", schema).alias("x")).where("x IS NOT NULL").select("x.*")


def documents(el: DataFrame) -> DataFrame:
    """(doc_id, json): a document with its elements in order, its title, length and schema version."""
    parts = F.array_sort(F.collect_list(F.struct("idx", "elem_type", "level", "text", "start_offset", "end_offset")))
    docs = el.groupBy("doc_id").agg(parts.alias("elements"), F.max("end_offset").alias("total_length"), F.min_by("text", F.when(F.col("elem_type") == "heading", F.col("idx"))).alias("title"))
    return docs.select("doc_id", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "doc_id", "title", "total_length", "elements")).alias("json"))


def findings_report(findings: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): a document's findings with the ids of the comments posted for them, under their counts.

    posted: (doc_id, finding_id, comment_id).
    """
    rows = findings if posted is None else findings.join(posted, ["doc_id", "finding_id"], "left")
    one = F.struct("ordinal", "finding_id", "check_name", "severity", "confidence", "original_text", "proposed_text", "reasoning", "auto_applicable", *([] if posted is None else ["comment_id"]))
    docs = rows.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("auto_applicable").alias("auto"), F.array_sort(F.collect_list(one)).alias("findings"))
    return docs.select("doc_id", F.to_json(F.struct("total", "auto", "findings")).alias("json"))


def save_models(models: DataFrame, path: str) -> None:
    """Voice models as JSON, a folder per layer."""
    models.write.mode("overwrite").partitionBy("layer").json(path)


def load_models(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)


def comment_counts(comments: DataFrame, severities: tuple[str, ...] = ("error", "warning", "suggestion")) -> DataFrame:
    """(severity, n): every severity has a row."""
    spark = comments.sparkSession
    domain = spark.createDataFrame([(s,) for s in severities], "severity string")
    return domain.join(comments.groupBy("severity").agg(F.count("*").alias("k")), "severity", "left").select("severity", F.coalesce("k", F.lit(0)).alias("n"))


def table_shapes(el: DataFrame) -> DataFrame:
    """(doc_id, table, rows, cols): tables are runs of cells that start at row 0, column 0. Needs row and col."""
    from pyspark.sql import Window

    first = ((F.col("row") == 0) & (F.col("col") == 0)).cast("int")
    cells = el.where("elem_type = 'table_cell'").withColumn("table", F.sum(first).over(Window.partitionBy("doc_id").orderBy("idx")))
    return cells.groupBy("doc_id", "table").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
