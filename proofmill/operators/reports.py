"""Comments and summaries of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from .document import with_sections


def comments(el: DataFrame, findings: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Drafted comments: what isn't automatic, and automatic fixes that lost a conflict, by section and place."""
    open_ = findings.where("NOT auto_applicable")
    if judged is not None:
        open_ = open_.unionByName(judged.where("status = 'downgraded'").select(*findings.columns))
    place = with_sections(el).select("doc_id", "idx", "elem_type", "section_index", "section_title")
    rows = open_.join(place, ["doc_id", "idx"], "left")
    where = F.concat(F.coalesce(F.concat(F.lit("section "), "section_title", F.lit(", ")), F.lit("")), F.coalesce("elem_type", F.lit("document")), F.lit(" "), F.col("idx").cast("string"))
    rows = rows.select("doc_id", "finding_id", "finding_key", F.coalesce("section_title", F.lit("")).alias("section"), "idx", where.alias("location"), F.col("reasoning").alias("issue"), F.col("proposed_text").alias("suggestion"), "severity", "check_name", F.substring("original_text", 1, 100).alias("original_text"))
    w = Window.partitionBy("doc_id").orderBy("section", "idx", "finding_key")
    return rows.withColumn("no", F.row_number().over(w).cast("long")).withColumn("batch", F.floor((F.col("no") - 1) / 10))


def comment_text(rows: DataFrame) -> DataFrame:
    """The text to post with each comment; suggestions are cut at 200 characters."""
    body = F.concat_ws("\n", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "check_name"), "issue", F.when(F.col("suggestion").isNotNull(), F.concat(F.lit("Suggestion: "), F.substring("suggestion", 1, 200))))
    return rows.withColumn("content", body)


def markdown(rows: DataFrame) -> DataFrame:
    """(doc_id, markdown): comments under a heading where the section changes."""
    w = Window.partitionBy("doc_id").orderBy("no")
    head = F.when(~F.col("section").eqNullSafe(F.lag("section").over(w)), F.concat(F.lit("## "), F.when(F.col("section") == "", "Document").otherwise(F.col("section")), F.lit("\n")))
    line = F.concat(F.coalesce(head, F.lit("")), F.lit("- **"), "check_name", F.lit("** ("), "location", F.lit("): "), "issue", F.coalesce(F.concat(F.lit(" → "), "suggestion"), F.lit("")))
    out = rows.withColumn("line", line)
    return out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def run_summary(findings: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, check_name, applied, proposals): proposals are findings that aren't automatic, and downgraded fixes."""
    left = findings.where("NOT auto_applicable").groupBy("doc_id", "check_name").agg(F.count("*").alias("p"))
    right = judged.groupBy("doc_id", "check_name").agg(F.count_if(F.col("status") == "applied").alias("applied"), F.count_if(F.col("status") == "downgraded").alias("d"))
    both = left.join(right, ["doc_id", "check_name"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("doc_id", "check_name", zero("applied").alias("applied"), (zero("p") + zero("d")).alias("proposals"))


def blank_rows_setting(rows: DataFrame) -> DataFrame:
    """Adds blank_rows and the reason: hint, article type, market, file name, brand setting, brand; the first that speaks.

    rows: hint, article_type, market, filename, brand_setting, brand; any may be null.
    """
    market = F.lower(F.trim(F.coalesce("market", F.lit(""))))
    brand = F.element_at(F.create_map(*(F.lit(x) for kv in L.BRAND_ROWS.items() for x in kv)), F.lower(F.trim(F.coalesce("brand", F.lit("")))))
    rules = (
        ("hint", F.when(F.col("hint").isin("required", "none"), F.col("hint"))),
        ("article type", F.when(F.col("article_type").isin(L.PLAIN_TYPES), "none")),
        ("market", F.when(market.isin(L.MARKETS) & F.col("article_type").isin(L.MARKET_TYPES), "required")),
        ("file name", F.when(F.col("filename").rlike(r"(?i)^Meta\s*Title[_\s]"), "none").when(F.col("filename").rlike("(?i)" + L.FILE_REGION), "required")),
        ("brand setting", F.col("brand_setting")),
        ("brand", brand),
    )
    return rows.withColumn("blank_rows", F.coalesce(*(v for _, v in rules), F.lit("proposal"))).withColumn("reason", F.coalesce(*(F.when(v.isNotNull(), n) for n, v in rules), F.lit("default")))
