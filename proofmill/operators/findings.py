"""Findings: one row per remark of a check, and the filters, orders and summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "check_name", "sub_check", "category", "severity", "confidence", "idx", "start_offset", "end_offset", "original_text", "proposed_text", "reasoning", "auto_applicable")
SEVERITIES = ("error", "warning", "suggestion")


def finding_id(check: Column, start: Column, end: Column, original: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", check, start.cast("string"), end.cast("string"), original), 256), 1, 16)


def make(rows: DataFrame, check: str, sub: str | Column, category: str, severity: str | Column, confidence: float | Column, start: Column, end: Column, original: Column, proposed: Column | None, reasoning: str | Column, auto: bool | Column) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    cols = {
        "check_name": lit(check), "sub_check": lit(sub), "category": lit(category), "severity": lit(severity), "confidence": lit(confidence).cast("double"),
        "start_offset": start.cast("long"), "end_offset": end.cast("long"), "original_text": original,
        "proposed_text": (F.lit(None) if proposed is None else proposed).cast("string"), "reasoning": lit(reasoning), "auto_applicable": lit(auto),
    }
    return rows.select("doc_id", "idx", *(c.alias(k) for k, c in cols.items())).select(*COLUMNS)


def make_each(rows: DataFrame, check: str, rules: list[tuple]) -> DataFrame:
    """Findings of several rules over the same rows, in one pass.

    A rule: condition, then sub, category, severity, confidence, start, end, original, proposed, reasoning, auto.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    kinds = (("sub_check", "string"), ("category", "string"), ("severity", "string"), ("confidence", "double"), ("start_offset", "long"), ("end_offset", "long"), ("original_text", "string"), ("proposed_text", "string"), ("reasoning", "string"), ("auto_applicable", "boolean"))
    one = [F.when(r[0], F.struct(*(lit(v).cast(kind).alias(name) for v, (name, kind) in zip(r[1:], kinds)))) for r in rules]
    any_rule = rules[0][0]
    for r in rules[1:]:
        any_rule = any_rule | r[0]
    found = rows.where(any_rule).select("doc_id", "idx", F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("f"))
    return found.select("doc_id", "idx", "f.*").withColumn("check_name", F.lit(check)).select(*COLUMNS)


def union(parts: list[DataFrame]) -> DataFrame:
    """All findings, with finding_id and a finding_key that is unique within the table's documents."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("finding_id", finding_id(F.col("check_name"), F.col("start_offset"), F.col("end_offset"), F.col("original_text")))
    w = Window.partitionBy("doc_id").orderBy("start_offset", "end_offset", "check_name", "sub_check", "original_text", "proposed_text")
    rows = rows.withColumn("ordinal", F.row_number().over(w).cast("long"))
    return rows.withColumn("finding_key", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "finding_id", "sub_check", F.col("ordinal").cast("string")), 256))


def has_fix() -> Column:
    return F.col("proposed_text").isNotNull() & ~F.col("proposed_text").eqNullSafe(F.col("original_text"))


def select(findings: DataFrame, kind: str) -> DataFrame:
    """auto, proposals (a fix, not automatic), comments (no fix), errors, warnings, suggestions, deterministic."""
    where = {
        "auto": F.col("auto_applicable"), "proposals": ~F.col("auto_applicable") & F.col("proposed_text").isNotNull(), "comments": F.col("proposed_text").isNull(),
        "errors": F.col("severity") == "error", "warnings": F.col("severity") == "warning", "suggestions": F.col("severity") == "suggestion", "deterministic": F.col("confidence") == 1.0,
    }
    return findings.where(where[kind])


def invalid(findings: DataFrame) -> DataFrame:
    """Rows that break the contract: confidence outside 0 to 1, or automatic without a fix."""
    return findings.where(~F.col("confidence").between(0, 1) | (F.col("auto_applicable") & F.col("proposed_text").isNull()))


def summary(findings: DataFrame) -> DataFrame:
    """Totals over everything, by severity and by category, in one pass."""
    fixes = (F.count_if("auto_applicable").alias("auto"), F.count_if(~F.col("auto_applicable") & F.col("proposed_text").isNotNull()).alias("proposals"), F.count_if(F.col("proposed_text").isNull()).alias("comment_only"))
    return findings.groupingSets([[], ["severity"], ["category"]], "severity", "category").agg(F.count("*").alias("total"), *fixes)


def by_check(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check_name").agg(F.count("*").alias("total"), F.count_if("auto_applicable").alias("auto"), F.count_if(~F.col("auto_applicable")).alias("proposals"))


def ordered(findings: DataFrame, by: str = "position") -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    key = {"position": [F.col("start_offset")], "severity": [rank], "confidence": [F.col("confidence").desc()]}[by]
    return findings.orderBy("doc_id", *key, "ordinal")


def counts(findings: DataFrame, *cols: str) -> DataFrame:
    """How many findings each value of cols has, the most frequent first, then by name."""
    return findings.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cols)
