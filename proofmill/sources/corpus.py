"""Articles and their elements: one row per text leaf, with offsets into the article's full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import article_type, let, starts

#: Columns of every elements table; runs and fonts are null where a source has none.
ELEMENT = ("doc_id", "brand", "article_type", "idx", "elem_type", "level", "text", "start_offset", "end_offset")


def in_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("idx")


def with_offsets(leaves: DataFrame) -> DataFrame:
    """Offsets of leaves that a line feed joins: each starts after the ones before it and their separators."""
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return leaves.withColumn("start_offset", start).withColumn("end_offset", F.col("start_offset") + F.length("text"))


def line_type(text: Column, idx: Column) -> tuple[Column, Column]:
    """Type and level of a plain-text line: short lines are headings, the first of them H1; piped lines are list items."""
    words = F.size(F.split(text, " "))
    heading = (text != "") & (words <= 3)
    kind = F.when(F.contains(text, F.lit(" | ")), "list_item").when(heading, "heading").otherwise("paragraph")
    return kind, F.when(kind == "heading", F.when(idx == 0, 1).otherwise(2 + F.length(text) % 3)).cast("int")


def from_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", brand: str = "source", kind: str = "lang") -> DataFrame:
    """Elements of plain texts, one line a leaf. Offsets are running lengths inside the row: nothing is shuffled."""
    at = lambda lines: starts(F.transform(lines, lambda x: F.length(x) + 1))
    leaf = lambda x, s: F.struct(x.alias("text"), s.cast("long").alias("start"))
    placed = let(F.split(F.col(text), "\n"), lambda lines: F.zip_with(lines, at(lines), leaf))
    base = docs.where(F.col(text).isNotNull())
    leaves = base.select(F.col(doc_id).alias("doc_id"), F.col(brand).alias("brand"), F.col(kind).alias("article_type"), F.posexplode(placed).alias("idx", "leaf"))
    leaves = leaves.select("doc_id", "brand", "article_type", F.col("idx").cast("long").alias("idx"), "leaf.text", F.col("leaf.start").alias("start_offset"))
    elem, level = line_type(F.col("text"), F.col("idx"))
    end = F.col("start_offset") + F.length("text")
    return leaves.select("doc_id", "brand", "article_type", "idx", elem.alias("elem_type"), level.alias("level"), "text", "start_offset", end.alias("end_offset"))


def from_html(pages: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """Elements of web pages: h1 to h6, p, li and td, in document order, with tags inside them removed."""
    parts = F.regexp_extract_all(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", ""), F.lit(r"(?is)<(h[1-6]|p|li|td)\b[^>]*>.*?(?=</?(?:h[1-6]|p|li|td|ul|ol|tr|table|article|body)\b|$)"), F.lit(0))
    leaves = pages.where(F.col(html).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("article_type"), F.posexplode(parts).alias("idx", "part"))
    tag = F.lower(F.regexp_extract("part", r"(?i)^<(\w+)", 1))
    plain = F.trim(F.regexp_replace(F.regexp_replace("part", r"<[^>]*>", ""), r"\s+", " "))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    kind = F.when(tag.startswith("h"), "heading").when(tag == "li", "list_item").when(tag == "td", "table_cell").otherwise("paragraph")
    level = F.when(kind == "heading", F.least(F.substring(tag, 2, 1).cast("int"), F.lit(4)))
    out = leaves.select("doc_id", "brand", "article_type", F.col("idx").cast("long").alias("idx"), kind.alias("elem_type"), level.alias("level"), plain.alias("text"))
    return with_offsets(out).select(*ELEMENT)


def hyperlinks(pages: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """(doc_id, ord, anchor, url) of the links of web pages."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\b[^>]*?href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select(F.col(doc_id).alias("doc_id"), F.posexplode(found).alias("ord", "a"))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), F.regexp_replace(F.regexp_extract("a", r"(?is)>(.*)</a>$", 1), "<[^>]*>", "").alias("anchor"), F.regexp_extract("a", r'(?is)href="([^"]*)"', 1).alias("url"))


def corpus_index(spark, path: str) -> DataFrame:
    """The index of a corpus folder: filepath, brand, type, inferred."""
    return spark.read.schema("filepath string, brand string, type string, inferred string").csv(path, header=True)


def index_files(spark, folder: str) -> DataFrame:
    """An index of the articles under folder/<brand>/: hidden folders go, the type is inferred from the name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder).select("path")
    below = F.split(F.substring_index("path", folder.rstrip("/") + "/", -1), "/")
    rows = files.select(F.array_join(below, "/").alias("filepath"), F.element_at(below, 1).alias("brand"), F.element_at(below, -1).alias("name")).where(~F.startswith("brand", F.lit("_")))
    return rows.select("filepath", "brand", article_type(F.col("name"), F.col("brand")).alias("type"), F.lit("true").alias("inferred")).orderBy("brand", "filepath")
