"""The document algebra: filters, sections, lookups, full text. Each works on an elements table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import in_order


def of_type(el: DataFrame, *kinds: str) -> DataFrame:
    return el.where(F.col("elem_type").isin(*kinds))


def full_text(el: DataFrame) -> DataFrame:
    """(doc_id, full_text): leaves in order, joined by line feeds."""
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return el.groupBy("doc_id").agg(parts.alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("full_text"))


#: What a section's rollups add up: rows of a kind and words before each row of a document.
SUMS = ("headings", "paragraphs", "words")


def sections(el: DataFrame) -> DataFrame:
    """One row per heading: section_idx, parent_idx, root_idx, title, level, and where the section ends.

    A section ends before the next heading of its level or a smaller one: next_idx (null if there is none) and end_offset,
    which leaves out the line feed before that heading. Levels run from 1 to 4, so the nearest heading of a smaller level is
    the largest of a few running values: forward for parents, and in descending order for ends. size is the number of rows
    of the section, SUMS what it holds, its own heading left out: differences of running sums at its two ends.
    """
    from ..functions.text import space_words

    paragraph = F.col("elem_type") == "paragraph"
    one = {"headings": F.col("elem_type") == "heading", "paragraphs": paragraph, "words": F.when(paragraph, space_words(F.col("text"))).otherwise(0)}
    whole = Window.partitionBy("doc_id")
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    upto = in_order().rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("doc_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    slim = el.select("doc_id", "idx", "elem_type", "level", F.when(one["headings"], F.col("text")).alias("title"), "start_offset", "end_offset", *(c.cast("long").alias(k) for k, c in one.items()))
    sums = [F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in SUMS]
    total = F.struct((F.max("idx").over(whole) + 1).alias("idx"), (F.max("end_offset").over(whole) + 1).alias("start_offset"), F.count("*").over(whole).alias("row"), *(F.sum(k).over(whole).alias(k) for k in SUMS))
    rows = slim.select("doc_id", "idx", "elem_type", "level", "title", "start_offset", (F.row_number().over(in_order()) - 1).cast("long").alias("row"), *sums, total.alias("total")).where("elem_type = 'heading'").drop("elem_type")
    rows = rows.withColumn("section_idx", (F.row_number().over(in_order()) - 1).cast("long"))
    last = [F.last(F.when(F.col("level") == k, F.col("idx")), ignorenulls=True).over(before) for k in (1, 2, 3)]
    parents = [F.when(F.col("level") > k, c) for k, c in zip((1, 2, 3), last)]
    here = F.struct("idx", "start_offset", "row", *SUMS)
    ends = [F.last(F.when(F.col("level") <= k, here), ignorenulls=True).over(later) for k in (1, 2, 3, 4)]
    top = F.min("level").over(before).isNull() | (F.col("level") <= F.min("level").over(before))
    rows = rows.withColumn("parent_idx", F.greatest(*parents)).withColumn("next", F.coalesce(*(F.when(F.col("level") == k, e) for k, e in zip((1, 2, 3, 4), ends))))
    rows = rows.withColumn("is_root", top)
    root = F.last(F.when(F.col("is_root"), F.col("idx")), ignorenulls=True).over(upto)
    root_ord = F.last(F.when(F.col("is_root"), F.col("section_idx")), ignorenulls=True).over(upto)
    end = F.coalesce("next", "total")
    held = [(end[k] - F.col(k) - (1 if k == "headings" else 0)).alias(k) for k in SUMS]
    return rows.select(
        "doc_id", "idx", "level", "title", "section_idx", "parent_idx", F.col("next.idx").alias("next_idx"), "is_root", root.alias("root_idx"), root_ord.alias("root_section"), "start_offset",
        (end["start_offset"] - 1).cast("long").alias("end_offset"), "row", (end["row"] - F.col("row")).alias("size"), *held,
    )


def with_sections(el: DataFrame) -> DataFrame:
    """Adds the top-level section of each element: section_index and section_title, null before the first heading."""
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    upto = in_order().rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("elem_type") == "heading"
    low = F.min(F.when(heading, F.col("level"))).over(before)
    root = heading & (low.isNull() | (F.col("level") <= low))
    ord_ = F.sum(heading.cast("int")).over(upto) - 1
    rows = el.withColumn("root", F.when(root, F.struct(ord_.cast("long").alias("i"), F.col("text").alias("t"))))
    rows = rows.withColumn("root", F.last("root", ignorenulls=True).over(upto))
    return rows.withColumn("section_index", F.col("root.i")).withColumn("section_title", F.col("root.t")).drop("root")


def at_offset(el: DataFrame, points: DataFrame) -> DataFrame:
    """The columns of points (doc_id, offset, …) and of el but text, for each point that lies in an element.

    An as-of merge: points and the starts of elements in one order, each point meets the last start before it or at it. An
    empty element holds no point, and no row is paired with more than one other.
    """
    order = Window.partitionBy("doc_id").orderBy("at", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    leaf = [c for c in el.columns if c not in ("doc_id", "text")]
    asked = points.select("doc_id", F.col("offset").alias("at"), F.lit(True).alias("is_point"), F.struct(*(c for c in points.columns if c != "doc_id")).alias("point"))
    placed = el.select("doc_id", F.col("start_offset").alias("at"), F.lit(False).alias("is_point"), F.struct(*leaf).alias("leaf"))
    rows = asked.unionByName(placed, allowMissingColumns=True).withColumn("leaf", F.last("leaf", ignorenulls=True).over(order))
    return rows.where(F.col("is_point") & (F.col("at") < F.col("leaf.end_offset"))).select("doc_id", "point.*", "leaf.*")


def element_counts(el: DataFrame) -> DataFrame:
    return el.groupBy("elem_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents read in two ways, by position: rows whose type or text differs, with the first differing character."""
    left = a.select("doc_id", "idx", F.col("elem_type").alias("type_a"), F.col("text").alias("text_a"))
    right = b.select("doc_id", "idx", F.col("elem_type").alias("type_b"), F.col("text").alias("text_b"))
    both = left.join(right, ["doc_id", "idx"], "full").where("NOT (type_a <=> type_b AND text_a <=> text_b)")
    n = F.least(F.length("text_a"), F.length("text_b"))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring("text_a", i, F.lit(1)) != F.substring("text_b", i, F.lit(1)))
    return both.withColumn("first_diff", F.coalesce(F.get(differ, 0) - 1, n).cast("long"))


def section_rollups(el: DataFrame) -> DataFrame:
    """(doc_id, section_idx, title, headings, paragraphs, words, text) of each section with all its subsections.

    The numbers come from sections(); a text is a slice of the document's lines, which are gathered once a document.
    """
    lines = el.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("lines"))
    heads = sections(el).groupBy("doc_id").agg(F.collect_list(F.struct("section_idx", "title", *SUMS, "row", "size")).alias("heads"))
    cut = lambda h: F.struct(h.alias("h"), F.array_join(F.slice("lines", (h["row"] + 1).cast("int"), h["size"].cast("int")), "\n").alias("text"))
    rows = heads.join(lines, "doc_id").select("doc_id", F.explode(F.transform("heads", cut)).alias("x"))
    return rows.select("doc_id", *(F.col(f"x.h.{c}").alias(c) for c in ("section_idx", "title", *SUMS)), "x.text")


def with_list_groups(el: DataFrame) -> DataFrame:
    """Adds list_no: list items without another element between them share the number of their list in the document."""
    item = F.col("elem_type") == "list_item"
    first = item & ~F.coalesce(F.lag("elem_type").over(in_order()) == "list_item", F.lit(False))
    rows = el.withColumn("first", first.cast("long"))
    return rows.withColumn("list_no", F.when(item, F.sum("first").over(in_order()))).drop("first")
