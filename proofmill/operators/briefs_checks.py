"""Checks of articles against their briefs: keywords and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import phrases
from .checks import check
from .document import full_text, of_type
from .findings import make, make_each
from .intervals import claimed
from .runs import highlighted_spans


def variant_hits(el: DataFrame, forms: DataFrame) -> DataFrame:
    """(doc_id, start, end and the other columns of forms): where a document has its own forms, in the whole text.

    forms: (doc_id, variant, …). All documents' variants are one lexicon, so the text is read once however many there are.
    """
    lexicon = phrases.terms(forms.select("variant").distinct(), "variant")
    found = phrases.hits(el.select("doc_id", "idx", "start_offset", "text"), lexicon)
    at = lambda c: (F.col("start_offset") + F.col(c)).alias({"s": "start", "e": "end"}[c])
    return found.select("doc_id", "variant", at("s"), at("e")).join(forms, ["doc_id", "variant"])


def keyword_hits(el: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, keyword, grp, start, end): occurrences that overlap none of a longer keyword.

    keywords: (doc_id, keyword, low, high, grp), a brief's few keywords per document. All variants of a keyword count as it.
    Longer keywords claim their places first, then keywords in alphabetical order, then earlier places.
    """
    forms = keywords.where("trim(keyword) <> ''").select("doc_id", "keyword", "grp", F.explode(T.keyword_variants(F.col("keyword"))).alias("variant"))
    first = Window.partitionBy("doc_id").orderBy(F.desc(F.length("keyword")), "keyword")
    found = variant_hits(el, forms.withColumn("rank", F.dense_rank().over(first)))
    return claimed(found.select("doc_id", "keyword", "grp", "rank", "start", "end"), "rank", "doc_id").drop("rank")


def keyword_counts(el: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, keyword, grp, low, high, n) of every keyword asked for; n may be 0."""
    hits = keyword_hits(el, keywords).groupBy("doc_id", "keyword").agg(F.count("*").alias("n"))
    return keywords.join(hits, ["doc_id", "keyword"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def nearby(el: DataFrame, keywords: DataFrame, reach: int = 50) -> DataFrame:
    """(doc_id, keyword) of keywords of several words that all begin within reach characters of one place of the first.

    A band join without pairs: the places of a keyword's words in one order, and a window of reach to either side.
    """
    words = F.transform(T.tokens(T.normal_keyword(F.col("keyword"))), lambda w, i: F.struct(w.alias("variant"), (i == 0).alias("first")))
    asked = keywords.select("doc_id", "keyword", F.explode(words).alias("w")).groupBy("doc_id", "keyword", F.col("w.variant").alias("variant")).agg(F.bool_or("w.first").alias("first"))
    asked = asked.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "keyword"))).where("n > 1")
    band = Window.partitionBy("doc_id", "keyword").orderBy("start").rangeBetween(-(reach - 1), reach - 1)
    found = variant_hits(el, asked).withColumn("start", F.col("start").cast("long"))
    return found.withColumn("near", F.size(F.collect_set("variant").over(band))).where("first AND near = n").select("doc_id", "keyword").distinct()


def document_words(el: DataFrame) -> DataFrame:
    return el.groupBy("doc_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"))


@check("keywords")
def keywords(el: DataFrame, asked: DataFrame, brand: str | None = None, market: str | None = None, max_density: float = 3.0, max_name: float = 2.0) -> DataFrame:
    """Keywords of the brief that are missing, too rare, too frequent or nowhere highlighted, and names that fill an article.

    Articles of fewer than 10 words are left out.
    """
    words = document_words(el).where("words >= 10")
    n = keyword_counts(el, asked).join(words, "doc_id").withColumn("idx", F.lit(0).cast("long"))
    zero, none = F.lit(0), F.lit("")
    absent = n.where("n = 0")
    close = nearby(el, absent.select("doc_id", "keyword")).withColumn("close", F.lit(True))
    missing = absent.join(close, ["doc_id", "keyword"], "left").withColumn("close", F.coalesce("close", F.lit(False)))
    out = make(missing, "keywords", F.when(F.col("close"), "wrong_construction").otherwise("truly_absent"), "keywords", "warning", 0.95, zero, zero, none, None, F.concat(F.lit("missing: "), "keyword"), False)
    few = n.where("n > 0 AND low IS NOT NULL AND n < low")
    out = out.unionByName(make(few, "keywords", "below_min", "keywords", "warning", 0.9, zero, zero, none, None, F.concat_ws(" ", "keyword", "n", F.lit("of"), "low"), False))
    many = n.where("high IS NOT NULL AND n > high")
    out = out.unionByName(make(many, "keywords", "above_max", "keywords", "warning", 0.9, zero, zero, none, None, F.concat_ws(" ", "keyword", "n", F.lit("of"), "high"), False))
    dense = n.groupBy("doc_id", "words").agg(F.sum("n").alias("n")).where(f"words >= 50 AND n * 100 / words > {max_density}").withColumn("idx", F.lit(0).cast("long"))
    out = out.unionByName(make(dense, "keywords", "density", "keywords", "warning", 0.95, zero, zero, none, None, "keywords fill the article", False))
    for name, sub, confidence in ((brand, "brand_overuse", 0.85), (market if market and len(market) > 2 else None, "location_overuse", 0.8)):
        if name:
            over = overuse(el, name, max_name).withColumn("idx", F.lit(0).cast("long"))
            out = out.unionByName(make(over, "keywords", sub, "keywords", "warning", confidence, zero, zero, none, None, F.lit(name), False))
    if "runs" in el.columns:  # without runs nothing is known of highlights
        out = out.unionByName(highlighting(el, asked))
    return out


def highlighting(el: DataFrame, asked: DataFrame) -> DataFrame:
    """Main keywords that occur but are nowhere a whole highlighted run, at their first occurrence."""
    main = asked.where("grp = 'main'")
    bare = unhighlighted(el, main, highlighted_spans(el).select("doc_id", "text"))
    first = keyword_hits(el, asked).groupBy("doc_id", "keyword").agg(F.min(F.struct("start", "end")).alias("at"))
    rows = bare.join(first, ["doc_id", "keyword"]).join(full_text(el), "doc_id").withColumn("idx", F.lit(0).cast("long"))
    seen = T.slice_text(F.col("full_text"), F.col("at.start"), F.col("at.end"))
    return make(rows, "keywords", "highlighting", "keywords", "suggestion", 0.85, F.col("at.start"), F.col("at.end"), seen, None, F.concat(F.lit("not highlighted: "), "keyword"), False)


def overuse(el: DataFrame, name: str, share: float = 2.0) -> DataFrame:
    """(doc_id, n, words): documents of which name is over share percent of the words."""
    import re

    n = el.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(rf"(?i)\b{re.escape(name)}\b"))).alias("n"), F.sum(T.word_count(F.col("text"))).alias("words"))
    return n.where(f"words >= 10 AND n * 100 / words > {share}")


def unhighlighted(el: DataFrame, asked: DataFrame, highlights: DataFrame) -> DataFrame:
    """Keywords that occur but are nowhere a whole highlighted run. highlights: (doc_id, text)."""
    marked = highlights.select("doc_id", T.normal_keyword(F.col("text")).alias("variant")).distinct()
    used = keyword_counts(el, asked).where("n > 0")
    forms = used.select("doc_id", "keyword", F.explode(T.keyword_variants(F.col("keyword"))).alias("variant")).join(marked, ["doc_id", "variant"], "left_semi")
    return used.join(forms.select("doc_id", "keyword").distinct(), ["doc_id", "keyword"], "left_anti").select("doc_id", "keyword", "n")


def missing_sections(el: DataFrame, required: DataFrame) -> DataFrame:
    """(doc_id, heading, present) of required sections that no heading covers; present: the first ten headings.

    required: (doc_id, heading), a brief's few sections per document.
    """
    heads = of_type(el, "heading").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("heads"))
    rows = required.where(~T.is_metadata_label(F.col("heading"))).join(heads, "doc_id", "left")
    covered = F.exists("heads", lambda h: T.fuzzy_heading(F.col("heading"), h))
    return rows.where(~F.coalesce(covered, F.lit(False))).select("doc_id", "heading", F.coalesce(F.slice("heads", 1, 10), F.array().cast("array<string>")).alias("present"))


def intro_outro(el: DataFrame) -> DataFrame:
    """(doc_id, first_heading, intro, last_type, last_words): what stands before the first heading and at the end."""
    # nothing but a row for each document is shuffled, and words are counted in its last leaf alone
    long = (F.col("elem_type") == "paragraph") & F.col("text").rlike(r"(?U)(?:\w++\W++){5}\w")
    last = F.max(F.when(F.trim("text") != "", F.struct("idx", "elem_type", "start_offset", "end_offset", "text")))
    head = F.min(F.when(F.col("elem_type") == "heading", F.col("idx")))
    rows = el.groupBy("doc_id").agg(head.alias("first_heading"), F.collect_list(F.when(long, F.col("idx"))).alias("long"), last.alias("l"))
    intro = F.size(F.filter("long", lambda i: i < F.col("first_heading"))).cast("long")
    return rows.select(
        "doc_id", "first_heading", intro.alias("intro"), F.col("l.elem_type").alias("last_type"), T.word_count(F.col("l.text")).cast("long").alias("last_words"), F.col("l.idx").alias("idx"), F.col("l.start_offset").alias("s"), F.col("l.end_offset").alias("e"), F.col("l.text").alias("t")
    )


def word_deviation(el: DataFrame, targets: DataFrame, share: float = 0.2) -> DataFrame:
    """(doc_id, words, target, direction, percent) where the count is more than share off. targets: (doc_id, target)."""
    off = (F.col("words") - F.col("target")) / F.col("target")
    rows = document_words(el).join(targets.where("target > 0"), "doc_id").where(F.abs(off) > share)
    return rows.select("doc_id", "words", "target", F.when(off > 0, "over").otherwise("under").alias("direction"), F.round(F.abs(off) * 100, 1).alias("percent"))


@check("structure")
def structure(el: DataFrame, required: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    from .checks import heading_rows

    text, s, e = F.col("text"), F.col("start_offset"), F.col("end_offset")
    zero, none, no = F.lit(0), F.lit(None), F.lit(False)
    out = make_each(heading_rows(el), "structure", [
        ((F.col("h1") > 1) & (F.col("h1_no") == 2) & (F.col("level") == 1), "multiple_h1", "structure", "warning", 0.95, s, e, text, none, "more than one H1", False),
        (F.coalesce(F.col("level") > F.col("prev_level") + 1, no), "hierarchy", "structure", "warning", 0.9, s, e, text, none, "a level is skipped", False),
    ])
    last = F.col("last_type") == "heading"
    out = out.unionByName(make_each(intro_outro(el), "structure", [
        (F.col("first_heading").isNotNull() & (F.col("intro") == 0), "intro", "structure", "suggestion", 0.75, zero, zero, F.lit(""), none, "no introduction", False),
        (F.coalesce(last | ((F.col("last_type") == "paragraph") & (F.col("last_words") < 20)), no), "outro", "structure", "suggestion", F.when(last, 0.8).otherwise(0.7), F.col("s"), F.col("e"), F.col("t"), none, "no closing paragraph", False),
    ]))
    if required is not None:
        gone = missing_sections(el, required).withColumn("idx", F.lit(0).cast("long"))
        out = out.unionByName(make(gone, "structure", "missing_section", "structure", "warning", 0.8, zero, zero, F.lit(""), None, F.concat(F.lit("missing: "), "heading"), False))
    if targets is not None:
        off = word_deviation(el, targets).withColumn("idx", F.lit(0).cast("long"))
        out = out.unionByName(make(off, "structure", "word_count", "structure", "warning", 0.9, zero, zero, F.lit(""), None, F.concat_ws(" ", "words", "direction", "target"), False))
    return out
