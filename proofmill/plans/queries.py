"""Queries over the driver's tables, one or more per operator family, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import briefs, briefs_checks, checks, document, edits, findings, persist, profile, reports, standards
from ..sources import config, corpus
from ..sources.tables import stored
from .articles import EL, HARD, SOFT, elements, spans_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TERMS = [(tier, w, config.stop_pattern(w)) for tier, ws in (("hard", HARD), ("soft", SOFT)) for w in ws]
OPERATORS = ["Moon Harbor", "Stake", "Royal", "Bet"]


def query(oracle: str | None = None, name: str | None = None):
    """Registers f(spark, sf_dir, el) under its name, with its oracle."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(spark, sf_dir, elements(spark, sf_dir))
        if oracle:
            ORACLE_SQL[key] = oracle
        return f

    return register


def long(*cols: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in cols]


# --- documents ---


@query(EL + "SELECT elem_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(start_offset) AS BIGINT) AS offsets FROM el GROUP BY 1")
def elements_offsets(spark, sf_dir, el):
    return el.groupBy("elem_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("start_offset").alias("offsets"))


@query(EL + "SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY idx)) AS digest FROM el GROUP BY 1")
def full_text(spark, sf_dir, el):
    return document.full_text(el).select("doc_id", F.md5("full_text").alias("digest"))


@query(EL + ", h AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS BIGINT) AS section_idx FROM el WHERE elem_type = 'heading') SELECT doc_id, idx, section_idx, CAST(level AS BIGINT) AS level, (SELECT max(p.idx) FROM h p WHERE p.doc_id = h.doc_id AND p.idx < h.idx AND p.level < h.level) AS parent_idx, (SELECT min(p.idx) FROM h p WHERE p.doc_id = h.doc_id AND p.idx > h.idx AND p.level <= h.level) AS next_idx FROM h")
def section_tree(spark, sf_dir, el):
    return document.sections(el).select("doc_id", "idx", "section_idx", *long("level"), "parent_idx", "next_idx")


@query(EL + ", r AS (SELECT *, CAST(sum(CASE WHEN elem_type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS BIGINT) AS o, min(level) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM el) SELECT doc_id, idx, max(CASE WHEN level IS NOT NULL AND (low IS NULL OR level <= low) THEN o END) OVER (PARTITION BY doc_id ORDER BY idx) AS section_index FROM r")
def section_of_element(spark, sf_dir, el):
    return document.with_sections(el).select("doc_id", "idx", "section_index")


@query("SELECT page_id AS doc_id, len(regexp_extract_all(html, '(?is)<a\\b[^>]*?href=\"[^\"]*\"[^>]*>.*?</a>')) AS links FROM pages WHERE len(regexp_extract_all(html, '(?is)<a\\b[^>]*?href=\"[^\"]*\"[^>]*>.*?</a>')) > 0")
def hyperlinks(spark, sf_dir, el):
    return corpus.hyperlinks(spark.read.parquet(f"{sf_dir}/pages.parquet")).groupBy("doc_id").agg(F.count("*").alias("links"))


@query()
def page_elements(spark, sf_dir, el):
    return corpus.from_html(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query(EL + "SELECT doc_id, CAST(sum(len(list_filter(string_split_regex(text, '[\\s]+'), lambda w: w <> ''))) AS BIGINT) AS words FROM el GROUP BY 1")
def word_counts(spark, sf_dir, el):
    return el.groupBy("doc_id").agg(F.sum(T.space_words(F.col("text"))).alias("words"))


# --- stop words ---

UNION_SW = " UNION ALL ".join(f"SELECT doc_id, idx, '{tier}' AS tier, '{w}' AS term, start_offset + s AS start_offset, m AS original_text FROM sw{i}" for i, (tier, w, _) in enumerate(TERMS))
SW = EL + "," + ",\n".join(spans_sql(f"sw{i}", p, "elem_type = 'paragraph'") for i, (_, _, p) in enumerate(TERMS)) + f", hits AS ({UNION_SW})"
GATE = ", w AS (SELECT doc_id, sum(len(list_filter(string_split_regex(text, '[\\s]+'), lambda w: w <> ''))) AS words FROM el WHERE elem_type = 'paragraph' GROUP BY 1), g AS (SELECT doc_id, count(*) AS soft, any_value(words) AS words FROM hits JOIN w USING (doc_id) WHERE tier = 'soft' GROUP BY 1 HAVING count(*) / any_value(words) > 0.005)"


@query(SW + "SELECT doc_id, idx, term, start_offset, original_text FROM hits WHERE tier = 'hard'")
def stop_words_hard(spark, sf_dir, el):
    return checks.stop_word_hits(el, TERMS).where("tier = 'hard'").select("doc_id", "idx", "term", (F.col("start_offset") + F.col("s")).alias("start_offset"), F.col("m").alias("original_text"))


@query(SW + GATE + "SELECT doc_id, soft, CAST(words AS BIGINT) AS words FROM g")
def stop_words_density(spark, sf_dir, el):
    return checks.soft_gate(el, checks.stop_word_hits(el, TERMS)).select("doc_id", "soft", "words")


@query(SW + GATE + "SELECT doc_id, tier AS sub_check, start_offset, original_text, substr(sha256('stop_words:' || start_offset || ':' || (start_offset + length(original_text)) || ':' || original_text), 1, 16) AS finding_id FROM hits WHERE tier = 'hard' OR doc_id IN (SELECT doc_id FROM g)")
def stop_word_findings(spark, sf_dir, el):
    found = findings.union([checks.stop_words(el, TERMS)])
    return found.select("doc_id", "sub_check", "start_offset", "original_text", "finding_id")


@query(SW + ", w AS (SELECT doc_id, sum(len(list_filter(string_split_regex(text, '[\\s]+'), lambda w: w <> ''))) AS words FROM el WHERE elem_type = 'paragraph' GROUP BY 1), n AS (SELECT doc_id, count(*) FILTER (tier = 'hard') AS hard, count(*) FILTER (tier = 'soft') AS soft FROM hits GROUP BY 1) SELECT doc_id, coalesce(hard, 0) AS hard, coalesce(soft, 0) AS soft, CAST(words AS BIGINT) AS total_words FROM w LEFT JOIN n USING (doc_id)")
def stop_word_counts(spark, sf_dir, el):
    return checks.stop_word_counts(el, TERMS).select("doc_id", *long("hard", "soft", "total_words"))


# --- voice ---


@query()
def voice_rewrite(spark, sf_dir, el):
    return checks.voice(el).select("doc_id", "sub_check", "start_offset", "original_text", "proposed_text", "auto_applicable")


# --- headings ---

HEAD = EL + ", w AS (SELECT *, lag(start_offset + length(text)) OVER (PARTITION BY doc_id ORDER BY idx) AS pe FROM el), h AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY idx) AS pl FROM w WHERE elem_type = 'heading')"


def heading_query(sub: str, oracle: str | None):
    def run(spark, sf_dir, el):
        return checks.headings(el).where(F.col("sub_check") == sub).select("doc_id", "start_offset", "original_text", "proposed_text")

    query(oracle, f"heading_{sub}")(run)


heading_query("blank_line", HEAD + "SELECT doc_id, start_offset, text AS original_text, CAST(NULL AS VARCHAR) AS proposed_text FROM h WHERE pe IS NOT NULL AND start_offset - pe <= 1")
heading_query("skipped_level", HEAD + "SELECT doc_id, start_offset, text AS original_text, CAST(NULL AS VARCHAR) AS proposed_text FROM h WHERE level > pl + 1")


# --- currency ---


@query()
def currency_styles(spark, sf_dir, el):
    return checks.currency_occurrences(el).groupBy("doc_id", "style").agg(F.count("*").alias("n"))


@query(EL + ", o AS (SELECT doc_id, len(regexp_extract_all(text, '\\$500 USD ')) AS both_n, len(regexp_extract_all(text, '€30 ')) AS sym, len(regexp_extract_all(text, '25 EUR ')) AS code FROM el WHERE elem_type = 'paragraph' AND regexp_matches(text, '\\$500 USD |€30 |25 EUR ')) SELECT doc_id, CAST(sum(sym) AS BIGINT) AS symbols, CAST(sum(code) AS BIGINT) AS codes, CASE WHEN sum(sym) + sum(code) = 0 THEN NULL WHEN sum(sym) >= sum(code) THEN 'symbol' ELSE 'code' END AS dominant FROM o GROUP BY 1")
def currency_dominant(spark, sf_dir, el):
    return checks.currency_dominance(checks.currency_occurrences(el)).select("doc_id", *long("symbols", "codes"), "dominant")


@query()
def currency_conventions(spark, sf_dir, el):
    rows = checks.currency_conventions(checks.currency_occurrences(el))
    return rows.select("doc_id", F.array_join("prose", ",").alias("prose"), F.array_join("tables", ",").alias("tables"))


@query()
def currency_findings(spark, sf_dir, el):
    return checks.currency(el).select("doc_id", "sub_check", "start_offset", "original_text", "proposed_text", "auto_applicable")


# --- formatting ---


def format_query(sub: str, oracle: str | None):
    def run(spark, sf_dir, el):
        return checks.formatting(el).where(F.col("sub_check") == sub).select("doc_id", "start_offset", "original_text", "proposed_text")

    query(oracle, f"fmt_{sub}")(run)


FIX = "SELECT doc_id, start_offset + s AS start_offset, m AS original_text, {} AS proposed_text FROM f"
format_query("double_space", EL + "," + spans_sql("f", "  +") + FIX.format("' '"))
format_query("latin", EL + "," + spans_sql("f", r"(?i)\b(?:e\.g\.|i\.e\.|etc\.|viz\.|cf\.)", "elem_type IN ('paragraph', 'heading')") + FIX.format("CASE lower(m) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.LATIN.items()) + " END"))


# --- spelling ---


# --- brands ---


@query(EL + ", n AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '\\bmoon harbor\\b'))) AS BIGINT) AS n FROM el GROUP BY 1) SELECT doc_id, 'Moon Harbor' AS name, n FROM n WHERE n >= 5")
def dominant_operator(spark, sf_dir, el):
    return checks.dominant_operator(el, ["Moon Harbor"]).select("doc_id", "name", "n")


@query(EL + "," + spans_sql("f", r"(?i)\bmoon[\s\-]*harbor\b") + "SELECT m AS form, count(*) AS n FROM f GROUP BY 1")
def brand_forms(spark, sf_dir, el):
    return checks.canonical_forms(el, "MoonHarbor")


# --- keywords and structure ---


def asked(el: DataFrame) -> DataFrame:
    """Two keywords for every article, as its brief would list them."""
    words = F.array(F.struct(F.lit("however").alias("keyword"), F.lit(2).alias("low"), F.lit(3).alias("high"), F.lit("main").alias("grp")), F.struct(F.lit("welcome").alias("keyword"), F.lit(1).alias("low"), F.lit(None).cast("int").alias("high"), F.lit("main").alias("grp")))
    return el.select("doc_id").distinct().select("doc_id", F.explode(words).alias("k")).select("doc_id", "k.*")


KW = EL + ", k AS (SELECT * FROM (VALUES ('however', 2, 3), ('welcome', 1, NULL)) t(keyword, low, high)), n AS (SELECT doc_id, keyword, low, high, CAST(sum(len(regexp_extract_all(lower(text), '\\b(?:' || keyword || '|' || keyword || 's)\\b'))) AS BIGINT) AS n FROM el, k GROUP BY ALL)"


@query(KW + "SELECT doc_id, keyword, n FROM n")
def keyword_counts(spark, sf_dir, el):
    return briefs_checks.keyword_counts(el, asked(el)).select("doc_id", "keyword", "n")


@query(KW + "SELECT doc_id, keyword, n, CASE WHEN n = 0 THEN 'missing' WHEN n < low THEN 'below' ELSE 'above' END AS verdict FROM n WHERE n < low OR n > high")
def keyword_quantity(spark, sf_dir, el):
    n = briefs_checks.keyword_counts(el, asked(el)).where("n < low OR n > high")
    return n.select("doc_id", "keyword", "n", F.when(F.col("n") == 0, "missing").when(F.col("n") < F.col("low"), "below").otherwise("above").alias("verdict"))


@query()
def keyword_findings(spark, sf_dir, el):
    return briefs_checks.keywords(el, asked(el), brand="MoonHarbor", market="Canada").select("doc_id", "sub_check", "reasoning")


@query(EL + "SELECT doc_id, arg_max(elem_type, idx) AS last_type, arg_max(start_offset, idx) AS start_offset FROM el WHERE trim(text) <> '' GROUP BY 1")
def structure_last_element(spark, sf_dir, el):
    return briefs_checks.intro_outro(el).where("last_type IS NOT NULL").select("doc_id", "last_type", F.col("s").alias("start_offset"))


# --- the whole run ---


def all_findings(spark, el: DataFrame) -> DataFrame:
    """Every check over elements that are built once."""
    el = stored(el, "elements")
    parts = [checks.stop_words(el, TERMS), checks.voice(el), checks.headings(el), checks.currency(el), checks.formatting(el), checks.locale_spelling(el, "american"), checks.brand_names(el, "MoonHarbor", OPERATORS), briefs_checks.structure(el)]
    return findings.union(parts)


@query()
def findings_by_check(spark, sf_dir, el):
    return findings.by_check(all_findings(spark, el))


@query()
def findings_summary(spark, sf_dir, el):
    return findings.summary(all_findings(spark, el))


@query()
def findings_by_label(spark, sf_dir, el):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    n = all_findings(spark, el).groupBy("doc_id").agg(F.count("*").alias("n"))
    return labels.join(n, "doc_id", "left").groupBy("quality").agg(F.count("*").alias("docs"), F.sum("n").alias("findings"))


def fixes(el: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements and the findings of two checks over them, each computed once."""
    el = stored(el, "elements")
    return el, stored(findings.union([checks.formatting(el), checks.brand_names(el, "MoonHarbor", [])]), "findings")


EDIT = EL + "," + spans_sql("d", "  +") + ", c AS (SELECT doc_id, idx, count(*) AS n, sum(length(m) - 1) AS less FROM d GROUP BY 1, 2)"


@query(EDIT + "SELECT doc_id, CAST(sum(n) AS BIGINT) AS applied, CAST(sum(less) AS BIGINT) AS shorter FROM c GROUP BY 1")
def edits_applied(spark, sf_dir, el):
    el = stored(el, "elements")
    found = findings.union([checks.formatting(el).where("sub_check = 'double_space'")])
    judged = stored(edits.resolved(edits.validated(found, el)), "edits")
    chars = lambda df, c: df.groupBy("doc_id").agg(F.sum(F.length("text")).alias(c))
    n = judged.where("status = 'applied'").groupBy("doc_id").agg(F.count("*").alias("applied"))
    return n.join(chars(el, "a"), "doc_id").join(chars(edits.applied(el, judged), "b"), "doc_id").select("doc_id", "applied", (F.col("a") - F.col("b")).alias("shorter"))


@query()
def edits_resolved(spark, sf_dir, el):
    el, found = fixes(el)
    return edits.resolved(edits.validated(found, el)).groupBy("doc_id", "status").agg(F.count("*").alias("n"))


@query()
def comments(spark, sf_dir, el):
    el, found = fixes(el)
    return reports.comments(el, found, edits.resolved(edits.validated(found, el))).select("doc_id", "no", "batch", "section", "location", "issue", "severity", "check_name")


@query()
def run_summary(spark, sf_dir, el):
    el, found = fixes(el)
    return reports.run_summary(found, edits.resolved(edits.validated(found, el)))


@query(EL + ", w AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS pt FROM el) SELECT doc_id, idx FROM w WHERE pt IS NOT NULL AND trim(text) <> '' AND trim(pt) <> ''")
def blank_rows(spark, sf_dir, el):
    return edits.blank_rows(el)


@query(
    "SELECT * FROM (VALUES ('none', 'main_review', 'au', NULL, NULL, NULL, 'none', 'hint'), (NULL, 'privacy_policy', 'au', NULL, NULL, NULL, 'none', 'article type'), (NULL, 'payments', 'Canada', NULL, NULL, NULL, 'required', 'market'), (NULL, 'general', NULL, 'Review AU.docx', NULL, NULL, 'required', 'file name'), (NULL, 'general', NULL, NULL, NULL, '20Bet', 'required', 'brand'), (NULL, NULL, NULL, NULL, NULL, NULL, 'proposal', 'default')) t(hint, article_type, market, filename, brand_setting, brand, blank_rows, reason)"
)
def blank_rows_setting(spark, sf_dir, el):
    rows = [("none", "main_review", "au", None, None, None), (None, "privacy_policy", "au", None, None, None), (None, "payments", "Canada", None, None, None), (None, "general", None, "Review AU.docx", None, None), (None, "general", None, None, None, "20Bet"), (None,) * 6]
    return reports.blank_rows_setting(spark.createDataFrame(rows, "hint string, article_type string, market string, filename string, brand_setting string, brand string"))


# --- profiles ---

LAYER = "CASE WHEN grouping(article_type) = 0 THEN 'type' WHEN grouping(brand) = 0 THEN 'brand' ELSE 'house' END AS layer, CASE WHEN grouping(article_type) = 0 THEN article_type WHEN grouping(brand) = 0 THEN brand ELSE 'house' END AS layer_name"
SETS = "GROUP BY GROUPING SETS ((), (article_type), (brand))"


@query(EL + f"SELECT {LAYER}, count(DISTINCT doc_id) AS articles FROM el {SETS}")
def profile_articles(spark, sf_dir, el):
    return profile.article_counts(el)


@query(EL + f", p AS (SELECT *, length(text) - length(replace(text, ',', '')) AS c, length(text) - length(replace(text, ';', '')) AS s, len(list_filter(string_split_regex(text, '[\\s]+'), lambda w: w <> '')) AS w FROM el WHERE elem_type = 'paragraph') SELECT {LAYER}, CAST(sum(c) AS BIGINT) AS commas, CAST(sum(s) AS BIGINT) AS semicolons, CAST(sum(w) AS BIGINT) AS words FROM p {SETS}")
def profile_punctuation(spark, sf_dir, el):
    return profile.punctuation(el).select("layer", "layer_name", *long("commas", "semicolons", "words"))


@query(EL + f"SELECT {LAYER}, count(*) FILTER (elem_type = 'list_item') AS items FROM el {SETS}")
def profile_lists(spark, sf_dir, el):
    return profile.list_frequency(el).select("layer", "layer_name", *long("items"))


# --- text functions over small tables ---


@query("SELECT conv_id AS doc_id, role, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM conversations")
def conversation_offsets(spark, sf_dir, el):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "role", F.col("turn").alias("idx"), "text")
    return corpus.with_offsets(turns).select("doc_id", "role", F.col("idx").alias("turn"), "start_offset")


# --- briefs: two small workbooks as cells ---

BRIEF = (
    ("b1", "Brief", 1, 1, "Task"), ("b1", "Brief", 1, 2, "Casino review"), ("b1", "Brief", 2, 1, "Market"), ("b1", "Brief", 2, 2, "Canada"), ("b1", "Brief", 3, 1, "Word count: 1200"),
    ("b1", "Brief", 5, 1, "Main keywords"), ("b1", "Brief", 5, 2, "Qty"), ("b1", "Brief", 6, 1, "moon casino"), ("b1", "Brief", 6, 2, "1-3"), ("b1", "Brief", 7, 1, "moon bonus (bonus)"), ("b1", "Brief", 7, 2, "Min 2"),
    ("b1", "Brief", 5, 7, "Section"), ("b1", "Brief", 5, 8, "Words"), ("b1", "Brief", 6, 7, "Bonuses"), ("b1", "Brief", 6, 8, "300"), ("b1", "Brief", 7, 7, "Banking"), ("b1", "Brief", 7, 8, "200"),
    ("b1", "Brief", 12, 1, "Link 1 - Anchor"), ("b1", "Brief", 12, 2, "play"), ("b1", "Brief", 13, 1, "Link 1 - URL"), ("b1", "Brief", 13, 2, "/play"),
    ("b2", "Sheet1", 1, 1, "Keywords: slots, free spins (3x), rtp / demo"), ("b3", "One", 1, 1, "x"), ("b3", "Two", 1, 1, "y"),
)


def cells(spark):
    return spark.createDataFrame(BRIEF, "brief_id string, sheet string, row int, col int, value string")


@query("SELECT * FROM (VALUES ('b1', 'moon casino', 1, 3, 'main', 'sure'), ('b1', 'moon bonus', 2, NULL, 'main', 'sure'), ('b2', 'slots', NULL, NULL, 'main', 'weak'), ('b2', 'free spins', 3, 3, 'main', 'weak'), ('b2', 'rtp', NULL, NULL, 'main', 'weak'), ('b2', 'demo', NULL, NULL, 'main', 'weak')) t(brief_id, keyword, low, high, grp, trust)")
def brief_keywords(spark, sf_dir, el):
    return briefs.keywords(cells(spark)).select("brief_id", "keyword", "low", "high", "grp", F.when(F.col("confidence") > 0.9, "sure").otherwise("weak").alias("trust"))


@query("SELECT * FROM (VALUES ('b1', 'Bonuses', 300), ('b1', 'Banking', 200)) t(brief_id, heading, word_count)")
def brief_sections(spark, sf_dir, el):
    return briefs.sections(cells(spark)).select("brief_id", "heading", "word_count")


@query("SELECT * FROM (VALUES ('b1', 'play', '/play', 'internal')) t(brief_id, anchor, url, link_type)")
def brief_links(spark, sf_dir, el):
    return briefs.links(cells(spark)).select("brief_id", "anchor", "url", "link_type")


@query("SELECT * FROM (VALUES ('b1', 'READY', 'main_review'), ('b2', 'NEEDS_CLARIFICATION', 'game_review'), ('b3', 'NEEDS_TASK_SELECTION', 'general')) t(brief_id, state, article_type)")
def brief_state(spark, sf_dir, el):
    return briefs.parse(cells(spark)).select("brief_id", "state", "article_type")


@query("SELECT * FROM (VALUES ('b2', 'keywords'), ('b2', 'sections'), ('b2', 'target_word_count'), ('b3', 'keywords'), ('b3', 'sections'), ('b3', 'article_type'), ('b3', 'target_word_count')) t(brief_id, field)")
def brief_clarifications(spark, sf_dir, el):
    return briefs.clarifications(briefs.parse(cells(spark))).select("brief_id", "field")


# --- standards and persistence ---


@query(EL + "SELECT doc_id, CAST(max(start_offset + length(text)) AS BIGINT) AS total_length, count(*) AS elements FROM el GROUP BY 1")
def documents_json(spark, sf_dir, el):
    back = persist.from_json(persist.documents(el).select("json"), "doc_id long, total_length long, elements array<struct<idx:long>>")
    return back.select("doc_id", "total_length", F.size("elements").cast("long").alias("elements"))


@query(EL + "," + spans_sql("f", "  +") + "SELECT doc_id, count(*) AS findings FROM f GROUP BY 1")
def findings_json(spark, sf_dir, el):
    found = findings.union([checks.formatting(el).where("sub_check = 'double_space'")])
    back = persist.from_json(persist.to_json(found), persist.FINDING)
    return back.groupBy("doc_id").agg(F.count("*").alias("findings"))


@query()
def findings_report(spark, sf_dir, el):
    return persist.findings_report(fixes(el)[1])


@query()
def comment_counts(spark, sf_dir, el):
    el, found = fixes(el)
    return persist.comment_counts(reports.comments(el, found, edits.resolved(edits.validated(found, el))))


@query(EL + "SELECT elem_type, count(*) AS n FROM el WHERE elem_type IN ('heading', 'list_item') GROUP BY 1")
def elements_of_type(spark, sf_dir, el):
    return document.of_type(el, "heading", "list_item").groupBy("elem_type").agg(F.count("*").alias("n"))
