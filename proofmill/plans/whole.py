"""Queries that hold an operator against SQL over every row and the whole of its texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import briefs_checks, checks, document, findings, phrases, profile, standards
from ..sources.config import brand_pattern, operator_pattern
from .articles import EL, HARD, SOFT, spans_sql
from .queries import LAYER, OPERATORS, SETS, query


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def words_in(column: str) -> str:
    """Words between white space, in SQL."""
    return f"list_filter(string_split_regex({column}, '\\s+'), lambda w: w <> '')"


# --- documents ---

POINTS = """, e AS (SELECT doc_id, max(start_offset + length(text)) AS n FROM el GROUP BY 1),
p AS (SELECT doc_id, CAST(unnest(range(0, n + 1, 40)) AS BIGINT) AS o FROM e UNION SELECT doc_id, start_offset FROM el)
SELECT doc_id, idx, o AS "offset" FROM p JOIN el USING (doc_id) WHERE o >= start_offset AND o < start_offset + length(text)"""


@query(EL + POINTS)
def element_at_offset(spark, sf_dir, el):
    """Points at every 40th character of the whole document, and at the first character of each element."""
    last = F.max(F.col("start_offset") + F.length("text"))
    steps = F.sequence(F.lit(0).cast("long"), F.col("n").cast("long"), F.lit(40).cast("long"))
    every = el.groupBy("doc_id").agg(last.alias("n")).select("doc_id", F.explode(steps).alias("offset"))
    points = every.union(el.select("doc_id", F.col("start_offset").cast("long"))).distinct()
    return document.at_offset(el, points).select("doc_id", "idx", "offset")


ROLLUPS = f"""
, h AS (SELECT doc_id, idx, text AS title, level, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS BIGINT) AS section_idx FROM el WHERE elem_type = 'heading'),
r AS (SELECT h.*, coalesce((SELECT min(n.idx) FROM h n WHERE n.doc_id = h.doc_id AND n.idx > h.idx AND n.level <= h.level), 1000000000) AS upto FROM h)
SELECT r.doc_id, section_idx, any_value(title) AS title, count(*) FILTER (elem_type = 'heading' AND el.idx > r.idx) AS headings, count(*) FILTER (elem_type = 'paragraph') AS paragraphs,
  CAST(sum(CASE WHEN elem_type = 'paragraph' THEN len({words_in("text")}) ELSE 0 END) AS BIGINT) AS words, md5(string_agg(text, chr(10) ORDER BY el.idx)) AS digest
FROM r JOIN el ON el.doc_id = r.doc_id AND el.idx >= r.idx AND el.idx < r.upto GROUP BY 1, 2"""


@query(EL + ROLLUPS)
def section_rollups(spark, sf_dir, el):
    return document.section_rollups(el).withColumn("digest", F.md5("text")).drop("text")


ISLANDS = """
, b AS (SELECT *, elem_type = 'list_item' AND coalesce(lag(elem_type) OVER (PARTITION BY doc_id ORDER BY idx) <> 'list_item', true) AS first FROM el)
SELECT doc_id, idx, CAST(list_no AS BIGINT) AS list_no FROM (SELECT *, count(*) FILTER (first) OVER (PARTITION BY doc_id ORDER BY idx) AS list_no FROM b) WHERE elem_type = 'list_item'"""


@query(EL + ISLANDS)
def list_groups(spark, sf_dir, el):
    return document.with_list_groups(el).where("list_no IS NOT NULL").select("doc_id", "idx", "list_no")


@query(EL + "," + spans_sql("f", "  +") + "SELECT 'double_space' AS sub_check, m AS original_text, count(*) AS n FROM f GROUP BY 1, 2")
def finding_counts(spark, sf_dir, el):
    return findings.counts(checks.formatting(el).where("sub_check = 'double_space'"), "sub_check", "original_text")


# --- excluded spans ---

EXCLUDED = {"u": L.URL, "a": L.EMAIL, "q": L.QUOTED}
SPANS = "".join(", " + spans_sql(f"x{k}", "(?i)" + p) for k, p in EXCLUDED.items())
SPANS += ", xs AS (" + " UNION ALL ".join(f"SELECT doc_id, idx, s, s + length(m) AS e FROM x{k}" for k in EXCLUDED) + ")"
OUTSIDE = "NOT EXISTS (SELECT 1 FROM xs WHERE xs.doc_id = f.doc_id AND xs.idx = f.idx AND f.s >= xs.s AND f.s + length(f.m) <= xs.e)"


@query(EL + SPANS + " SELECT doc_id, idx, count(*) AS spans FROM xs GROUP BY 1, 2")
def excluded_spans(spark, sf_dir, el):
    return el.select("doc_id", "idx", F.size(phrases.excluded(F.col("text"))).cast("long").alias("spans")).where("spans > 0")


# --- voice and headings ---

NOUNS = "(?i)\\b(" + "|".join(sorted(L.READER_NOUNS, key=len, reverse=True)) + ")\\b"


@query(EL + f", n AS (SELECT doc_id, len(regexp_extract_all(text, '{NOUNS}')) AS n FROM el WHERE elem_type = 'paragraph') SELECT doc_id, CAST(sum(n) AS BIGINT) AS nouns FROM n GROUP BY 1 HAVING sum(n) > 0")
def voice_nouns(spark, sf_dir, el):
    return checks.person_references(el).groupBy("doc_id").agg(F.count("*").alias("nouns"))


UPPER = "CASE WHEN {0} LIKE 'ß%' THEN 'SS' ELSE upper(substr({0}, 1, 1)) END || lower(substr({0}, 2))"
LETTERS = "lower(regexp_replace(x, '[^A-Za-z]', '', 'g'))"
ACRONYM = "CASE " + " ".join(f"WHEN {LETTERS} = '{a.lower()}' THEN replace(x, '{a.lower()}', '{a}')" for a in L.ACRONYMS)
TITLE = f"""
, t AS (SELECT doc_id, idx, text, string_split(text, ' ') AS a FROM el WHERE elem_type = 'heading'),
n AS (SELECT doc_id, idx, text, list_transform(a, lambda x, i: {ACRONYM}
  WHEN i > 1 AND i < len(a) AND lower(x) IN ({quoted(L.MINOR_WORDS)}) THEN lower(x) ELSE {UPPER.format("x")} END) AS b FROM t)
SELECT doc_id, idx, array_to_string(b, ' ') AS title FROM n WHERE array_to_string(b, ' ') <> text"""


@query(EL + TITLE)
def heading_title_case(spark, sf_dir, el):
    """All headings, with other letters than ASCII and acronyms too."""
    h = document.of_type(el, "heading").select("doc_id", "idx", "text", T.title_case(F.col("text")).alias("title"))
    return h.where("title <> text").select("doc_id", "idx", "title")


# --- formatting ---

PUNCT = (
    EL + "," + spans_sql("f", " +[,;:!?.]")
    + """, g AS (SELECT *, m LIKE '%.' AS dot, s > 0 AND substr(text, s, 1) = '.' AS behind, substr(text, s + length(m) + 1, 1) = '.' AS again FROM f)
SELECT doc_id, start_offset + s + CASE WHEN dot AND behind THEN 1 ELSE 0 END AS start_offset,
  CASE WHEN dot AND behind THEN substr(m, 2) ELSE m END AS original_text, ltrim(m) AS proposed_text
FROM g WHERE NOT dot OR (NOT again AND (NOT behind OR length(m) > 2))"""
)


@query(PUNCT)
def fmt_space_before_punct(spark, sf_dir, el):
    rows = checks.formatting(el).where("sub_check = 'space_before_punct'")
    return rows.select("doc_id", "start_offset", "original_text", "proposed_text")


BACK = "lower(substr(text, CAST(greatest(s - {0}, 0) AS INTEGER) + 1, CAST(least(s, {0}) AS INTEGER) + {1}))"
SHORT = " OR ".join(f"contains({BACK.format(4, 3)}, '{a}')" for a in L.SHORT_FORMS)
AFTER = "regexp_extract(lower(substr(text, CAST(s AS INTEGER) + 2, 200)), '^\\S+')"
MISSING = (
    EL + "," + spans_sql("f", "[,.][A-Za-z]")
    + f"""SELECT doc_id, start_offset + s AS start_offset, m AS original_text, m[1] || ' ' || m[2] AS proposed_text FROM f
WHERE NOT (m[1] = '.' AND (regexp_matches({BACK.format(1, 0)}, '[0-9]') OR regexp_matches({AFTER}, '^({"|".join(L.DOMAINS)})') OR {AFTER} IN ({quoted(L.FILE_TYPES)})))
AND NOT ({SHORT}) AND NOT regexp_matches({BACK.format(20, 0)}, 'http|www\\.')"""
)


@query(MISSING)
def fmt_missing_space(spark, sf_dir, el):
    rows = checks.formatting(el).where("sub_check = 'missing_space'")
    return rows.select("doc_id", "start_offset", "original_text", "proposed_text")


# --- spelling and brands ---

AMERICAN = {w: r for k, w, r in L.swaps() if k == "american"}
KEPT = "CASE WHEN upper(m) = m AND lower(m) <> m THEN upper(r) WHEN upper(m[1]) = m[1] AND lower(m[1]) <> m[1] THEN upper(r[1]) || substr(r, 2) ELSE lower(r) END"
SWAPS = (
    EL + "," + spans_sql("f", r"(?i)\b(?:" + "|".join(sorted(AMERICAN, key=lambda w: (-len(w), w))) + r")\b") + SPANS
    + ", w(wrong, r) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in AMERICAN.items()) + ")"
    + f" SELECT doc_id, start_offset + s AS start_offset, m AS original_text, {KEPT} AS proposed_text FROM f JOIN w ON lower(f.m) = w.wrong WHERE {OUTSIDE}"
)


@query(SWAPS)
def spelling_swaps(spark, sf_dir, el):
    """Every word of the list, wherever no quote, address or URL holds it."""
    return checks.locale_spelling(el, "american").select("doc_id", "start_offset", "original_text", "proposed_text")


@query(EL + "," + spans_sql("f", brand_pattern("MoonHarbor")) + SPANS + f" SELECT doc_id, start_offset + s AS start_offset, m AS original_text, 'MoonHarbor' AS proposed_text FROM f WHERE m <> 'MoonHarbor' AND {OUTSIDE}")
def brand_normalise(spark, sf_dir, el):
    rows = checks.brand_names(el, "MoonHarbor", []).where("sub_check = 'own_brand'")
    return rows.select("doc_id", "start_offset", "original_text", "proposed_text")


MENTIONS = EL + "".join("," + spans_sql(f"o{i}", operator_pattern(o)) for i, o in enumerate(OPERATORS)) + SPANS
MENTIONS += ", f AS (" + " UNION ALL ".join(f"SELECT *, '{o}' AS name FROM o{i}" for i, o in enumerate(OPERATORS)) + f"), k AS (SELECT * FROM f WHERE {OUTSIDE})"
MENTIONS += """, c AS (SELECT doc_id, name, count(*) AS n, min(start_offset + s) AS first FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(n) OVER w, 0) AS second FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, first, name)),
d AS (SELECT doc_id, name, n, second FROM r WHERE r = 1 AND n >= 5 AND (n >= 2 * second OR n - second >= 10)) """
COMMON = f"lower(m) IN ({quoted(L.AMBIGUOUS_OPERATORS)}) AND (NOT regexp_matches(m, '^[A-Z]') OR regexp_matches({BACK.format(15, 0)}, '({'|'.join(L.COMMON_PREFIXES)})$'))"


@query(MENTIONS + f"SELECT doc_id, start_offset + s AS start_offset, m AS original_text FROM k WHERE NOT ({COMMON}) AND NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = k.doc_id AND d.name = k.name)")
def competitor_mentions(spark, sf_dir, el):
    return checks.brand_names(el, "Other", OPERATORS).where("sub_check = 'competitor'").select("doc_id", "start_offset", "original_text")


@query(MENTIONS + "SELECT doc_id, name, n, CAST(second AS BIGINT) AS second FROM d", name="dominant_operators")
def dominant_operators(spark, sf_dir, el):
    return checks.dominant_operator(el, OPERATORS)


# --- claims ---

KINDS = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(m), '{w}')''' for w in ws)} THEN '{k}'" for k, ws in L.CLAIM_KINDS.items()) + " ELSE 'generic' END"
PARTS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS category, m, regexp_extract(m, '(?i){p}', 1) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i){p}')) AS m FROM el WHERE elem_type = 'paragraph')"
    for k, p in L.CLAIM_PATTERNS.items()
)
CLAIMS = EL + f", c AS ({PARTS}), v AS (SELECT *, coalesce(TRY_CAST(regexp_replace(regexp_replace(value, '[$,\\s]', '', 'g'), '(?i)[x%+]$', '') AS DOUBLE), 0) AS number, {KINDS} AS kind FROM c)"
CLAIMS += " SELECT doc_id, category, kind, value, count(*) AS n FROM v WHERE NOT (category = 'GAME_COUNT' AND number < 10) AND NOT (category = 'BONUS_AMOUNT' AND number < 5) GROUP BY 1, 2, 3, 4"


@query(CLAIMS)
def claims(spark, sf_dir, el):
    return checks.claims(el).groupBy("doc_id", "category", "kind", "value").agg(F.count("*").alias("n"))


# --- structure ---

WORD = r"[\p{L}\p{N}\p{M}_]+"
INTRO = f"""
, h AS (SELECT *, min(idx) FILTER (elem_type = 'heading') OVER (PARTITION BY doc_id) AS h FROM el),
n AS (SELECT doc_id, any_value(h) AS h, count(*) FILTER (elem_type = 'paragraph' AND idx < h AND len(regexp_extract_all(text, '{WORD}')) > 5) AS intro FROM h GROUP BY 1)
SELECT doc_id FROM n WHERE h IS NOT NULL AND intro = 0"""
OUTRO = f"""
, l AS (SELECT doc_id, arg_max(elem_type, idx) AS kind, arg_max(text, idx) AS text, arg_max(start_offset, idx) AS start_offset FROM el WHERE trim(text) <> '' GROUP BY 1)
SELECT doc_id, start_offset, text AS original_text, CASE WHEN kind = 'heading' THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM l
WHERE kind = 'heading' OR (kind = 'paragraph' AND len(regexp_extract_all(text, '{WORD}')) < 20)"""


@query(EL + INTRO)
def structure_intro(spark, sf_dir, el):
    """Documents of every language."""
    return briefs_checks.structure(el).where("sub_check = 'intro'").select("doc_id")


@query(EL + OUTRO)
def structure_outro(spark, sf_dir, el):
    return briefs_checks.structure(el).where("sub_check = 'outro'").select("doc_id", "start_offset", "original_text", "confidence")


DEVIATION = f"""
, n AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '{WORD}'))) AS BIGINT) AS words FROM el GROUP BY 1)
SELECT doc_id, words, 400 AS target, CASE WHEN words > 400 THEN 'over' ELSE 'under' END AS direction, round(abs(words - 400) / 400 * 100, 1) AS percent
FROM n WHERE abs(words - 400) / 400 > 0.2"""


@query(EL + DEVIATION)
def word_count_deviation(spark, sf_dir, el):
    return briefs_checks.word_deviation(el, el.select("doc_id").distinct().withColumn("target", F.lit(400)))


# --- profiles ---


@query(EL + f", ph(phrase) AS (VALUES {', '.join('(' + quoted([p]) + ')' for p in L.TRANSITIONS)}), p AS (SELECT *, len(regexp_extract_all(lower(text), '\\b' || phrase || '\\b')) AS k FROM el, ph WHERE elem_type = 'paragraph') SELECT {LAYER}, phrase, CAST(sum(k) AS BIGINT) AS n FROM p WHERE k > 0 GROUP BY GROUPING SETS ((phrase), (article_type, phrase), (brand, phrase))")
def profile_transitions(spark, sf_dir, el):
    return profile.transitions(el).select("layer", "layer_name", "phrase", "n")


CASES = f", h AS (SELECT *, list_filter({words_in('text')}, lambda w: lower(w) NOT IN ({quoted(L.MINOR_WORDS)}) AND regexp_matches(w, '^[A-Za-z]')) AS a FROM el WHERE elem_type = 'heading'), t AS (SELECT *, len(list_filter(a, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0 AS title FROM h WHERE len(a) > 0)"


@query(EL + CASES + f" SELECT {LAYER}, count(*) AS headings, count(*) FILTER (title) AS titles, CASE WHEN avg(title::INT) >= 0.7 THEN 'title' WHEN avg(title::INT) <= 0.3 THEN 'sentence' ELSE 'mixed' END AS vote FROM t {SETS}")
def profile_heading_case(spark, sf_dir, el):
    return profile.heading_case(el).select("layer", "layer_name", "headings", F.round(F.col("headings") * F.col("share")).cast("long").alias("titles"), "vote")


# --- text functions over the tables' own words and names ---

WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS k FROM documents"
VARIANTS = f"""WITH w AS ({WORDS}), v AS (SELECT k, length(k) AS n, list_distinct(list_filter([k,
  CASE WHEN k LIKE '%ies' AND n > 3 THEN k[:-4] || 'y' END, CASE WHEN regexp_matches(k, '(ses|xes)$') AND n > 3 THEN k[:-3] END, CASE WHEN regexp_matches(k, '(ches|shes)$') AND n > 4 THEN k[:-3] END,
  CASE WHEN k LIKE '%s' AND NOT regexp_matches(k, '(ss|us|is|es)$') AND n > 2 THEN k[:-2] END, CASE WHEN k NOT LIKE '%s' THEN k || 's' END,
  CASE WHEN regexp_matches(k, '(s|x|ch|sh)$') AND k NOT LIKE '%es' THEN k || 'es' END, CASE WHEN k LIKE '%y' AND n > 1 AND NOT regexp_matches(k, '[aeiou]y$') THEN k[:-2] || 'ies' END],
  lambda x: x IS NOT NULL)) AS f FROM w)
SELECT k AS keyword, array_to_string(list_sort(f), '|') AS variants FROM v"""


def words_of(spark, sf_dir):
    """The distinct words of ASCII letters of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("k")).distinct()


@query(VARIANTS)
def keyword_variants(spark, sf_dir, el):
    return words_of(spark, sf_dir).select(F.col("k").alias("keyword"), F.array_join(F.array_sort(T.keyword_variants(F.col("k"))), "|").alias("variants"))


ASKED = "CASE l_linenumber WHEN 1 THEN 'Exact ' || q WHEN 2 THEN q || '-' || (q + l_linenumber) WHEN 3 THEN 'Min ' || q WHEN 4 THEN 'max ' || q WHEN 5 THEN q || 'x' WHEN 6 THEN 'about ' || q || ' times' ELSE 'Any' END"
BOUNDS = f"""WITH a AS (SELECT DISTINCT l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT {ASKED} AS value, CASE WHEN l_linenumber IN (1, 2, 3, 5, 6) THEN q END AS low, CASE l_linenumber WHEN 2 THEN q + l_linenumber WHEN 3 THEN NULL WHEN 7 THEN NULL ELSE q END AS high FROM a"""


@query(BOUNDS)
def quantity_parse(spark, sf_dir, el):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", F.col("l_quantity").cast("int").alias("q")).distinct()
    rows = rows.select(F.expr(ASKED).alias("value"))
    return rows.select("value", T.quantity_range(F.col("value")).alias("q")).select("value", "q.low", "q.high")


NAMES = "SELECT p_partkey, lower(replace(replace(p_name || ' ' || word, '-', ' '), '_', ' ')) AS n, p_name || ' ' || word AS name FROM part, (SELECT unnest([{0}]) AS word, unnest(range({1})) AS i) WHERE p_partkey % {1} = i"
HINTS = [ws[0] for ws in L.TYPE_WORDS.values()] + ["none"]
TYPES = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(n, '{w}')''' for w in ws)} THEN '{k}'" for k, ws in L.TYPE_WORDS.items()) + " ELSE 'general' END"


@query(f"WITH n AS ({NAMES.format(quoted(HINTS), len(HINTS))}) SELECT p_partkey, name, {TYPES} AS kind FROM n")
def article_type_infer(spark, sf_dir, el):
    """Names of parts, each with a word that hints at a type."""
    word = F.get(F.array(*map(F.lit, HINTS)), (F.col("p_partkey") % len(HINTS)).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_name", F.lit(" "), word).alias("name"))
    return rows.withColumn("kind", T.article_type(F.col("name")))


TIER = f"CASE WHEN k IN ({quoted(HARD)}) THEN 'hard' WHEN k IN ({quoted(SOFT)}) THEN 'soft' END"
BAD = " OR ".join(f"contains(k, '{w}')" for w in standards.PROHIBITED)


@query(f"WITH w AS ({WORDS}) SELECT k AS word, {TIER} AS tier, CAST(CASE {TIER} WHEN 'hard' THEN 1.0 WHEN 'soft' THEN 0.3 ELSE 0 END AS DOUBLE) AS weight, ({BAD}) AS prohibited FROM w")
def standards_lookups(spark, sf_dir, el):
    rows, w = words_of(spark, sf_dir), F.col("k")
    return rows.select(w.alias("word"), standards.stop_tier(w, HARD, SOFT).alias("tier"), standards.stop_weight(w, HARD, SOFT).alias("weight"), standards.prohibited(w).alias("prohibited"))


REGION = "CASE " + " ".join(f"WHEN upper(n_name[1:2]) IN ({quoted(codes)}) THEN '{name}'" for name, codes in standards.REGIONS.items()) + " ELSE 'british' END"


@query(f"SELECT n_nationkey, {REGION} AS region FROM nation")
def spelling_regions(spark, sf_dir, el):
    """The first two letters of each nation's name, taken for a country code."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return rows.select("n_nationkey", standards.spelling_region(F.substring("n_name", 1, 2)).alias("region"))
