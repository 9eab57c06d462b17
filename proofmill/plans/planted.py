"""Queries that need signals of their own: headings with question marks, of one word, of level 1 or of a FAQ, spaces at ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import briefs_checks, checks, dictionary, profile
from ..sources import corpus, settings
from .articles import EL, spans_sql
from .queries import query
from .voices import PERSONS, SENTENCES, tops
from .whole import KEPT, OUTSIDE, SPANS, quoted, words_in

HEADINGS = ((11, "'Frequently asked questions'"), (7, "'Overview'"), (5, "text || ' ?'"), (3, "'How to ' || text || '??'"))
TEXT = "CASE WHEN elem_type = 'paragraph' AND idx % 3 = 0 THEN text || '  ' || chr(9) " + " ".join(f"WHEN elem_type = 'heading' AND idx % {k} = 0 THEN {t}" for k, t in HEADINGS) + " ELSE text END"
LEVEL = "CASE WHEN elem_type = 'heading' AND idx % 9 = 0 THEN 1 ELSE level END"
PLANTED = EL.replace("el AS (SELECT doc_id", "el0 AS (SELECT doc_id", 1).rstrip() + f""",
el1 AS (SELECT * REPLACE ({TEXT} AS text, {LEVEL} AS level) FROM el0),
el AS (SELECT * REPLACE (CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset) FROM el1)"""


def planted(el):
    rows = el.withColumn("text", F.expr(TEXT)).withColumn("level", F.expr(LEVEL).cast("int"))
    return corpus.with_offsets(rows.drop("start_offset", "end_offset")).select(*el.columns)


def heading(sub: str):
    return lambda spark, sf_dir, el: checks.headings(planted(el)).where(F.col("sub_check") == sub).select("doc_id", "start_offset", "original_text", "proposed_text")


FAQ = f"""
, h AS (SELECT * FROM el WHERE elem_type = 'heading'),
f AS (SELECT doc_id, idx, coalesce((SELECT min(n.idx) FROM h n WHERE n.doc_id = h.doc_id AND n.idx > h.idx AND n.level <= h.level), 1000000000) AS upto FROM h WHERE regexp_matches(lower(text), '(?i){"|".join(L.FAQ_WORDS)}'))
SELECT doc_id, start_offset, text AS original_text, regexp_replace(text, '\\?+\\s*$', '') AS proposed_text FROM h
WHERE regexp_matches(text, '\\?\\s*$') AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = h.doc_id AND f.idx <= h.idx AND f.upto > h.idx)"""
query(PLANTED + FAQ, "heading_question_mark")(heading("question_mark"))

SHORT = f" SELECT doc_id, start_offset, text AS original_text, CAST(NULL AS VARCHAR) AS proposed_text FROM el WHERE elem_type = 'heading' AND len({words_in('text')}) = 1 AND regexp_replace(lower(text), '[^a-z0-9_]', '', 'g') IN ({quoted(L.GENERIC_HEADINGS)})"
query(PLANTED + SHORT, "heading_descriptive")(heading("descriptive"))

FIRST = " SELECT doc_id, min(start_offset) AS start_offset, arg_min(text, idx) AS original_text, CAST(NULL AS VARCHAR) AS proposed_text FROM el WHERE elem_type = 'heading' AND level = 1 GROUP BY 1 HAVING count(*) > 1"
query(PLANTED + FIRST, "heading_multiple_h1")(heading("multiple_h1"))


@query(PLANTED + "," + spans_sql("f", "[ \\t]+$") + " SELECT doc_id, start_offset + s AS start_offset, m AS original_text, '' AS proposed_text FROM f")
def fmt_trailing_space(spark, sf_dir, el):
    rows = checks.formatting(planted(el)).where("sub_check = 'trailing_space'")
    return rows.select("doc_id", "start_offset", "original_text", "proposed_text")


# --- spelling, sections, profiles ---

DOUBT = {a: b for b, a in L.AMBIGUOUS.items() if a not in {w for k, w, _ in L.swaps() if k == "british"}}
SWAPPED = EL.replace("el AS (SELECT doc_id", "el0 AS (SELECT doc_id", 1).rstrip() + ", el AS (SELECT * REPLACE (replace(text, ' however ', ' however Check a program or ''meter'' by ') AS text) FROM el0)"
SWAPPED += "," + spans_sql("f", r"(?i)\b(?:" + "|".join(sorted(DOUBT, key=lambda w: (-len(w), w))) + r")\b") + SPANS
SWAPPED += ", w(wrong, r) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in DOUBT.items()) + ")"


@query(SWAPPED + f" SELECT doc_id, idx, s, m AS original_text, {KEPT} AS proposed_text FROM f JOIN w ON lower(f.m) = w.wrong WHERE {OUTSIDE}")
def spelling_context(spark, sf_dir, el):
    """Words that only one of their meanings spells otherwise, also in quotes, which keep them."""
    said = el.withColumn("text", F.replace("text", F.lit(" however "), F.lit(" however Check a program or 'meter' by ")))
    found = checks.locale_spelling(said, "british").where("sub_check = 'context'")
    place = said.select("doc_id", "idx", F.col("start_offset").alias("leaf_start"))
    return found.join(place, ["doc_id", "idx"]).select("doc_id", "idx", (F.col("start_offset") - F.col("leaf_start")).alias("s"), "original_text", "proposed_text")


NEEDED = ("The bonus", "On that", "Payment methods")
NORMAL = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\s]', '', 'g'))"
COVERED = EL + ", q(heading) AS (VALUES " + ", ".join(f"('{x}')" for x in NEEDED) + f"""),
d AS (SELECT doc_id, count(*) FILTER (elem_type = 'heading') AS n FROM el GROUP BY 1),
h AS (SELECT doc_id, {NORMAL.format("text")} AS a FROM el WHERE elem_type = 'heading'),
r AS (SELECT heading, {NORMAL.format("heading")} AS r FROM q),
c AS (SELECT DISTINCT doc_id, heading FROM h, r WHERE contains(a, r) OR len(list_intersect(list_distinct({words_in("r")}), {words_in("a")})) >= 0.5 * len(list_distinct({words_in("r")})))
SELECT doc_id, heading, CAST(least(n, 10) AS INTEGER) AS headings FROM d, q WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.heading = q.heading)"""


@query(COVERED)
def missing_sections(spark, sf_dir, el):
    required = el.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, NEEDED))).alias("heading"))
    return briefs_checks.missing_sections(el, required).select("doc_id", "heading", F.size("present").alias("headings"))


NUMBERS = EL + PERSONS + SENTENCES
LENGTHS = """ , a AS (SELECT {layer}, count(*) AS sentences, avg(w) AS mean, median(w) AS median, coalesce(stddev_samp(w), 0) AS stdev, list_sort(list(w)) AS ws FROM s2 {sets})
SELECT layer, layer_name, sentences, round(mean, 6) AS mean, CAST(median AS DOUBLE) AS median, round(stdev, 6) AS stdev, CAST(ws[CAST(floor(sentences * 0.1) AS BIGINT) + 1] AS BIGINT) AS p10, CAST(ws[CAST(floor(sentences * 0.9) AS BIGINT) + 1] AS BIGINT) AS p90 FROM a"""


def layered(sql: str) -> str:
    from .queries import LAYER, SETS

    return sql.format(layer=LAYER, sets=SETS)


@query(NUMBERS + layered(LENGTHS))
def profile_sentences(spark, sf_dir, el):
    found = profile.sentence_lengths(el)
    return found.select("layer", "layer_name", "sentences", F.round("mean", 6).alias("mean"), "median", F.round("stdev", 6).alias("stdev"), "p10", "p90")


STARTS = tops("o", "SELECT brand, article_type, array_to_string(list_filter(string_split_regex(bare, '\\s+'), lambda w: w <> '')[1:3], ' ') AS phrase, 1 AS k, {'d': doc_id, 'i': idx, 'n': no} AS f FROM s2", "f, phrase", 20)


@query(NUMBERS + STARTS + " SELECT layer, layer_name, phrase AS opener, n, round(n * 100 / total, 6) AS rate, r AS rank FROM (SELECT *, sum(n) OVER (PARTITION BY layer, layer_name) AS total FROM o1) WHERE r <= 20")
def profile_openers(spark, sf_dir, el):
    return profile.openers(el).select("layer", "layer_name", "opener", "n", F.round("rate", 6).alias("rate"), "rank")


# --- dictionary ---

KEYS = "regexp_replace(lower(word), '([''’]s|(s)[''’])$', '\\2')"
UNKNOWN = EL + f"""
, d AS (SELECT w FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+')) AS w FROM el WHERE elem_type = 'paragraph') WHERE w = lower(w) GROUP BY 1 HAVING count(*) >= 3),
h AS (SELECT doc_id, idx, {words_in("text || 'n''s Xylo''s The Players'' Theses'")} AS a FROM el WHERE elem_type = 'heading'),
t AS (SELECT doc_id, idx, CAST(unnest(range(0, len(a))) AS INTEGER) AS no, unnest(a) AS w FROM h),
x AS (SELECT doc_id, idx, no, regexp_replace(w, '^[^\\p{{L}}]+|[^\\p{{L}}''’]+$', '', 'g') AS word FROM t WHERE no > 0 AND regexp_matches(w, '^\\p{{Lu}}')),
k AS (SELECT *, {KEYS} AS base FROM x)
SELECT doc_id, idx, no, word FROM k WHERE base NOT IN (SELECT w FROM d) AND NOT (length(base) > 3 AND base LIKE '%s' AND base[1:length(base) - 1] IN (SELECT w FROM d))"""


@query(UNKNOWN)
def heading_unknown_words(spark, sf_dir, el):
    """Every heading, with words added that are possessive, plural or unknown, against the words the corpus has three times."""
    more = F.concat("text", F.lit("n's Xylo's The Players' Theses"))
    said = el.withColumn("text", F.when(F.col("elem_type") == "heading", more).otherwise(F.col("text")))
    return dictionary.unknown_capitals(said, dictionary.word_frequencies(el).where("n >= 3"))


# --- settings ---

BODY = "CASE WHEN event_id % 5 = 0 THEN k ELSE '{\"k\":' || k || ',\"last\":{\"id\":' || event_id || '}}' END"
SETTINGS = """
WITH e AS (SELECT user_id, event_type, event_id, event_id % 2 AS side, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY event_id DESC) AS r FROM events),
l AS (SELECT user_id, side, event_type AS path, k AS value FROM e WHERE r = 1 AND event_id % 5 = 0
  UNION ALL SELECT user_id, side, event_type || '.k', k FROM e WHERE r = 1 AND event_id % 5 <> 0
  UNION ALL SELECT user_id, side, event_type || '.last.id', CAST(event_id AS VARCHAR) FROM e WHERE r = 1 AND event_id % 5 <> 0)
SELECT user_id, path, value FROM l a WHERE side = 1 OR NOT EXISTS (SELECT 1 FROM l b WHERE b.side = 1 AND b.user_id = a.user_id AND (a.path = b.path OR starts_with(a.path, b.path || '.') OR starts_with(b.path, a.path || '.')))"""


@query(SETTINGS)
def config_merge(spark, sf_dir, el):
    """Settings of every user, by type of event, from the last even events, with those from the last odd ones put on them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").alias("k"))
    last = events.groupBy("user_id", "event_type", (F.col("event_id") % 2).alias("side")).agg(F.max(F.struct("event_id", "k")).alias("x")).select("user_id", "event_type", "side", "x.*")
    entry = F.concat(F.lit('"'), "event_type", F.lit('":'), F.expr(BODY.replace('\\"', '"')))
    made = last.groupBy("user_id", "side").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("json"))
    side = lambda k: settings.paths(made.where(F.col("side") == k), "user_id", "json")
    return settings.merged(side(0), side(1), "user_id").select("user_id", F.array_join("path", ".").alias("path"), "value")
