from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proofmill.operators import briefs_checks, document, edits, findings, runs
from proofmill.sources import config, office

COLUMNS = f"doc_id string, idx long, elem_type string, level int, text string, start_offset long, end_offset long, runs array<{office.RUN}>"


def run(text, start, **formats):
    base = dict.fromkeys(("bold", "italic", "underline", "strikethrough"), False) | dict.fromkeys(("highlight", "hyperlink", "font", "size"))
    return {"text": text, "start": start, "end": start + len(text)} | base | formats


@pytest.fixture
def el(spark):
    rows = [
        ("d", 0, "paragraph", None, "one two  three", 0, 14, [run("one ", 0, bold=True), run("two  ", 4, highlight="yellow"), run("three", 9, hyperlink="/x")]),
        ("d", 1, "paragraph", None, "plain", 15, 20, []),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_lookups_and_predicates(el):
    rows = el.withColumn("all", runs.or_plain(F.col("runs"), F.col("text"), office.RUN)).withColumn("at", runs.at_offset(F.col("all"), F.lit(4)))
    assert [r["at"].text for r in rows.orderBy("idx").collect()] == ["two  ", "plain"]
    kinds = rows.where("idx = 0").select(*(F.transform("runs", f).alias(n) for n, f in (("f", runs.is_formatted), ("h", runs.is_highlighted), ("l", runs.is_linked)))).first()
    assert (kinds.f, kinds.h, kinds.l) == ([True] * 3, [False, True, False], [False, False, True])


def test_spans_have_absolute_offsets(el):
    assert [(r.start_offset, r.end_offset, r.text) for r in runs.highlighted_spans(el).collect()] == [(4, 9, "two  ")]
    assert [(r.start_offset, r.url) for r in runs.linked_spans(el).collect()] == [(9, "/x")]


def test_runs_follow_edits(el):
    from proofmill.operators import checks

    judged = edits.resolved(edits.validated(findings.union([checks.formatting(el)]), el))
    row = edits.applied(el, judged).where("idx = 0").first()
    assert row.text == "one two three" and "".join(r.text for r in row.runs) == row.text
    assert all(row.text[r.start : r.end] == r.text for r in row.runs) and row.runs[-1].hyperlink == "/x"


def test_lists_and_sections(article):
    el = article(("heading", 1, "A"), "p one", ("list_item", None, "x"), ("list_item", None, "y"), ("heading", 2, "B"), ("list_item", None, "z"), ("heading", 1, "C"), "q")
    assert [r.list_no for r in document.with_list_groups(el).orderBy("idx").collect()] == [None, None, 1, 1, None, 2, None, None]
    got = {r.title: (r.headings, r.paragraphs, r.words, r.text) for r in document.section_rollups(el).collect()}
    assert got == {"A": (1, 1, 2, "A\np one\nx\ny\nB\nz"), "B": (0, 0, 0, "B\nz"), "C": (0, 1, 1, "C\nq")}


def test_config_lists_are_guarded():
    assert config.word_list(["a", 3, " "], "hard") == ["a"] and config.word_list(None, "hard") == []
    with pytest.warns(UserWarning, match="no list"):
        assert config.word_list("scum", "hard") == []


def test_unreadable_files_are_told(spark):
    files = spark.createDataFrame([("a.docx", bytearray(b"no zip"))], "path string, content binary")
    assert [(r.path, r.error.split(":")[0]) for r in office.unreadable(files, office.docx_leaves).collect()] == [("a.docx", "BadZipFile")]


def test_keywords_that_are_nowhere_highlighted(spark):
    text = "the bonus and the slots of this site are here for all of you"
    rows = [("d", 0, "paragraph", None, text, 0, len(text), [run("the ", 0), run("bonus", 4, highlight="yellow"), run(text[9:], 9)])]
    el = spark.createDataFrame(rows, COLUMNS)
    asked = spark.createDataFrame([("d", k, 1, None, g) for k, g in (("bonus", "main"), ("slot", "main"), ("site", "support"))], "doc_id string, keyword string, low int, high int, grp string")
    found = briefs_checks.keywords(el, asked).where("sub_check = 'highlighting'").collect()
    assert [(r.original_text, r.start_offset, r.end_offset) for r in found] == [("slots", 18, 23)]
