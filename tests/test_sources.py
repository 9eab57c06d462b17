from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from proofmill.operators import briefs, edits
from proofmill.sources import corpus, office


def test_from_text_and_html(spark):
    docs = spark.createDataFrame([(1, "Head\nSome longer line of text here.\na | b", "s", "en"), (2, None, "s", "en"), (3, "", "s", "en")], "doc_id long, text string, source string, lang string")
    got = [tuple(r) for r in corpus.from_text(docs).select("doc_id", "idx", "elem_type", "level", "start_offset", "end_offset").orderBy("doc_id", "idx").collect()]
    assert got == [(1, 0, "heading", 1, 0, 4), (1, 1, "paragraph", None, 5, 35), (1, 2, "list_item", None, 36, 41), (3, 0, "paragraph", None, 0, 0)]
    pages = spark.createDataFrame([(1, '<h1>A &amp; <b>B</b></h1><script>x("<p>")</script><p>one<p>two</p><ul><li><a href="/u">x</a></li></ul>')], "page_id long, html string")
    assert [(r.elem_type, r.text) for r in corpus.from_html(pages).orderBy("idx").collect()] == [("heading", "A & B"), ("paragraph", "one"), ("paragraph", "two"), ("list_item", "x")]
    assert [(r.anchor, r.url) for r in corpus.hyperlinks(pages).collect()] == [("x", "/u")]


def test_docx_round_trip(spark, tmp_path):
    runs = [{"text": "Hello ", "bold": True}, {"text": "world", "highlight": "yellow (7)", "italic": True}]
    leaves = [
        {"idx": 0, "elem_type": "heading", "level": 2, "text": "Title"}, {"idx": 1, "elem_type": "paragraph", "text": "Hello world", "runs": runs}, {"idx": 2, "elem_type": "list_item", "text": "point"},
        {"idx": 3, "elem_type": "table_cell", "row": 0, "col": 0, "text": "a"}, {"idx": 4, "elem_type": "table_cell", "row": 0, "col": 1, "text": "b"}, {"idx": 5, "elem_type": "paragraph", "text": "end"},
    ]
    (tmp_path / "a.docx").write_bytes(office.docx_bytes(leaves, {1}))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    el = office.read_docx(spark, str(tmp_path))
    got = [(r.elem_type, r.level, r.text, r.row, r.col) for r in el.orderBy("idx").collect()]
    assert got == [("heading", 2, "Title", None, None), ("paragraph", None, "", None, None), ("paragraph", None, "Hello world", None, None), ("list_item", None, "point", None, None), ("table_cell", None, "a", 0, 0), ("table_cell", None, "b", 0, 1), ("paragraph", None, "end", None, None)]
    made = el.where("text = 'Hello world'").first().runs
    assert [(r.text, r.bold, r.italic, r.highlight) for r in made] == [("Hello ", True, False, None), ("world", False, True, "yellow")]
    again = office.to_docx(el.where("text <> ''"), edits.blank_rows(el)).first()
    assert again.doc_id == "a.docx" and [x["text"] for x in office.docx_leaves(bytes(again.content)) if x["text"]] == ["Title", "Hello world", "point", "a", "b", "end"]
    assert [r.text for r in office.headings_only(el).collect()] == ["Title"]


def workbook(rows):
    cell = lambda r, c, v: f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(64 + c)}{r}"><v>{v}</v></c>'
    xml = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in cols.items()) + "</row>" for r, cols in rows.items())
    out, main, rel = io.BytesIO(), office.S[1:-1], office.R[1:-1]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Brief" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{xml}</sheetData></worksheet>')
    return out.getvalue()


def test_briefs_of_both_formats(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({1: {1: "Task", 2: "Bonus page"}, 2: {1: "Word count", 2: 900}, 4: {1: "Main keywords", 2: "Qty"}, 5: {1: "moon bonus", 2: "1-2"}, 6: {1: "moon promo", 2: 3}, 8: {1: "Section", 2: "Words"}, 9: {1: "Offers", 2: 200}}))
    cell = lambda i, r, c, t: {"idx": i, "elem_type": "table_cell", "row": r, "col": c, "text": t}
    (tmp_path / "b.docx").write_bytes(office.docx_bytes([cell(0, 0, 0, "Keywords"), cell(1, 0, 1, "Qty"), cell(2, 1, 0, "slots"), cell(3, 1, 1, "Min 2"), {"idx": 4, "elem_type": "paragraph", "text": "Market: Canada"}]))
    cells = office.read_briefs(spark, str(tmp_path))
    got = sorted((r.brief_id, r.keyword, r.low, r.high) for r in briefs.keywords(cells).collect())
    assert got == [("a.xlsx", "moon bonus", 1, 2), ("a.xlsx", "moon promo", 3, 3), ("b.docx", "slots", 2, None)]
    parsed = {r.brief_id: r for r in briefs.parse(cells).collect()}
    a, b = parsed["a.xlsx"], parsed["b.docx"]
    assert (a.state, a.article_type, a.target_word_count, a.sections) == ("READY", "bonus_page", 900, 1)
    assert (b.state, b.market) == ("NEEDS_CLARIFICATION", "Canada")
    answers = spark.createDataFrame([("b.docx", "article_type", "game_review"), ("b.docx", "target_word_count", "500")], "brief_id string, field string, value string")
    done = {r.brief_id: r for r in briefs.confirm(briefs.parse(cells), answers).collect()}["b.docx"]
    assert (done.article_type, done.article_type_confidence, done.target_word_count) == ("game_review", 1.0, 500)


def test_google_docs(spark, tmp_path):
    run = lambda t: {"elements": [{"textRun": {"content": t}}]}
    body = [{"paragraph": run("Top\n") | {"paragraphStyle": {"namedStyleType": "TITLE"}}}, {"paragraph": run("text \n")}, {"paragraph": run("item\n") | {"bullet": {"listId": "x"}}}, {"table": {"tableRows": [{"tableCells": [{"content": [{"paragraph": run("c\n")}]}]}]}}, {"paragraph": run("Deep\n") | {"paragraphStyle": {"namedStyleType": "HEADING_6"}}}]
    (tmp_path / "d.json").write_text(json.dumps({"documentId": "d1", "body": {"content": body}}))
    el = office.read_gdoc(spark, str(tmp_path))
    assert [(r.elem_type, r.level, r.text) for r in el.orderBy("idx").collect()] == [("heading", 1, "Top"), ("paragraph", None, "text"), ("list_item", None, "item"), ("table_cell", None, "c"), ("heading", 4, "Deep")]
    assert office.gdoc_requests(el).where("request LIKE '%HEADING_4%'").count() == 1


@pytest.mark.parametrize(("rgb", "want"), [((1.0, 1.0, 0.0), "yellow"), ((0.0, 1.0, 0.0), "bright green"), ((0.0, 1.0, 1.0), "turquoise"), ((1.0, 0.0, 1.0), "pink"), ((0.9, 0.1, 0.1), "red"), ((0.0, 0.0, 1.0), "blue"), ((0.5, 0.5, 0.5), "gray 25"), ((1.0, 1.0, 1.0), None), ((0.0, 0.0, 0.0), None), ((0.9, 0.6, 0.3), "yellow")])
def test_highlight_names(spark, rgb, want):
    assert spark.range(1).select(office.highlight_name(*map(F.lit, rgb)).alias("x")).first().x == want


def test_corpus_index(spark, tmp_path):
    for name in ("moon/moon-bonus.docx", "moon/moon app.docx", "_house/x.docx"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = [(r.brand, r.type) for r in corpus.index_files(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("moon", "app_review"), ("moon", "bonus_page")]


def test_stream_equals_batch(spark, tmp_path):
    from proofmill.operators import checks, findings
    from proofmill.streaming import qa

    docs = spark.createDataFrame([(1, "a  b ,c", "en", "s", 7), (2, "x  y", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "in"))
    qa.run(qa.article_stream(spark, str(tmp_path / "in")), [checks.formatting], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = findings.union([checks.formatting(corpus.from_text(docs))])
    assert sorted(r.finding_key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r.finding_key for r in want.collect())
