from __future__ import annotations

import json

from pyspark.sql import functions as F

from proofmill.operators import checks, findings, persist, profile, standards


def test_findings_come_back(spark, article):
    found = findings.union([checks.formatting(article("a  b ,c "))])
    back = persist.from_json(persist.to_json(found), persist.FINDING)
    assert sorted(map(tuple, back.select(*found.columns).collect())) == sorted(map(tuple, found.collect()))
    assert persist.from_json(spark.createDataFrame([("{broken",), ('{"doc_id": 1}',)], "json string"), persist.FINDING).where("doc_id = 1").count() == 1


def test_documents_and_reports(spark, article):
    el = article(("heading", 1, "Top"), "a  b")
    doc = json.loads(persist.documents(el).first().json)
    assert doc["title"] == "Top" and doc["total_length"] == 8 and [x["text"] for x in doc["elements"]] == ["Top", "a  b"]
    found = findings.union([checks.formatting(el)])
    posted = found.select("doc_id", "finding_id", F.lit("c1").alias("comment_id"))
    report = json.loads(persist.findings_report(found, posted).first().json)
    assert report["total"] == 1 and report["findings"][0]["comment_id"] == "c1"


def test_models_come_back(spark, article, tmp_path):
    models = profile.article_counts(article("One two."))
    persist.save_models(models, str(tmp_path / "m"))
    back = persist.load_models(spark, str(tmp_path / "m"), models)
    assert sorted((r.layer, r.layer_name, r.articles) for r in back.collect()) == sorted((r.layer, r.layer_name, r.articles) for r in models.collect())


def test_counts_keep_empty_groups(spark):
    rows = spark.createDataFrame([("warning",)] * 2, "severity string")
    assert {(r.severity, r.n) for r in persist.comment_counts(rows).collect()} == {("error", 0), ("warning", 2), ("suggestion", 0)}


def test_table_shapes(spark):
    cells = [(1, i, "table_cell", r, c) for i, (r, c) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1), (0, 0)])]
    got = persist.table_shapes(spark.createDataFrame(cells, "doc_id long, idx long, elem_type string, row int, col int"))
    assert sorted((r.table, r.rows, r.cols) for r in got.collect()) == [(1, 2, 2), (2, 1, 1)]


def test_settings(spark):
    row = spark.createDataFrame([('{"voice": {"person": "second"}}', "moon")], "raw string, b string")
    got = row.select(standards.setting(F.col("raw"), "voice.person").alias("p"), standards.setting(F.col("raw"), "x.y", "z").alias("d"), standards.normal_brand(F.col("b"), {"moon": "Moon"}).alias("n")).first()
    assert tuple(got) == ("second", "z", "Moon")
