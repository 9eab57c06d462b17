"""The pipeline, stage by stage, against what its operators say of each stage's own input."""

from __future__ import annotations

import re

import corpus_pipeline
from proofmill.llm import decontam, langid, packing, simhash
from proofmill.llm.common import stored

from .conftest import SF


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (before, docs)
        if name != "pack":
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["language"]
    assert ids(after) <= ids(before) and len(ids(after)) >= 0.98 * len(ids(before))
    before, after = seen["near_dedup"]
    assert ids(after) == {r.id for r in simhash.near_duplicates(before).where("id = component").collect()}
    before, after = seen["substring_dedup"]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.text == texts[r.doc_id] or (len(r.text.split()) < len(texts[r.doc_id].split()) and r.n_chars == len(r.text))
    before, after = seen["decontaminate"]
    assert ids(before) - ids(after) == ids(decontam.matches(before, spark.read.parquet(f"{SF}/benchmark.parquet")))
    before, after = seen["pack"]
    assert ids(after) == ids(before)


def test_language_stage_drops_noise_and_keeps_the_rest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = ["0f3a9b " * 60, "Это предложение на другом языке и с другими буквами. " * 4, "", None, "12 34 56 !!", "zxq wvk qqj xkz jjv " * 20]
    rows = spark.createDataFrame([(10_000_000 + i, t, None, None, None) for i, t in enumerate(junk)], docs.select(*corpus_pipeline.COLUMNS).schema)
    after = corpus_pipeline.language(spark, docs.select(*corpus_pipeline.COLUMNS).union(rows), SF)
    ids = {r.doc_id for r in after.collect()}
    assert not ids & set(range(10_000_000, 10_000_006))
    assert len(ids) >= 0.98 * docs.count()


def test_texts_go_to_the_workers_once(spark, odd):
    named = langid.identify(odd, None, carry=corpus_pipeline.COLUMNS)
    assert named.columns == ["id", "lang_pred", "score", *corpus_pipeline.COLUMNS]
    assert not re.search(r"\btext#\d+ AS carried", named._jdf.queryExecution().analyzed().toString())
    rows = lambda df: sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()), key=str)
    assert rows(named) == rows(odd) and named.schema["text"].dataType == odd.schema["text"].dataType


def test_near_dedup_of_rows_that_repeat(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(7, text), (7, text), (8, text), (9, "other words " * 9), (None, text), (None, text), (7, "quite another text of the same id " * 5)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    after = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    assert after == sorted([rows[0], rows[3], rows[4], rows[5], rows[6]], key=str)


def test_run_on_odd_rows(spark, odd):
    """What each stage leaves of the odd rows, by id: null and empty texts and texts without a letter go as no language."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"odd-{name}")
        left[name] = sorted({r.doc_id for r in docs.collect()}, key=str)
    assert not {2, 3, 4, 8} & set(left["language"])
    # 6 is a copy of 5 and the second row of 7 one of 1
    assert set(left["near_dedup"]) == set(left["language"]) - {6, 7}
    assert left["pack"] == left["decontaminate"] == left["substring_dedup"] == left["near_dedup"]


def test_run_on_nothing(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"none-{name}")
    assert docs.count() == 0
    assert packing.pack(none).count() == 0
