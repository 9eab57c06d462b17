"""Every query with SQL against DuckDB, and the contract of the entry module."""

from __future__ import annotations

import pytest

import __spark_entry__
from proofmill.plans import joins, planted, run, voices, whole  # noqa: F401
from proofmill.plans.queries import ORACLE_SQL, QUERIES, TERMS

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    found = __spark_entry__.queries()
    assert set(QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    for t in ("documents", "pages", "labels", "conversations", "benchmark", "part", "lineitem", "nation", "events"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    plain = lambda v: float(v) if hasattr(v, "as_tuple") else v
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    sql = duckdb.sql(ORACLE_SQL[name])
    at = [sql.columns.index(c) for c in sorted(sql.columns)]
    assert sorted(sql.columns) == sorted(df.columns)
    assert got == sorted(repr([plain(row[i]) for i in at]) for row in sql.fetchall())


def test_whole_queries_equal_brute_force(spark):
    import re

    from proofmill.functions import lexicons as L
    from proofmill.plans.articles import elements

    docs = {}
    for r in sorted(elements(spark, SF).collect(), key=lambda r: (r.doc_id, r.idx)):
        docs.setdefault(r.doc_id, []).append(r)
    points, titles, intro = set(), set(), set()
    for i, rows in docs.items():
        end = max(r.start_offset + len(r.text) for r in rows)
        for o in {*range(0, end + 1, 40), *(r.start_offset for r in rows)}:
            points |= {(i, r.idx, o) for r in rows if r.start_offset <= o < r.start_offset + len(r.text)}
        for r in rows:
            words = r.text.split(" ")
            letters = [re.sub("[^A-Za-z]", "", w).lower() for w in words]
            acronyms = {a.lower(): a for a in L.ACRONYMS}
            case = lambda k, w: w.replace(letters[k], acronyms[letters[k]]) if letters[k] in acronyms else w.lower() if 0 < k < len(words) - 1 and w.lower() in L.MINOR_WORDS else w[:1].upper() + w[1:].lower()  # noqa: B023, E731
            if r.elem_type == "heading" and (title := " ".join(case(k, w) for k, w in enumerate(words))) != r.text:
                titles.add((i, r.idx, title))
        first = min((r.idx for r in rows if r.elem_type == "heading"), default=None)
        if first is not None and not any(r.elem_type == "paragraph" and r.idx < first and len(re.findall("[A-Za-z0-9_]+", r.text)) > 5 for r in rows):
            intro.add((i,))
    for name, want in (("element_at_offset", points), ("heading_title_case", titles), ("structure_intro", intro)):
        assert {tuple(r) for r in QUERIES[name](spark, SF).collect()} == want, name


def test_run_goes_on_after_a_broken_check(article):
    found, errors = run.run_checks(article("We delve  here"), {"stop_words": {"terms": TERMS}, "formatting": {}, "voice": {"nonsense": 1}})
    assert set(errors) == {"voice"} and found.count() > 0
    assert set(run.qa(article("a  b"), {"formatting": {}})) == {"findings", "edits", "elements", "comments", "summary"}


def against_sql(spark, path, name, texts):
    """Rows of a query over documents with these texts, and what its SQL gives."""
    import duckdb

    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(path))
    sql = con.sql(ORACLE_SQL[name])
    order = lambda columns, rows: sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in rows)
    return order(df.columns, df.collect()), order(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", ["voice_counts", "voice_models"])
def test_words_of_other_letters_count_as_in_sql(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, ["We say that été and éall that x. Éyou, éhowever", "éplayers can go that\nÉnd. One that way"])
    assert got == want and got
