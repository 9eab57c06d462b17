"""Joins and sweeps over positions against brute force, and on one long line or document."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from proofmill.functions import text as T
from proofmill.operators import briefs_checks, checks, document, edits, findings, intervals, phrases, runs
from proofmill.sources import office


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_lexicon_finds_whole_tokens_with_their_gaps(spark, article):
    el = article("The Moon-Harbor, moon harbor and MOON  HARBOR; moonharbor's moon_harbor. C++ and c+ c++.", "été Été ETE xété étéx", "a b a b a")
    words = [("moon harbor",), ("moonharbor",), ("c++",), ("été",), ("a b a",), ("...",)]
    got = rows(phrases.hits(el, phrases.lexicon(spark, words, "term string")), "idx", "s", "e", "term", "m")
    want = [(0, 17, 28, "moon harbor", "moon harbor"), (0, 47, 57, "moonharbor", "moonharbor"), (0, 73, 76, "c++", "C++"), (0, 84, 87, "c++", "c++")]
    assert got == [*want, (1, 0, 3, "été", "été"), (1, 4, 7, "été", "Été"), (2, 0, 5, "a b a", "a b a"), (2, 4, 9, "a b a", "a b a")]
    loose = rows(phrases.hits(el, phrases.lexicon(spark, [("moon harbor",)], "term string", loose=True)), "s", "m")
    assert loose == [(4, "Moon-Harbor"), (17, "moon harbor"), (33, "MOON  HARBOR")]
    assert phrases.hits(el, phrases.lexicon(spark, [("...",)], "term string")).count() == 0


def test_a_large_lexicon_is_joined_by_hash_and_finds_the_same(spark, article, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    el = article(*(" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)))
    terms = phrases.lexicon(spark, {(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))),) for _ in range(300)}, "term string")
    small = rows(phrases.hits(el, terms, 15), "idx", "s", "e", "term", "before")
    monkeypatch.setattr(phrases, "SMALL", 10)
    plan = phrases.hits(el, terms)
    assert rows(phrases.hits(el, terms, 15), "idx", "s", "e", "term", "before") == small
    text = {r.idx: r.text for r in el.collect()}
    want = [(i, m.start(), m.start() + len(t), t) for i, x in text.items() for (t,) in terms.select("term").collect() for m in re.finditer(rf"(?=\b{t}\b)", x)]
    assert [r[:4] for r in small] == sorted(want)
    assert all(before == text[i][max(0, s - 15) : s] for i, s, _, _, before in small)
    assert not re.search("NestedLoop|Cartesian", plan._jdf.queryExecution().executedPlan().toString())


def test_two_thousand_hits_and_quotes_in_one_line(article):
    el = article(" ".join('see moonharbor and "the moonharbor" at www.moonharbor.com,' for _ in range(2000)))
    checks.brand_names(el, "MoonHarbor", []).count()
    began = time.time()
    found = checks.brand_names(el, "MoonHarbor", []).collect()
    assert len(found) == 2000 and time.time() - began < 20  # the machine may be busy; alone it takes about a second
    assert {r.original_text for r in found} == {"moonharbor"} and sorted(r.start_offset for r in found)[:2] == [4, 63]


def test_sweep_equals_pairs(spark):
    rng = random.Random(5)
    made = [(rng.randint(1, 3), rng.randint(0, 60), rng.randint(1, 12), rng.random() < 0.4) for _ in range(400)]
    df = spark.createDataFrame([(d, s, s + n, span) for d, s, n, span in made], "doc_id int, s int, e int, span boolean")
    got = rows(phrases.outside(df, F.col("span"), "doc_id"), "doc_id", "s", "e")
    spans = [(d, s, s + n) for d, s, n, span in made if span]
    assert got == sorted((d, s, s + n) for d, s, n, span in made if not span and not any(x == d and a <= s and b >= s + n for x, a, b in spans))


def test_claims_by_priority_equal_taking_them_in_turn(spark):
    rng = random.Random(6)
    hits = {(d, rng.randint(1, 6), s) for d in range(4) for s in range(0, 200) for _ in range(2) if rng.random() < 0.7}
    hits = [(d, rank, s, s + 2 + rank * 3 % 5) for d, rank, s in hits]
    want = []
    for h in sorted(hits):
        if not any(w[0] == h[0] and w[2] < h[3] and w[3] > h[2] for w in want):
            want.append(h)
    df = spark.createDataFrame(hits, "doc_id int, rank int, start int, end int")
    assert rows(intervals.claimed(df, "rank", "doc_id"), "doc_id", "rank", "start", "end") == sorted(want)
    assert intervals.claimed(df.where("false"), "rank", "doc_id").count() == 0


def test_a_hundred_thousand_keyword_hits_in_a_document(spark, article):
    el = article(" ".join("free spins bonus" for _ in range(50_000)))
    asked = spark.createDataFrame([(1, k, None, None, "main") for k in ("free spins", "spins bonus", "bonus")], "doc_id long, keyword string, low int, high int, grp string")
    n = {r.keyword: r.n for r in briefs_checks.keyword_counts(el, asked).collect()}
    assert n == {"spins bonus": 50_000, "free spins": 0, "bonus": 0}


def test_near_words(spark, article):
    el = article("alpha " + "x" * 40 + " beta", "alpha " + "x" * 50 + " beta", "gamma", "delta delta")
    asked = spark.createDataFrame([(1, k) for k in ("alpha beta", "beta gamma", "alpha gamma", "delta", "delta delta", "beta alpha")], "doc_id long, keyword string")
    assert rows(briefs_checks.nearby(el, asked), "keyword") == [("alpha beta",), ("beta alpha",), ("beta gamma",)]


def test_points_and_sections_of_a_document_of_a_hundred_thousand_lines(spark):
    from proofmill.sources.corpus import with_offsets

    lines = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit("b").alias("brand"), F.lit("t").alias("article_type"), F.col("id").alias("idx"), F.when(F.col("id") % 2 == 0, "heading").otherwise("paragraph").alias("elem_type"), F.when(F.col("id") % 2 == 0, 1 + (F.col("id") / 2 % 4).cast("int")).alias("level"), F.when(F.col("id") % 2 == 0, "Title").otherwise("some words here").alias("text"))
    el = with_offsets(lines)
    points = spark.range(0, 900_000, 9).select(F.lit(1).alias("doc_id"), F.col("id").alias("offset"))
    found = document.at_offset(el, points)
    assert found.where("offset < start_offset OR offset >= end_offset").count() == 0 and found.count() > 90_000
    held = document.sections(el)
    # every fourth heading is of level 1 and holds the three below it
    assert rows(held.where("level = 1").select("headings", "paragraphs", "words", "size").distinct(), "headings", "paragraphs", "words", "size") == [(3, 4, 12, 8)]
    assert document.section_rollups(el).where("length(text) < 5").count() == 0


def chain(spark, spans):
    return spark.createDataFrame([(1, i, s, e, str(i), i, True) for i, (s, e) in enumerate(spans)], "doc_id long, ordinal long, start_offset long, end_offset long, finding_key string, idx long, valid boolean")


def in_turn(spans):
    """Status and what it conflicts with, for fixes in the order of start and number."""
    taken, out = [], {}
    for i, (s, e) in sorted(enumerate(spans), key=lambda x: (x[1][0], x[0])):
        against = [j for j, (a, b) in taken if s < b and e > a]
        out[str(i)] = ("downgraded", str(against[0])) if against else ("applied", None)
        if not against:
            taken.append((i, (s, e)))
    return out


def test_conflicts_in_short_and_long_runs_equal_taking_them_in_turn(spark):
    rng = random.Random(7)
    for n in (1, 5, 40, 500):
        spans = [(s := rng.randint(0, n), s + rng.randint(0, 6)) for _ in range(n)]
        for long in (64, 1):
            got = {r.finding_key: (r.status, r.conflicts_with) for r in edits.resolved(chain(spark, spans), long).collect()}
            assert got == in_turn(spans), (n, long)


def test_ten_thousand_fixes_that_overlap_in_one_leaf(spark):
    spans = [(i, i + 2) for i in range(10_000)]
    n = {r.status: r["count"] for r in edits.resolved(chain(spark, spans)).groupBy("status").count().collect()}
    assert n == {"applied": 5000, "downgraded": 5000}


def test_fixes_in_leaves_equal_taking_them_in_turn_without_a_shuffle(spark):
    from proofmill.plans import joins

    rng = random.Random(12)
    words = ["a", "to", "abc", "abcd", "été", "x_1", "word\U0001d4d0", "eightéé8", "seven77"]
    lines = ["".join(rng.choice(["", " ", ", ", "--"]) + rng.choice(words) + rng.choice([" ", " … ", "-", "\r"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    lines += ["", "one", "...", "abc def"]
    made = [(i // 8, i, 1000 * i, x) for i, x in enumerate(lines)]
    el = spark.createDataFrame(made, "doc_id long, idx long, start_offset long, text string")
    want = []
    for doc, _, at, text in made:
        found = list(re.finditer(r"\w+", text))
        spans = [(at + a.start(), at + b.end()) for a, b in zip(found, found[1:]) if len(a[0]) % 4]
        for k, (status, by) in in_turn(spans).items():
            want.append((doc, spans[int(k)][0], status, f"{doc}:{spans[int(by)][0]}" if by else None))
    key = lambda r: (r[0], r[1])
    plan = joins.fix_conflicts(spark, None, el)
    assert len(want) > 300 and not re.search("Exchange|Sort", plan._jdf.queryExecution().executedPlan().toString())
    cols = ("doc_id", "start_offset", "status", "conflicts_with")
    assert sorted((tuple(r) for r in plan.select(*cols).collect()), key=key) == sorted(want, key=key)
    rows = edits.resolved_in_leaves(joins.token_lengths(el.coalesce(1)), joins.chained(), 3)
    assert sorted((r.doc_id, r.start_offset, r.held and f"{r.doc_id}:{r.held}") for r in rows.collect() if r.held is not None) == sorted((d, s, by) for d, s, _, by in want if by)


def test_few_first_tokens_are_marked_and_give_the_same_hits(spark, article, monkeypatch):
    rng = random.Random(11)
    words = ["as", "well", "As", "WELL", "asé", "éas", "so", "ſo", "İs", "K", "k", "k9", "a.b", "x_so"]
    el = article(*("".join(rng.choice(words) + rng.choice([" ", "  ", "-", "\t", ", "]) for _ in range(rng.randint(1, 12))) for _ in range(300)))
    lexicon = phrases.lexicon(spark, [(t,) for t in ("as well as", "as", "so", "as-so", "k", "k as", "a.b", "well, so")], "term string")
    for letters in (phrases.LETTERS, phrases.ASCII):
        marked = rows(phrases.hits(el, lexicon, letters=letters), "idx", "term", "s", "e", "m")
        monkeypatch.setattr(phrases, "FEW", 0)
        assert marked == rows(phrases.hits(el, lexicon, letters=letters), "idx", "term", "s", "e", "m") and len(marked) > 300
        monkeypatch.undo()


def test_conflicts_take_one_shuffle_and_no_tables(spark, monkeypatch):
    from proofmill.sources import tables

    monkeypatch.setattr(tables, "new_path", lambda *a: pytest.fail("a table is written"))
    plan = edits.resolved(chain(spark, [(i, i + 2) for i in range(200)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_runs_after_fixes_equal_one_fix_after_the_other(spark):
    rng = random.Random(8)
    made = []
    for k in range(60):
        text, at, all_runs, fixes = "".join(rng.choice("abcd ") for _ in range(30)), 0, [], []
        while at < 30:
            end = min(30, at + rng.randint(1, 9))
            all_runs.append({"text": text[at:end], "start": at, "end": end, "bold": rng.random() < 0.5})
            at = end
        at = 0
        while (at := at + rng.randint(0, 8)) < 28:
            end = at + rng.randint(0, 4)
            fixes.append({"s": at, "e": min(30, end), "fix": rng.choice(["", "X", "longer"])})
            at = end + 1
        made.append((1, k, all_runs, fixes))
    df = spark.createDataFrame(made, f"doc_id long, idx long, runs array<{office.RUN}>, fixes array<struct<s:int,e:int,fix:string>>")
    one_by_one = F.aggregate(F.reverse("fixes"), F.col("runs"), lambda acc, x: edits.adjust_runs(acc, x["s"], x["e"], x["fix"]))
    slim = lambda found: [(r.text, r.start, r.end, r.bold) for r in found if r.text]
    want = {r.idx: slim(r.x) for r in df.select("idx", one_by_one.alias("x")).collect()}
    got = {r.idx: slim(r.runs) for r in runs.after_fixes(df).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_runs_of_leaves_stay_where_they_are(spark):
    made = [
        ("a", 0, [("ab", 0, 2, True), ("", 2, 2, True), ("cd", 2, 4, False)], [(1, 1, "x"), (2, 3, "")]), ("a", 1, None, None), ("a", 2, [("gone", 0, 4, True)], [(0, 4, "")]),
        ("b", 7, [("ab", 0, 2, True), ("cd", 2, 4, False)], [(0, 0, "no"), (1, 3, "éé")]), ("b", 8, [("same", 0, 4, None)], []),
    ]
    df = spark.createDataFrame(made, "doc_id string, idx long, runs array<struct<text:string,start:int,end:int,bold:boolean>>, fixes array<struct<s:int,e:int,fix:string>>")
    got = runs.after_fixes(df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.idx): [tuple(x) for x in r.runs] for r in got.collect()} == {
        ("a", 0): [("a", 0, 1, True), ("x", 1, 2, True), ("b", 2, 3, True), ("", 3, 3, True), ("d", 3, 4, False)],
        ("b", 7): [("a", 2, 3, True), ("éé", 3, 5, True), ("d", 5, 6, False)], ("b", 8): [("same", 0, 4, None)],
    }


def test_ten_thousand_fixes_of_runs(spark):
    n = 10_000
    df = spark.createDataFrame([(1, 0, [{"text": "ab ", "start": 3 * i, "end": 3 * i + 3, "bold": i % 2 == 0} for i in range(n)], [{"s": 3 * i, "e": 3 * i + 2, "fix": "xyz"} for i in range(n)])], f"doc_id long, idx long, runs array<{office.RUN}>, fixes array<struct<s:int,e:int,fix:string>>")
    (row,) = runs.after_fixes(df).collect()
    assert len(row.runs) == 2 * n and "".join(r.text for r in row.runs) == "xyz " * n


def test_classes_of_ten_thousand_claims(article):
    el = article(*(f"The welcome bonus is ${100 + i % 4000}." for i in range(10_000)))
    classes = checks.claim_classes(checks.claims(el)).collect()
    assert len(classes) == 4000 and sum(r.links for r in classes) == 10_000**2 - sum(r.n**2 for r in classes)
    assert checks.claim_conflicts(checks.claims(el)).count() == 3999
    assert {r.lead.number for r in classes} == {100.0}


def test_registered_consistency(article):
    el = article("The welcome bonus is $500 for all.", "Our welcome offer gives $300 today.")
    assert checks.CHECKS["consistency"](el, lambda p: "PAIR 1: CONFLICT").count() == 1
    assert findings.union([checks.CHECKS["consistency"](el)]).count() == 0


def test_places_of_first_tokens_equal_brute_force(spark, article):
    rng = random.Random(5)
    terms = ["also", "as well as", "as", "in fact", "infact"]
    texts = ["".join(rng.choice(["also", "as", " ", " ", "well", "in", "fact", ", ", "é", "X", "" * odd]) for _ in range(rng.randrange(60))) for odd in (0, 1) for _ in range(60)]
    words = phrases.lexicon(spark, [(t,) for t in terms], "term string")
    for letters, plain in ((phrases.LETTERS, "[^\\W]"), (phrases.ASCII, "[A-Za-z0-9_]")):
        got = {(r.idx, r.term, r.s, r.e, r.m, r.before, r.after) for r in phrases.hits(article(*texts), words, 7, after=True, letters=letters).collect()}
        want = {(i, w, m.start(), m.end(), m[0], t[max(0, m.start() - 7) : m.start()], t[m.end() : m.end() + 7]) for i, t in enumerate(texts) for w in terms for m in re.finditer(f"(?i)(?<!{plain}){w}(?!{plain})", t)}
        assert got == want and got


def test_hits_in_a_long_leaf_cost_in_proportion(article, spark):
    words, begun = phrases.lexicon(spark, [("also",), ("as well as",)], "term string"), time.time()
    assert phrases.hits(article("also é " * 200_000), words).count() == 200_000
    assert time.time() - begun < 25  # each place was counted from the beginning of the leaf


def test_either():
    for words in (["you", "your", "you're", "a"], ["a"], ["ab", "abc", "b.c", "ab"]):
        assert [w for w in [*words, "bxc", "yo", "abcd"] if re.fullmatch(T.either(words), w)] == words


def test_first_tokens_that_begin_no_term_are_not_marked(spark, article):
    """First tokens may be frequent words; marking each of them cost most."""
    import re

    long = "the " + "way " * 40 + "out"
    words = ["the ring", "the ring road", "ring road", "the", "Kelvin", "ßa", long]
    pairs = phrases.lexicon(spark, [(w,) for w in words[:2]], "term string").collect()
    pattern = phrases.whole(pairs, phrases.ASCII)
    assert re.findall(pattern.replace("(?iu:", "(?i:"), "the road, the ring roads, other rings, THE RING") == ["the", "THE"]
    texts = ["The ring road the RING roads", "others the-ring the ring", "\u212aelvin kelvins KELVIN", "\u1e9eA ßa xßa", f"{long}, {long}s {long.upper()}", "the the ring ring road"]
    el = article(*texts)
    terms = phrases.lexicon(spark, [(w,) for w in words], "term string")
    got = {(r.idx, r.term, r.s, r.m) for r in phrases.hits(el, terms).collect()}
    token = r"(?<![^\W]){}(?![^\W])"
    want = {(i, w, m.start(1), m[1]) for i, t in enumerate(texts) for w in words for m in re.finditer("(?=(" + token.format(re.escape(w)) + "))", t, re.I)}
    assert got == want and len(want) > 15
