from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proofmill.operators import briefs_checks, checks, document, edits, findings, profile, reports
from proofmill.sources import config

TERMS = [(t, w, config.stop_pattern(w)) for t, w in (("hard", "delve"), ("hard", "dive in"), ("soft", "key"))]
H = lambda n, t: ("heading", n, t)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def fixes(df):
    return rows(df, "sub_check", "original_text", "proposed_text", "auto_applicable")


def test_sections(article):
    el = article(H(1, "A"), "x", H(2, "B"), H(3, "C"), H(2, "D"), "y", H(1, "E"), "z")
    got = rows(document.sections(el), "section_idx", "idx", "parent_idx", "next_idx", "root_idx")
    assert got == [(0, 0, None, 6, 0), (1, 2, 0, 4, 0), (2, 3, 2, 4, 0), (3, 4, 0, 6, 0), (4, 6, None, None, 6)]
    assert rows(document.with_sections(el).where("idx IN (1, 5, 7)"), "idx", "section_title") == [(1, "A"), (5, "A"), (7, "E")]


def test_offsets_and_text(article):
    el = article("ab", "", "c🙂")
    assert rows(el, "idx", "start_offset", "end_offset") == [(0, 0, 2), (1, 3, 3), (2, 4, 6)]
    assert document.full_text(el).first().full_text == "ab\n\nc🙂"


def test_stop_words(article):
    el = article("We delve and dive in. " + "word " * 20 + "key", H(1, "delve"))
    assert rows(checks.stop_words(el, TERMS), "sub_check", "original_text", "start_offset") == [("hard", "delve", 3), ("hard", "dive in", 13), ("soft", "key", 122)]
    assert rows(checks.stop_words(article("key " + "word " * 300), TERMS), "sub_check") == []


@pytest.mark.parametrize(
    ("text", "kind"),
    [("Players can claim it.", "reader"), ("New players get it.", "generic"), ("It attracts players here.", "generic"), ("Most users win.", "generic"), ("It gives players more.", "reader"), ("Players usually prefer slots.", "generic"), ("The player smiled.", "unclear"), ("if players deposit", "reader"), ("player protection", "generic")],
)
def test_person_kinds(article, text, kind):
    assert rows(checks.person_references(article(text)), "kind") == [(kind,)]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Players can claim it.", "You can claim it."), ("The player must verify.", "You must verify."), ("Here the user has to wait.", "Here you have to wait."), ("If the player's bonus ends, players can ask.", "If your bonus ends, players can ask.")],
)
def test_voice_rewrite(article, text, want):
    assert want in {r.proposed_text for r in checks.voice(article(text)).collect()}


def test_voice_leaves_complex_sentences_to_people(article):
    got = fixes(checks.voice(article("Players can help themselves. Users who like it can stay.")))
    assert not any(r[3] for r in got) and checks.voice(article("Players can go."), person="third").count() == 0


def test_headings(article):
    el = article(H(1, "A great start"), "x", H(3, "How do I play?"), H(1, "bonus"), H(2, "FAQ"), H(3, "Is it safe?"))
    got = checks.headings(el)
    assert ("question_mark", "How do I play?", "How do I play", False) in fixes(got)
    assert "Is it safe?" not in {r.original_text for r in got.where("sub_check = 'question_mark'").collect()}
    assert rows(got.where("sub_check = 'skipped_level'"), "original_text") == [("How do I play?",)]
    assert rows(got.where("sub_check = 'descriptive'"), "original_text") == [("FAQ",), ("bonus",)]
    assert rows(got.where("sub_check = 'multiple_h1'"), "original_text") == [("A great start",)]
    assert ("capitalization", "A great start", "A Great Start", True) in fixes(got) and ("blank_line", "bonus", None, False) in fixes(got)


def test_currency(article):
    el = article("Get $500 USD now, $20 and $30 and $40 then 50 EUR.")
    assert rows(checks.currency_occurrences(el), "style", "m") == [("code", "50 EUR"), ("combined", "$500 USD"), ("symbol", "$20"), ("symbol", "$30"), ("symbol", "$40")]
    assert fixes(checks.currency(el)) == [("combined", "$500 USD", "$500", True), ("consistency", "50 EUR", "€50", True)]
    assert checks.currency(el, mode="any").count() == 0


def test_rows_of_signs_are_no_currency(article):
    el = article("Whthly$$$ 170.116.163.254 and onat$$$ 25 EUR for $20 or R$ 30, onenouth$$$ $500 USD.")
    assert rows(checks.currency_occurrences(el), "style", "m") == [("code", "25 EUR"), ("combined", "$500 USD"), ("symbol", "$20"), ("symbol", "R$ 30")]


def test_claims_are_the_same_with_a_look_ahead():
    import random
    import re

    from proofmill.functions import lexicons as L

    rng, found = random.Random(5), 0
    parts = ["$", "$1,200.50", "35x", "12x3", "150%", "7 %", "40 games", "1,000+ Slots", ",", "\n", "aaaa bbbb cccc dddd eeee ", "x", " ", "9"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        for k, p in L.CLAIM_PATTERNS.items():
            want = [m.group() for m in re.finditer(p, text, re.I)]
            assert [m.group() for m in re.finditer(checks.AHEAD[k] + p, text, re.I)] == want
            assert bool(re.search(re.sub(r"\.\{0,\d+\}\??", "", p), text, re.I)) == bool(want)
            found += len(want)
    assert found > 500


def test_claims_found_by_their_values_equal_the_whole_patterns(article):
    import random
    import re

    from proofmill.functions import lexicons as L

    rng = random.Random(8)
    parts = ["$", "$1,200.50", "$70", "35x", "12x3", "150%", "7 %", "1500%", "40 games", "1,000+ Slots", ",", "\r", "\u2028", "aaaa bbbb cccc dddd eeee ", "welcome x", " ", "9", "\U0001f600", "…"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    texts += [x + "\ue000$90\ue001" for x in texts[:20]]
    el, want, at = article(*texts), [], 0
    for text in texts:
        for k, p in L.CLAIM_PATTERNS.items():
            for m in re.finditer(p.replace(".{0,", "[^\n\r\x85\u2028\u2029]{0,"), text, re.I | re.A):
                number = float(re.sub(r"(?i)[x%+]$", "", re.sub(r"[$,\s]", "", m[1])) or 0)
                if number >= {"GAME_COUNT": 10, "BONUS_AMOUNT": 5}.get(k, 0):
                    want.append((k, at + m.start(), m[1], number, m[0].strip(" ")))
        at += len(text) + 1
    found = checks.claims(el)
    assert len(want) > 500 and rows(found, "category", "offset", "value", "number", "context") == sorted(want)
    # no place is tried for a claim that begins up to 40 characters before its value, and values are counted without a sort
    classes = checks.claim_classes(found, ())
    plan = classes._jdf.queryExecution().executedPlan().toString()
    assert ".{0,40}?" not in plan and "SortAggregate" not in plan
    cols = ("kind", "number", "links", "offset")
    assert rows(classes.select("*", "first.offset"), *cols) == rows(checks.claim_classes(found).select("*", "first.offset"), *cols)


def test_transitions_are_looked_for_only_where_they_stand(article):
    got = profile.transitions(article("Also, alsoo and thusly. Thus also", "As well as"))
    assert rows(got.where("layer = 'house'"), "phrase", "n") == [("also", 2), ("and", 1), ("as well as", 1), ("thus", 1)]
    assert "contains" in got._jdf.queryExecution().executedPlan().toString().lower()


def test_formatting(article):
    got = fixes(checks.formatting(article("Two  spaces , here.Zoos e.g. visit site.com or v1.2 end ")))
    assert ("double_space", "  ", " ", True) in got and ("space_before_punct", " ,", ",", True) in got and ("missing_space", ".Z", ". Z", True) in got
    assert ("latin", "e.g.", "for example", False) in got and ("trailing_space", " ", "", True) in got
    assert not any(r[1] == ".c" for r in got)


def test_spelling(article):
    got = fixes(checks.locale_spelling(article('The Color and "color" of a check, COLOR at color.com'), "british"))
    assert got == [("context", "check", "cheque", False), ("our_or", "COLOR", "COLOUR", True), ("our_or", "Color", "Colour", True)]
    assert fixes(checks.locale_spelling(article("a programme"), "american")) == [("other", "programme", "program", True)]


def test_brands(article):
    el = article("Moon Harbor beats Stake. Place a stake at MoonHarbor or www.moon-harbor.com.")
    got = fixes(checks.brand_names(el, "MoonHarbor", ["Stake", "Moon Harbor"]))
    assert got == [("competitor", "Stake", None, False), ("own_brand", "Moon Harbor", "MoonHarbor", True)]
    assert not any(r[3] for r in fixes(checks.brand_names(el, "MoonHarbor", [], dominance=0.5)))


def test_dominant_operator_is_protected(article):
    el = article("Bet365 " * 6 + "and Unibet.")
    assert rows(checks.dominant_operator(el, ["Bet365", "Unibet"], "Moon"), "name", "n", "second") == [("Bet365", 6, 1)]
    assert rows(checks.brand_names(el, "Moon", ["Bet365", "Unibet"]), "original_text") == [("Unibet",)]


def test_keywords(spark, article):
    el = article("Moon casino offers. The best moon casino bonus and moon casinos here today, slots and free big spins.")
    asked = spark.createDataFrame([(1, "moon casino", 3, None, "main"), (1, "moon casino bonus", 1, 1, "main"), (1, "free spins", 1, None, "main"), (1, "poker", 1, None, "lsi")], "doc_id long, keyword string, low int, high int, grp string")
    assert rows(briefs_checks.keyword_counts(el, asked), "keyword", "n") == [("free spins", 0), ("moon casino", 2), ("moon casino bonus", 1), ("poker", 0)]
    got = rows(briefs_checks.keywords(el, asked, brand="moon"), "sub_check", "reasoning")
    assert ("wrong_construction", "missing: free spins") in got and ("truly_absent", "missing: poker") in got and ("below_min", "moon casino 2 of 3") in got and ("brand_overuse", "moon") in got
    marks = spark.createDataFrame([(1, "Moon  Casinos")], "doc_id long, text string")
    assert rows(briefs_checks.unhighlighted(el, asked, marks), "keyword") == [("moon casino bonus",)]


def test_structure(spark, article):
    el = article(H(1, "Welcome Bonuses"), "short", H(3, "End"))
    required = spark.createDataFrame([(1, "Bonuses"), (1, "Support"), (1, "H2 #1")], "doc_id long, heading string")
    targets = spark.createDataFrame([(1, 10)], "doc_id long, target int")
    got = rows(briefs_checks.structure(el, required, targets), "sub_check", "reasoning")
    assert got == [("hierarchy", "a level is skipped"), ("intro", "no introduction"), ("missing_section", "missing: Support"), ("outro", "no closing paragraph"), ("word_count", "4 under 10")]


def test_consistency(article):
    el = article("The welcome bonus is $500 for all.", "Our welcome offer gives $300 today.", "A reload of $100.")
    pairs = checks.claim_conflicts(checks.claims(el))
    assert rows(pairs, "kind", "value", "value_b") == [("welcome", "$500", "$300")]
    assert rows(checks.consistency(el, lambda p: "PAIR 1: CONFLICT"), "original_text", "reasoning") == [("The welcome bonus is $500 for all.", "elsewhere: $300")]
    for ask in (None, lambda p: None, lambda p: "PAIR 1: DIFFERENT", lambda p: 1 / 0):
        assert checks.consistency(el, ask).count() == 0


def test_finding_id(spark, article):
    import hashlib

    f = findings.union([checks.formatting(article("a  b"))]).first()
    assert f.finding_id == hashlib.sha256(b"formatting:1:3:  ").hexdigest()[:16]


def test_registry_rejects_a_second_name():
    with pytest.raises(ValueError):
        checks.check("voice")(lambda el: el)


def test_edits(spark, article):
    el = article("Two  spaces , here", "same")
    cols = "doc_id long, check_name string, sub_check string, category string, severity string, confidence double, idx long, start_offset long, end_offset long, original_text string, proposed_text string, reasoning string, auto_applicable boolean"
    mine = lambda s, e, a, b: (1, "t", "x", "c", "warning", 1.0, 0, s, e, a, b, "", True)
    f = findings.union([spark.createDataFrame([mine(3, 5, "  ", " "), mine(4, 11, " spaces", " gaps"), mine(11, 13, " ,", ","), mine(14, 18, "wrong", "x"), mine(0, 0, "", "")], cols)])
    judged = edits.resolved(edits.validated(f, el))
    assert rows(judged, "status", "start_offset") == [("applied", 3), ("applied", 11), ("downgraded", 4), ("skipped", 14)]
    assert judged.where("status = 'downgraded'").first().conflicts_with == f.where("start_offset = 3").first().finding_key
    done = edits.applied(el, judged)
    assert rows(done, "text", "start_offset") == [("Two spaces, here", 0), ("same", 17)]
    made = reports.comments(el, f, judged)
    assert made.count() == 1 and reports.markdown(made).first().markdown.startswith("## Document")
    assert rows(reports.run_summary(f, judged), "check_name", "applied", "proposals") == [("t", 2, 1)]


def test_edits_keep_their_invariants(article):
    el = article(*[f"Some  text ,with  faults{i} .Here  " for i in range(5)])
    f = findings.union([checks.formatting(el)])
    judged = edits.resolved(edits.validated(f, el)).collect()
    assert len(judged) == edits.candidates(f).count()
    spans = sorted((r.start_offset, r.end_offset) for r in judged if r.status == "applied")
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_adjust_runs(spark):
    runs = [("Hello ", 0, 6, False), ("bold", 6, 10, True), (" end", 10, 14, False)]
    df = spark.createDataFrame([(runs,)], "r array<struct<text:string,start:int,end:int,bold:boolean>>")
    got = df.select(edits.adjust_runs(F.col("r"), F.lit(5), F.lit(9), F.lit("XY")).alias("x")).first().x
    assert [tuple(x) for x in got] == [("Hello", 0, 5, False), ("XY", 5, 7, True), ("d", 7, 8, True), (" end", 8, 12, False)]


def test_profile(article):
    el = article(H(1, "A Great Start"), "One two three four. Five six, seven eight nine. And ten.", ("list_item", None, "item"))
    m = profile.models(el).where("layer = 'house'").first()
    assert (m.articles, m.sentences, m["mean"], m.median, m.p10, m.p90, m.commas, m.vote, m["items"]) == (1, 3, 11 / 3, 4.0, 2, 5, 1, "title", 1)
    assert {r.layer for r in profile.article_counts(el).collect()} == {"house", "type", "brand"} and profile.models(el).count() == 1
    top = profile.openers(el).where("layer = 'house'").collect()
    assert {(r.opener, r.n) for r in top} == {("one two three", 1), ("five six, seven", 1), ("and ten.", 1)}
    assert [round(r.rate, 2) for r in top] == [33.33] * 3 and top[0].opener == "one two three"  # the first of as frequent ones
    assert [r.layer for r in profile.for_brand(profile.article_counts(el), "b", "t").collect()] == ["house", "type", "brand"]


def test_places_and_last_leaves_are_shuffled_without_the_texts(spark, article):
    import io
    from contextlib import redirect_stdout

    el = article(("paragraph", None, "one two three four five, six"), ("paragraph", None, "a b c d e"), ("heading", 1, "Top"), ("paragraph", None, "g h i j k l m"), ("paragraph", None, " "))
    assert rows(briefs_checks.intro_outro(el), "first_heading", "intro", "last_type", "last_words", "idx", "t") == [(2, 1, "paragraph", 7, 3, "g h i j k l m")]
    none = briefs_checks.intro_outro(article("", "a  b")).first()
    assert (none.first_heading, none.intro, none.last_words) == (None, 0, 2)
    shown = io.StringIO()
    with redirect_stdout(shown):
        briefs_checks.intro_outro(el).explain()
    assert shown.getvalue().count(" Window [") == 1  # that of the offsets above; all leaves came together once more
    assert [r.text for r in checks.heading_rows(el).collect()] == ["Top"]
