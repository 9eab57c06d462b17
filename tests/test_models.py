"""Voice models from states, person counts over whole texts and the dictionary, against brute force."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from proofmill.functions import lexicons as L
from proofmill.operators import checks, dictionary, profile
from proofmill.plans.articles import HARD, SOFT, elements

SF = "/root/testdata/sf0.001"


def test_states_of_parts_add_up_to_the_whole(spark, tmp_path):
    el = elements(spark, SF).where("doc_id < 60")
    whole = profile.state(el, HARD, SOFT)
    parts = [profile.state(el.where(f"doc_id % 3 = {k}"), HARD, SOFT) for k in range(3)]
    rows = lambda s: sorted(map(repr, s.select("brand", "article_type", "measure", "key", "n", "first").collect()))
    want = rows(whole)
    assert rows(profile.merged(*parts)) == want
    for p in parts:
        profile.save_state(p, str(tmp_path / "state"))
    assert rows(profile.load_state(spark, str(tmp_path / "state"))) == want
    assert {p.name for p in (tmp_path / "state").iterdir() if p.is_dir()} == {f"brand={r.brand}" for r in whole.select("brand").distinct().collect()}


def test_layers_with_few_articles_are_told(article):
    found = profile.from_state(profile.state(article("One two.", "Three four, however.")), 10, discouraged=["however"])
    report = {r.layer: (r.built, [x.layer_name for x in r.skipped]) for r in profile.layer_report(found).collect()}
    assert report == {"house": (1, []), "type": (0, ["t"]), "brand": (0, ["b"])}
    house = found.where("layer = 'house'").first()
    assert [(x.phrase, x.n, x.rate) for x in house.discouraged] == [("however", 1, 50.0)] and house.share is None and house.vote is None


def test_planned_layers_equal_those_of_the_state(spark):
    el = elements(spark, SF)
    order = lambda df: sorted(tuple(r) for r in df.select("layer", "layer_name", "articles", "built").collect())
    assert order(profile.planned(el, 20)) == order(profile.from_state(profile.state(el), 20))


def test_openers_are_limited_before_they_come_together(article):
    got = profile.openers(article("One two three. One two three. Four five.", *(f"Word{i} is here." for i in range(300))), 2)
    assert sorted((r.opener, r.n, r.rank, round(r.rate, 3)) for r in got.where("layer = 'house'").collect()) == [("four five.", 1, 2, 0.33), ("one two three.", 2, 1, 0.66)]
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_person_counts_cross_leaves(spark, article):
    rng = random.Random(9)
    words = ["new", "most", "players", "user", "can", "gives", "usually", "the", "if", "of", "number", "must", "customers", "who", "like", "é"]
    leaves = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(300)]
    el = article(*[("heading", 2, x) if i % 17 == 0 else x for i, x in enumerate(leaves)])
    text = "\n".join(x for i, x in enumerate(leaves) if i % 17)
    either = lambda t, ps: re.search("|".join(f"(?:{p})" for p in ps), t, re.I) is not None
    want = {"reader": 0, "generic": 0, "unclear": 0}
    for m in re.finditer(rf"(?i)\b({'|'.join(sorted(L.READER_NOUNS, key=len, reverse=True))})\b", text):
        b, a = text[max(0, m.start() - 50) : m.start()], text[m.end() : m.end() + 50]
        if either(b, L.GENERIC_ADJECTIVE + L.GENERIC_QUANTITY + L.GENERIC_ATTRACTION) or either(a, L.GENERIC_AFTER):
            want["generic"] += 1
        elif either(a, L.READER_AFTER) or (either(b, L.READER_BEFORE) and not either(b[-30:], L.GENERIC_ADJECTIVE)):
            want["reader"] += 1
        else:
            want["unclear"] += 1
    row = checks.person_counts(el).first()
    assert {k: row[k] for k in want} == want and min(want.values()) > 0


def test_dictionary_by_filter_and_by_broadcast(spark, article):
    el = article(("heading", 1, "The Bonus Players' Zorblax's Casino's Glasses"), "the bonus of a player and a glass is in the casino", ("heading", 2, "Bonus zorblax Été"))
    words = dictionary.word_frequencies(el)
    assert {r.word: r.n for r in words.where("n > 1").collect()} == {"the": 2, "a": 2}
    for most in (0, 100):
        got = sorted((r.idx, r.no, r.word) for r in dictionary.unknown_capitals(el, words, most).collect())
        assert got == [(0, 3, "Zorblax's"), (0, 5, "Glasses"), (2, 2, "Été")]
    probes = spark.range(3000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    some = probes.where("length(word) < 4")
    kept = {r.word for r in dictionary.maybe(probes, "word", some).collect()}
    assert {r.word for r in some.collect()} <= kept and len(kept) < 150
    assert checks.headings(el, "sentence", dictionary=words).where("sub_check = 'capitalization' AND auto_applicable").count() == 0


def test_settings_merge_as_nested_dictionaries_do(spark):
    import json

    from proofmill.sources import config, settings

    rng = random.Random(11)

    def tree(depth):
        kinds = [lambda: rng.randint(0, 9), lambda: None, lambda: [1, {"a": 2}], lambda: "x.y", lambda: {}]
        return {rng.choice("abcd"): tree(depth - 1) if depth and rng.random() < 0.6 else rng.choice(kinds)() for _ in range(rng.randint(1, 4))}

    def leaves(t, at=()):
        for k, v in t.items():
            yield from leaves(v, (*at, k)) if isinstance(v, dict) and v else [((*at, k), json.dumps(v, separators=(",", ":")))]

    def clean(t):  # an empty object says nothing
        return {k: clean(v) if isinstance(v, dict) else v for k, v in t.items() if v != {}}

    made = [(k, clean(tree(3)), clean(tree(3))) for k in range(25)] + [(None, {"a": 1}, {"a": {"b": None}})]
    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, a, b in made] + [(99, "[1]", "bad"), (98, None, "{}")], "owner int, a string, b string")
    base, over = settings.paths(df, "owner", "a"), settings.paths(df, "owner", "b")
    got = {(r.owner, tuple(r.path), r.value) for r in settings.merged(base, over, "owner").collect()}
    assert got == {(k, p, v) for k, a, b in made for p, v in leaves(config.deep_merge(a, b))}
    assert {(r.owner, r.value) for r in settings.value_at(base, "a").collect()} >= {(None, "1")}


def test_the_corpus_is_read_once_for_its_words(article):
    found = dictionary.word_frequencies(article("we play we", ("heading", 1, "We Playz")))
    assert found.inputFiles() and {tuple(r) for r in found.select("word", "n").collect()} == {("we", 2), ("play", 1)}
    capitals = dictionary.unknown_capitals(article(("heading", 1, "We Playz Play")), found)
    assert [r.word for r in capitals.collect()] == ["Playz"] and capitals.inputFiles()
