from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from proofmill.functions import lexicons as L
from proofmill.functions import text as T
from proofmill.sources import config


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("pattern", ["  +", r"\b[a-z]+\b", r"(?<![A-Za-z])(C\$|\$)\s*\d+", r"[,.][A-Za-z]", r"a+b?"])
def test_match_spans_equal_finditer(spark, pattern):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab C$$1 ,.é🙂") for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.match_spans(F.col("t"), pattern).alias("x")).collect()
    for r in rows:
        assert [(m["start"], m["end"], m["text"]) for m in r.x] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r.t, re.ASCII)] or "é" in r.t


@pytest.mark.parametrize(("text", "want"), [("the best of moon", "The Best of Moon"), ("WHAT is rtp", "What Is RTP"), ("a", "A"), ("play on", "Play On")])
def test_title_case(spark, text, want):
    assert one(spark, text, T.title_case) == want


def test_sentence_case(spark):
    assert one(spark, "The Best VIP Offers For MoonHarbor USA", T.sentence_case) == "The best VIP offers for MoonHarbor USA"


@pytest.mark.parametrize(("source", "target", "want"), [("COLOR", "colour", "COLOUR"), ("Color", "colour", "Colour"), ("color", "colour", "colour")])
def test_preserve_case(spark, source, target, want):
    assert one(spark, source, lambda c: T.preserve_case(c, F.lit(target))) == want


@pytest.mark.parametrize(("required", "actual", "want"), [("Bonuses", "Welcome Bonuses and Promotions", True), ("Payment Methods", "Methods of Payment", True), ("Bonuses", "Customer Support", False), ("", "x", False)])
def test_fuzzy_heading(spark, required, actual, want):
    assert one(spark, actual, lambda c: T.fuzzy_heading(F.lit(required), c)) is want


@pytest.mark.parametrize(("text", "want"), [("bonus (bônus)", "bonus"), ("(ITA: bonus) bônus", "bônus"), ("  casino  review ", "casino review")])
def test_clean_keyword(spark, text, want):
    assert one(spark, text, T.clean_keyword) == want


@pytest.mark.parametrize(("text", "want"), [("H2 #1", True), ("Link 1 — Anchor", True), ("casino bonus", False), ("", True), (None, True)])
def test_metadata_labels(spark, text, want):
    assert one(spark, text, T.is_metadata_label) is want


def test_prose_sentences(spark):
    assert one(spark, "Dr. Smith won 2.5 points. He left! A. Who?", T.prose_sentences) == ["dr. Smith won 2.5 points.", "He left!", "A.", "Who?"]


def test_formatting_hint(spark):
    assert one(spark, "Please add empty lines between blocks", T.formatting_hint) == "required"
    assert one(spark, "no blank rows between; add empty rows between", T.formatting_hint) == "none"
    assert one(spark, "nothing", T.formatting_hint) is None


def test_swaps_by_region():
    swaps = {(r, w): c for r, w, c in L.swaps()}
    assert swaps["british", "organize"] == "organise" and swaps["british", "catalog"] == "catalogue" and swaps["british", "traveler"] == "traveller"
    assert swaps["american", "programme"] == "program" and ("british", "program") not in swaps
    assert swaps["canadian", "color"] == "colour" and swaps["canadian", "organise"] == "organize" and ("canadian", "organize") not in swaps
    assert swaps["british", "analyze"] == "analyse" and swaps["british", "erconnoiter"] == "reconnoitre"


def test_stop_patterns():
    assert re.search(config.stop_pattern("utilize"), "utilizing it") and re.search(config.stop_pattern("unlock"), "unlocked") and not re.search(config.stop_pattern("dive in"), "dive inn")


def test_brand_patterns():
    assert config.split_brand("MoonHarbor") == ["Moon", "Harbor"] and config.split_brand("22Bet") == ["22", "Bet"] and config.split_brand("Moonfortune") == ["Moon", "fortune"]
    assert re.search(config.brand_pattern("MoonHarbor"), "the moon-harbor site") and not re.search(config.brand_pattern("22Bet"), "122bet")


def test_deep_merge():
    assert config.deep_merge({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}, "d": None}) == {"a": {"b": 1, "c": [2]}, "d": None}
    assert config.get({"a": {"b": 1}}, "a.b") == 1 and config.get({}, "a.b", 5) == 5


def test_standards(tmp_path, spark):
    (tmp_path / "_defaults.yaml").write_text("voice: {person: second}\nlist: [1, 2]\n")
    (tmp_path / "moon.yaml").write_text("list: [3]\nvoice: {tone: warm}\n")
    s = config.Standards(str(tmp_path))
    assert s.brands() == ["moon"] and s.has("moon") and not s.has("x")
    assert s.load("moon") == {"voice": {"person": "second", "tone": "warm"}, "list": [3]} and s.load("x") == s.load()
    assert {(r.path, r.value) for r in s.table(spark).collect()} == {("voice.person", "second"), ("voice.tone", "warm"), ("list", "[3]")}


def test_starts_and_spans_of_long_texts(spark):
    import re

    from proofmill.sources import corpus

    for n in (1, 64, 65, 5000):
        text = "\n".join(f"line {i}  é" + "x" * (i % 7) for i in range(n))
        docs = spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")
        want, at = [], 0
        for line in text.split("\n"):
            want.append(at)
            at += len(line) + 1
        assert [r.start_offset for r in corpus.from_text(docs).orderBy("idx").collect()] == want
        flat = text.replace("\n", " ")
        for t in (flat, flat + T.OPEN + "  z"):  # texts that hold the marks themselves are walked another way
            row = spark.createDataFrame([(t,)], "t string").select(T.match_spans(F.col("t"), "  +").alias("m")).first()
            assert [(x.start, x.end) for x in row.m] == [m.span() for m in re.finditer("  +", t)]


def test_leaves_without_a_match_are_only_searched(spark):
    from proofmill.functions import text as T
    from proofmill.operators import phrases

    df = spark.createDataFrame([("a  b",), ("ab",), (None,), ("\ue000  ",)], "text string")
    spans = df.select(T.match_spans(F.col("text"), "  +").alias("x"))
    assert "rlike" in spans._jdf.queryExecution().analyzed().toString().lower()
    assert [r.x and [(y.start, y.end) for y in r.x] for r in spans.collect()] == [[(1, 3)], [], [], [(1, 3)]]
    assert phrases.few(["moon", "moonharbor"], phrases.LETTERS) and not phrases.few(["i\u0307"], phrases.LETTERS)
