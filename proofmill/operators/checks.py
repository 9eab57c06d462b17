"""The rule checks. Each takes an elements table and gives findings; all of them stay inside JVM expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..sources.config import split_brand, stop_forms
from ..sources.corpus import in_order
from . import phrases
from .dictionary import unknown_capitals
from .document import of_type
from .findings import make, make_each

#: Registered checks by name; user checks add themselves.
CHECKS: dict[str, Callable[..., DataFrame]] = {}


def check(name: str):
    def register(f):
        if name in CHECKS:
            raise ValueError(f"there is a check {name} already")
        CHECKS[name] = f
        return f

    return register


def spans(el: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """A row for each match, with s, e (in the leaf) and m; one pass of the pattern over each leaf."""
    rows = el.select("*", F.explode(T.match_spans(F.col("text"), pattern, ignore_case)).alias("x"))
    return rows.select("*", F.col("x.start").alias("s"), F.col("x.end").alias("e"), F.col("x.text").alias("m")).drop("x")


def at(col: str) -> Column:
    return F.col("start_offset") + F.col(col)


# --- stop words ---


def stop_word_hits(el: DataFrame, terms: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, idx, …, tier, term, s, e, m) of each stop word in paragraphs, in any of its forms. terms: (tier, term, …)."""
    forms = [(tier, term, form) for tier, term, *_ in terms for form in stop_forms(term)]
    words = phrases.terms(el.sparkSession.createDataFrame(forms, "tier string, term string, form string"), "form")
    return phrases.hits(of_type(el, "paragraph"), words).drop("form")


def soft_gate(el: DataFrame, hits: DataFrame, share: float = 0.005) -> DataFrame:
    """Documents whose soft stop words are over share of their paragraphs' words."""
    words = of_type(el, "paragraph").groupBy("doc_id").agg(F.sum(T.space_words(F.col("text"))).alias("words"))
    soft = hits.where("tier = 'soft'").groupBy("doc_id").agg(F.count("*").alias("soft"))
    return soft.join(words, "doc_id").where(F.col("soft") / F.col("words") > share)


def stop_word_counts(el: DataFrame, terms: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, hard, soft, total_words) of every document with a paragraph."""
    words = of_type(el, "paragraph").groupBy("doc_id").agg(F.sum(T.space_words(F.col("text"))).alias("total_words"))
    n = stop_word_hits(el, terms).groupBy("doc_id").agg(*(F.count_if(F.col("tier") == k).alias(k) for k in ("hard", "soft")))
    return words.join(n, "doc_id", "left").select("doc_id", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("hard", "soft")), "total_words")


@check("stop_words")
def stop_words(el: DataFrame, terms: list[tuple[str, str, str]], share: float = 0.005) -> DataFrame:
    hits = stop_word_hits(el, terms)
    hard = F.col("tier") == "hard"
    words = of_type(el, "paragraph").groupBy("doc_id").agg(F.sum(T.space_words(F.col("text"))).alias("words"))
    soft = F.count_if(~hard).over(Window.partitionBy("doc_id"))
    kept = hits.withColumn("soft", soft).join(words, "doc_id").where(hard | (F.col("soft") / F.col("words") > share))
    return make(kept, "stop_words", F.col("tier"), "style", F.when(hard, "warning").otherwise("suggestion"), F.when(hard, 0.9).otherwise(0.6), at("s"), at("e"), F.col("m"), None, F.concat(F.lit("stop word: "), F.col("term")), False)


# --- third person to second ---

#: Patterns begin with a look at the letters that their matches begin with: most places are passed by it.
NOUN = f"(?=[{''.join(sorted({w[0] for w in L.READER_NOUNS}))}])" + r"\b(" + "|".join(sorted(L.READER_NOUNS, key=len, reverse=True)) + r")\b"


#: Words, white space and ends as they are where only ASCII letters and digits make words (RE2, DuckDB).
PLAIN = {r"\b": r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))", r"\s": r"[\t\n\f\r ]", "$": r"\z", ".*": r"[^\n]*"}


def plain_words(pattern: str) -> str:
    return re.sub(r"\\[bs]|\$|(?<!\\)\.\*", lambda m: PLAIN[m[0]], pattern)


def any_of(text: Column, patterns: list[str], plain: bool = False) -> Column:
    """Whether one of the patterns is found. With plain only ASCII letters and digits make words."""
    found = "|".join(f"(?:{p})" for p in patterns)
    return text.rlike("(?iu)" + plain_words(found) if plain else "(?iU)" + found)


def person_kind(before: Column, after: Column, plain: bool = False) -> Column:
    """reader, generic or unclear, from the 50 characters on either side; the first rule that holds decides."""
    has = lambda text, patterns: any_of(text, patterns, plain)
    return (
        F.when(has(before, L.GENERIC_ADJECTIVE) | has(before, L.GENERIC_QUANTITY) | has(before, L.GENERIC_ATTRACTION) | has(after, L.GENERIC_AFTER), "generic")
        .when(has(after, L.READER_AFTER), "reader")
        .when(has(before, L.READER_BEFORE) & has(F.substring(before, -30, 30), L.GENERIC_ADJECTIVE), "generic")
        .when(has(before, L.READER_BEFORE), "reader")
        .otherwise("unclear")
    )


def person_references(el: DataFrame) -> DataFrame:
    """(…, sentence, ss, se, s, e, m, kind) of each noun for a reader in the sentences of paragraphs."""
    rows = of_type(el, "paragraph").where(F.col("text").rlike("(?i)" + NOUN))
    cut = F.regexp_replace(F.col("text"), r"(?<=[.!?])\s+(?=[A-Z])", "$0\u0001")
    place = lambda x, at: F.struct(F.rtrim(x).alias("t"), at.alias("s"))
    parts = T.let(F.split(cut, "\u0001"), lambda ps: F.zip_with(ps, T.starts(F.transform(ps, F.length)), place))
    rows = rows.select("*", F.explode(parts).alias("p")).select("*", F.col("p.t").alias("sentence"), F.col("p.s").alias("ss"))
    rows = rows.select("*", F.explode(T.match_spans(F.col("sentence"), NOUN, True)).alias("x"))
    rows = rows.select("*", F.col("x.start").alias("s"), F.col("x.end").alias("e"), F.col("x.text").alias("m")).drop("p", "x")
    before = F.substring("sentence", F.greatest(F.col("s") - 50, F.lit(0)) + 1, F.least(F.col("s"), F.lit(50)))
    after = F.substring("sentence", F.col("e") + 1, F.lit(50))
    return rows.withColumn("kind", person_kind(before, after))


def prose(el: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, carry, text): each document's paragraphs in order, joined by line feeds."""
    parts = F.array_sort(F.collect_list(F.when(F.col("elem_type") == "paragraph", F.struct("idx", "text"))))
    rows = el.groupBy("doc_id", *carry).agg(parts.alias("p"))
    return rows.select("doc_id", *carry, F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def person_kinds(texts: DataFrame, plain: bool = False) -> DataFrame:
    """The columns of texts but text, and kind of each noun for a reader: judged by 50 characters of the whole text on
    either side, whatever sentences and paragraphs they belong to. With plain only ASCII letters and digits make words."""
    nouns = phrases.lexicon(texts.sparkSession, [(w,) for w in L.READER_NOUNS], "term string")
    found = phrases.hits(texts, nouns, 50, after=True, letters=phrases.ASCII if plain else phrases.LETTERS)
    return found.withColumn("kind", person_kind(F.col("before"), F.col("after"), plain))


def person_counts(el: DataFrame, plain: bool = False) -> DataFrame:
    """(doc_id, reader, generic, unclear) of documents with such nouns, counted over the whole prose."""
    return person_kinds(prose(el), plain).groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("reader", "generic", "unclear")))


def second_person(sentence: Column, s: Column, e: Column, noun: Column) -> Column:
    """The sentence with the noun (and an article before it, a possessive after it) as 'you' or 'your', in its case."""
    before, after = F.substring(sentence, F.lit(1), s), F.substring(sentence, e + 1, F.length(sentence))
    owner = after.rlike("^['’]s\\b") | (F.lower(noun).endswith("s") & after.rlike("^['’](?!\\w)"))
    tail = F.when(owner, F.regexp_replace(after, "^['’]s?", "")).otherwise(after)
    head = F.regexp_replace(before, r"(?i)\b(?:the|an?)\s+$", "")
    word = F.when(owner, "your").otherwise("you")
    word = F.when((head == "") | (F.upper(F.substring(noun, 1, 1)) == F.substring(noun, 1, 1)), T.capital(word)).otherwise(word)
    for a, b in L.VERB_AGREEMENT.items():
        single = F.lower(noun).isin(L.SINGULAR_NOUNS) & ~owner
        tail = F.when(single, F.regexp_replace(tail, rf"^(\s+){a}\b", "$1" + b)).otherwise(tail)
    return F.concat(head, word, tail)


@check("voice")
def voice(el: DataFrame, person: str = "second") -> DataFrame:
    """Sentences that speak of readers in the third person; nothing unless the standard is the second person."""
    refs = person_references(el.where(F.lit(person == "second")))
    mixed = F.size(F.collect_set("kind").over(Window.partitionBy("doc_id", "idx", "ss"))) > 1
    hard = any_of(F.col("sentence"), [r"\b(themselves|himself|herself|themself)\b", r"\bthan\s+other\s+", r"\bplayers?\s+(who|that|whom)\b"]) | mixed
    refs = refs.withColumn("hard", hard).where("kind <> 'generic'")
    auto = (F.col("kind") == "reader") & ~F.col("hard")
    return make(
        refs, "voice", F.col("kind"), "voice", "warning", F.when(F.col("kind") == "reader", 0.95).otherwise(0.4), at("ss"), at("ss") + F.length("sentence"), F.col("sentence"),
        second_person(F.col("sentence"), F.col("s"), F.col("e"), F.col("m")), F.concat(F.lit("third person: "), F.col("m")), auto,
    )


# --- headings ---


def heading_rows(el: DataFrame) -> DataFrame:
    """Headings with the element and heading before them, the number of H1 and whether they stand in a FAQ section.

    A FAQ section runs to the next heading of its level or a smaller one; of the FAQ headings so far, the one whose
    section ends last covers what lies before that end.
    """
    w, by = in_order(), Window.partitionBy("doc_id")
    # the text of other leaves stays where it is: of them only places take part
    rows = el.withColumn("text", F.when(F.col("elem_type") == "heading", F.col("text")))
    rows = rows.withColumn("prev_end", F.lag("end_offset").over(w)).where("elem_type = 'heading'")
    rows = rows.withColumn("prev_level", F.lag("level").over(w)).withColumn("h1", F.count_if(F.col("level") == 1).over(by))
    rows = rows.withColumn("h1_no", F.count_if(F.col("level") == 1).over(w))
    after = by.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.coalesce(*(F.when(F.col("level") == k, F.last(F.when(F.col("level") <= k, F.col("idx")), ignorenulls=True).over(after)) for k in (1, 2, 3, 4)), F.lit(1 << 60))
    rows = rows.withColumn("faq_end", F.when(any_of(F.lower("text"), L.FAQ_WORDS), ends))
    return rows.withColumn("in_faq", F.coalesce(F.max("faq_end").over(w.rowsBetween(Window.unboundedPreceding, 0)) > F.col("idx"), F.lit(False)))


def special_words(text: Column, known: list[str] | None = None) -> Column:
    """Whether a heading has an acronym, a proper noun, a word in capitals or mixed case, or an unknown capitalised word."""
    words = T.tokens(text)
    proper = [p.lower() for p in L.PROPER_NOUNS]

    def special(w: Column, i: Column) -> Column:
        plain = T.letters_of(w)
        out = T.is_acronym(w) | F.lower(plain).isin(proper) | ((F.length(plain) >= 2) & (F.upper(plain) == plain)) | T.mixed_case(plain)
        if known is not None:
            out = out | ((i > 0) & w.rlike("^[A-Z]") & ~F.lower(plain).isin(known))
        return out

    return F.exists(F.transform(words, special), lambda x: x)


@check("headings")
def headings(el: DataFrame, capitalization: str | None = "title", known: list[str] | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """dictionary: (word), as dictionary.word_frequencies gives; headings with capitalised words outside it are left to people."""
    h = heading_rows(el).withColumn("unknown", F.lit(False))
    if dictionary is not None:
        odd = unknown_capitals(el, dictionary).select("doc_id", "idx").distinct().withColumn("odd", F.lit(True))
        h = h.join(odd, ["doc_id", "idx"], "left").withColumn("unknown", F.coalesce("odd", F.lit(False)))
    if capitalization:
        h = h.withColumn("target", T.title_case(F.col("text")) if capitalization == "title" else T.sentence_case(F.col("text")))
    text, s, e = F.col("text"), F.col("start_offset"), F.col("end_offset")
    asks = text.rlike(r"\?\s*$") & ~F.col("in_faq")
    faq_like = any_of(text, [rf"^\s*({'|'.join(L.QUESTION_STARTERS)})\b"]) & ~text.rlike(r"(?i)^\s*how\s+to\b")
    generic = (F.size(T.tokens(text)) == 1) & F.regexp_replace(F.lower(text), r"[^\w]", "").isin(L.GENERIC_HEADINGS)
    levels = F.concat(F.lit("skips "), F.array_join(F.transform(F.sequence(F.col("prev_level") + 1, F.greatest(F.col("level") - 1, F.col("prev_level") + 1)), lambda x: F.concat(F.lit("H"), x)), ", "))
    none = F.lit(None)
    rules = [
        (F.coalesce(F.col("start_offset") - F.col("prev_end") <= 1, F.lit(False)), "blank_line", "structure", "suggestion", 0.95, s, e, text, none, "no blank line before the heading", False),
        (asks, "question_mark", "structure", "warning", F.when(faq_like, 0.6).otherwise(0.9), s, e, text, F.regexp_replace(text, r"\?+\s*$", ""), "question mark in a heading", ~faq_like),
        (generic, "descriptive", "style", "suggestion", 0.6, s, e, text, none, "the heading says too little", False),
        (F.coalesce(F.col("level") > F.col("prev_level") + 1, F.lit(False)), "skipped_level", "structure", "warning", 0.8, s, e, text, none, levels, False),
        ((F.col("h1") > 1) & (F.col("h1_no") == 1) & (F.col("level") == 1), "multiple_h1", "structure", "warning", 0.8, s, e, text, none, F.concat(F.col("h1"), F.lit(" headings of level 1")), False),
    ]
    if capitalization:
        unsure = special_words(text, known) | F.col("unknown") | text.contains("?")
        rules.append((F.col("target") != text, "capitalization", "style", "warning", F.when(unsure, 0.5).otherwise(0.85), s, e, text, F.col("target"), f"{capitalization} case", ~unsure))
    return make_each(h, "headings", rules)


# --- currency ---

# a sign behind another one ("$$$ 170.116.163.254") belongs to a row of signs and names no amount
COMBINED = rf"(?=[NCAR€£¥₹₿$])(?<![A-Za-z€£¥₹₿$])({L.SYMBOLS})\s*({L.AMOUNT})\s+({L.CODES})(?![A-Za-z])"
SYMBOL = rf"(?=[NCAR€£¥₹₿$])(?<![A-Za-z€£¥₹₿$])({L.SYMBOLS})\s*({L.AMOUNT})(?![%\d])"
CODE = rf"(?=\d)(?<![€£¥₹₿$\d])({L.AMOUNT})\s+({L.CODES})(?![A-Za-z])"


def currency_occurrences(el: DataFrame) -> DataFrame:
    """(…, style, s, e, m, symbol, amount, code): combined forms first, then symbols, then codes that overlap none of those."""
    kinds = (("combined", COMBINED), ("symbol", SYMBOL), ("code", CODE))

    def tag(kind: str, pattern: str) -> Column:
        found = T.match_spans(F.col("text"), pattern, True)
        if kind != "code":
            found = F.when(F.col("text").rlike("[€£¥₹₿$]"), found).otherwise(F.array().cast(f"array<{T.SPAN}>"))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("style"), x["start"].alias("s"), x["end"].alias("e"), x["text"].alias("m")))

    tagged = [tag(*k) for k in kinds]

    def free(own: Column, *earlier: Column) -> Column:
        return F.filter(own, lambda x: ~F.exists(F.flatten(F.array(*earlier)), lambda y: (x["s"] < y["e"]) & (x["e"] > y["s"])))

    # amounts need a digit
    rows = of_type(el, "paragraph", "table_cell").where(F.col("text").rlike(r"\d"))
    symbols = lambda c: T.let(free(tagged[1], c), lambda s: F.concat(c, s, free(tagged[2], c, s)))
    rows = rows.select("*", F.explode(T.let(tagged[0], symbols)).alias("x")).select("*", "x.*").drop("x")
    symbol = F.when(F.col("style") != "code", F.upper(F.regexp_extract("m", rf"(?i)^({L.SYMBOLS})", 1)))
    code = F.when(F.col("style") != "symbol", F.upper(F.regexp_extract("m", rf"(?i)({L.CODES})$", 1)))
    return rows.withColumn("symbol", symbol).withColumn("code", code).withColumn("amount", F.trim(F.regexp_replace("m", rf"(?i)^(?:{L.SYMBOLS})|(?:{L.CODES})$", "")))


def dominance() -> tuple[Column, Column]:
    """The style in the lead and whether it is sure, at over 70 %; a tie is symbol, not sure; none is null, not sure."""
    top, total = F.greatest("symbols", "codes"), F.col("symbols") + F.col("codes")
    lead = F.when(total == 0, None).when(F.col("symbols") >= F.col("codes"), "symbol").otherwise("code")
    return lead, (total > 0) & (top / F.greatest(total, F.lit(1)) > 0.7)


def convention() -> Column:
    return F.when(F.col("style") == "symbol", F.concat(F.lit("symbol:"), "symbol")).when(F.col("style") == "code", F.concat(F.lit("code:"), "code"))


def currency_dominance(found: DataFrame) -> DataFrame:
    """(doc_id, symbols, codes, dominant, sure)."""
    n = found.groupBy("doc_id").agg(F.count_if(F.col("style") == "symbol").alias("symbols"), F.count_if(F.col("style") == "code").alias("codes"))
    lead, sure = dominance()
    return n.withColumn("dominant", lead).withColumn("sure", sure)


def currency_conventions(found: DataFrame) -> DataFrame:
    """(doc_id, prose, tables): the sets of conventions such as symbol:$ and code:USD in paragraphs and in tables."""
    of = lambda table: F.array_sort(F.collect_set(F.when((F.col("elem_type") == "table_cell") == table, convention())))
    return found.groupBy("doc_id").agg(of(False).alias("prose"), of(True).alias("tables"))


@check("currency")
def currency(el: DataFrame, mode: str = "exclusive") -> DataFrame:
    """One scan finds the occurrences; what their documents use is counted in windows over them."""
    found = currency_occurrences(el.where(F.lit(mode == "exclusive")))
    w = Window.partitionBy("doc_id")
    name, table = convention(), F.col("elem_type") == "table_cell"
    rows = found.withColumn("symbols", F.count_if(F.col("style") == "symbol").over(w)).withColumn("codes", F.count_if(F.col("style") == "code").over(w))
    rows = rows.withColumn("prose", F.array_sort(F.collect_set(F.when(~table, name)).over(w))).withColumn("tables", F.array_sort(F.collect_set(F.when(table, name)).over(w)))
    dominant, sure = dominance()
    rows = rows.withColumn("dominant", dominant).withColumn("sure", sure)
    pairs = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    drop = F.when(F.col("dominant") == "code", F.concat("amount", F.lit(" "), "code")).otherwise(F.concat("symbol", "amount"))
    fix = F.when(F.col("style") == "symbol", F.concat("amount", F.lit(" "), F.element_at(pairs(L.SYMBOL_CODE), F.col("symbol")))).otherwise(F.concat(F.element_at(pairs(L.CODE_SYMBOL), F.col("code")), "amount"))
    unsure = ~F.col("sure") | (F.size(F.array_union("prose", "tables")) >= 3) | ((F.size("prose") > 0) & (F.size("tables") > 0) & (F.col("prose") != F.col("tables")))
    both = F.col("style") == "combined"
    minor = ~both & (F.col("style") != F.col("dominant")) & (F.col("symbols") > 0) & (F.col("codes") > 0) & fix.isNotNull()
    return make_each(rows, "currency", [
        (both, "combined", "currency", "warning", 0.95, at("s"), at("e"), F.col("m"), drop, "symbol and code together", F.col("dominant").isNotNull()),
        (F.coalesce(minor, F.lit(False)), "consistency", "currency", "warning", F.when(unsure, 0.5).otherwise(0.85), at("s"), at("e"), F.col("m"), fix, "style differs from the document's", ~unsure),
    ])


# --- formatting ---


def missing_space_kind(text: Column, p: Column) -> Column:
    """What a comma or full stop at p before a letter is: skip, unsure or fix. Only what is near p is looked at."""
    near = lambda a, n: F.lower(F.substring(text, F.greatest(p + a, F.lit(0)) + 1, F.least(p, F.lit(-a)) + n))
    behind = F.regexp_extract(F.lower(F.substring(text, p + 2, F.lit(200))), r"^\S+", 0)
    domain = behind.rlike("^(" + "|".join(L.DOMAINS) + ")") | behind.isin(L.FILE_TYPES)
    short = near(-4, 3).rlike("|".join(re.escape(a) for a in L.SHORT_FORMS))
    dot = F.substring(text, p + 1, F.lit(1)) == "."
    return (
        F.when(dot & (near(-1, 0).rlike(r"\d") | domain), "skip")
        .when(short | near(-20, 0).rlike(r"http|www\."), "skip")
        .when(near(-30, 30).contains("@"), "unsure")
        .otherwise("fix")
    )


FORMAT_RULES = (("double_space", r"  +"), ("space_before_punct", r" +[,;:!?]|(?<!\.) +\.(?!\.)"), ("missing_space", r"[,.][A-Za-z]"), ("latin", r"(?i)(?=[eivc][.tif])\b(?:e\.g\.|i\.e\.|etc\.|viz\.|cf\.)"), ("trailing_space", r"[ \t]+$"))


@check("formatting")
def formatting(el: DataFrame) -> DataFrame:
    """All rules in one scan: the matches of each, as arrays, become one."""

    def hits(kind: str, pattern: str) -> Column:
        return F.transform(T.match_spans(F.col("text"), pattern), lambda x: F.struct(F.lit(kind).alias("rule"), x["start"].alias("s"), x["end"].alias("e"), x["text"].alias("m")))

    rows = el.select("*", F.explode(F.flatten(F.array(*(hits(*r) for r in FORMAT_RULES)))).alias("x")).select("*", "x.*").drop("x")
    prose = F.col("elem_type").isin("paragraph", "heading")
    rows = rows.where(((F.col("rule") != "latin") | prose) & ~((F.col("rule") == "space_before_punct") & F.col("m").contains("..")))
    missing = F.col("rule") == "missing_space"
    # computed once, by a generator: it is asked for in several of the columns below
    kind = F.when(missing, missing_space_kind(F.col("text"), F.col("s"))).otherwise("fix")
    rows = rows.select("*", F.explode(F.array(kind)).alias("kind")).where("kind <> 'skip'")
    word = F.element_at(F.create_map(*(F.lit(x) for kv in L.LATIN.items() for x in kv)), F.lower("m"))
    rule = F.col("rule")
    fix = (
        F.when(rule == "double_space", " ").when(rule == "space_before_punct", F.ltrim("m")).when(rule == "latin", word).when(rule == "trailing_space", "")
        .otherwise(F.concat(F.substring("m", 1, 1), F.lit(" "), F.substring("m", 2, 1)))
    )
    sure = F.when(rule == "latin", 0.85).when(F.col("kind") == "unsure", 0.6).when(missing, 0.9).otherwise(0.95)
    return make(rows, "formatting", rule, F.when(rule == "latin", "style").otherwise("formatting"), "suggestion", sure, at("s"), at("e"), F.col("m"), fix, F.regexp_replace(rule, "_", " "), (rule != "latin") & (F.col("kind") == "fix"))


def ui_quoting(el: DataFrame) -> DataFrame:
    """Names of controls after verbs such as tap, without quotes; not part of the default run."""
    rows = spans(of_type(el, "paragraph"), r"\b(?:[Tt]ap|[Cc]lick|[Pp]ress|[Ss]elect|[Cc]hoose|[Hh]it|[Oo]pen)\s+(?!['\"])[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b")
    name = F.regexp_extract("m", r"^\S+\s+(.*)$", 1)
    return make(rows, "formatting", "ui_quoting", "style", "suggestion", 0.55, at("e") - F.length(name), at("e"), name, F.concat(F.lit("'"), name, F.lit("'")), "control without quotes", False)


# --- regional spelling ---


@check("locale_spelling")
def locale_spelling(el: DataFrame, region: str = "british", swaps: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Words of another region's spelling. swaps: (region, wrong, right), a word list; only its words are looked for."""
    right = {w: r for k, w, r in (L.swaps() if swaps is None else swaps) if k == region}
    doubt = {a: b for b, a in L.AMBIGUOUS.items() if a not in right} if region in ("british", "australian", "new_zealand") else {}
    rows = [(w, r, w in right) for w, r in (right | doubt).items()]
    words = phrases.lexicon(el.sparkSession, rows, "term string, right string, sure boolean")
    hits = phrases.hits(el, words, spans=phrases.excluded(F.col("text"))).withColumn("wrong", F.lower("m"))
    sub = F.when(F.col("sure"), spelling_kind(F.col("wrong"), F.col("right"))).otherwise("context")
    return make(
        hits, "locale_spelling", sub, "spelling", F.when(F.col("sure"), "warning").otherwise("suggestion"), F.when(F.col("sure"), 0.95).otherwise(0.7), at("s"), at("e"), F.col("m"),
        T.preserve_case(F.col("m"), F.col("right")), F.when(F.col("sure"), f"{region} spelling").otherwise("depends on the meaning"), F.col("sure"),
    )


def spelling_kind(wrong: Column, right: Column) -> Column:
    either = lambda p: wrong.rlike(p) | right.rlike(p)
    return (
        F.when(either("i[sz](e|ation)$|yze$"), "ise_ize").when(either("our"), "our_or").when(either("re$"), "re_er").when(either("ll"), "lled_led").when(either("ogue$"), "ogue_og").otherwise("other")
    )


# --- brands ---


def brand_mentions(el: DataFrame, brands: list[tuple[str, str, bool]]) -> DataFrame:
    """(…, name, s, e, m, before) of each brand outside quotes, addresses and URLs, with the 15 characters before it.

    brands: (name, form, loose); a loose form's parts may have any white space and hyphens between them.
    """
    made = el.sparkSession.createDataFrame(brands, "name string, form string, loose boolean")
    return phrases.hits(el, phrases.terms(made, "form", F.col("loose")), 15, phrases.excluded(F.col("text"))).drop("form")


def norm_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[ -]", "")


def same_brand(name: Column, brand: str | None) -> Column:
    return norm_key(name) == (brand or "").lower().replace(" ", "").replace("-", "")


def with_dominant(mentions: DataFrame, own: str | None = None, least: int = 5) -> DataFrame:
    """Adds dominant (name, n, second) to each mention: its document's leading operator, if it isn't own and leads clearly.

    Clearly: least mentions, and twice the next one's or ten more. Of operators with as many mentions the first one leads.
    """
    by_name, by_doc = Window.partitionBy("doc_id", "name"), Window.partitionBy("doc_id")
    one = F.struct((-F.count("*").over(by_name)).alias("less"), F.min(at("s")).over(by_name).alias("first"), F.col("name"))
    rows = mentions.withColumn("one", F.when(F.col("name").isNotNull(), one)).withColumn("all", F.array_sort(F.collect_set("one").over(by_doc)))
    top, second = F.get("all", 0), F.coalesce(-F.get("all", 1)["less"], F.lit(0))
    n = -top["less"]
    clear = (n >= least) & ((n >= 2 * second) | (n - second >= 10)) & ~same_brand(top["name"], own)
    return rows.withColumn("dominant", F.when(clear, F.struct(top["name"].alias("name"), n.alias("n"), second.alias("second")))).drop("one", "all")


def dominant_operator(el: DataFrame, operators: list[str], own: str | None = None, least: int = 5) -> DataFrame:
    """(doc_id, name, n, second) of the documents with a dominant operator."""
    found = with_dominant(brand_mentions(el, [(o, o, False) for o in operators]), own, least)
    return found.where("dominant IS NOT NULL").select("doc_id", "dominant.*").distinct()


def canonical_forms(el: DataFrame, canonical: str) -> DataFrame:
    """(form, n): how a brand is written in the corpus, by count."""
    forms = phrases.lexicon(el.sparkSession, [(f,) for f in phrases.join_forms(split_brand(canonical))], "term string", loose=True)
    return phrases.hits(el, forms).groupBy(F.col("m").alias("form")).agg(F.count("*").alias("n"))


@check("brand_names")
def brand_names(el: DataFrame, canonical: str, operators: list[str], mapping: dict[str, str] | None = None, dominance: float = 1.0, threshold: float = 0.85) -> DataFrame:
    """Own and other brands, found in one scan of the leaves."""
    names = [("", form, True) for form in phrases.join_forms(split_brand(canonical))]
    every = brand_mentions(el, names + [(o, o, False) for o in operators])
    right = F.lit(canonical)
    if mapping:
        right = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), F.col("m")), right)
    other = F.col("name") != ""
    # the own brand's form takes no part in the operators' count
    rows = with_dominant(every.withColumn("rival", F.when(other, F.col("name"))).withColumn("name", F.col("rival")), canonical) if operators else every.withColumn("rival", F.lit(None).cast("string"))
    before = F.lower("before")
    common = F.lower("m").isin(L.AMBIGUOUS_OPERATORS) & (~F.col("m").rlike("^[A-Z]") | before.rlike("(" + "|".join(L.COMMON_PREFIXES) + ")$"))
    own = F.col("rival").isNull() & (F.col("m") != canonical) & (F.col("m") != right)
    rules = [(own, "own_brand", "brand", "warning", 0.95, at("s"), at("e"), F.col("m"), right, "the brand's own form", dominance >= threshold)]
    if operators:
        rival = F.col("rival").isNotNull() & ~same_brand(F.col("rival"), canonical) & ~common & ~F.coalesce(F.col("dominant.name") == F.col("rival"), F.lit(False))
        rules.append((rival, "competitor", "brand", "warning", 0.8, at("s"), at("e"), F.col("m"), F.lit(None), F.concat(F.lit("another operator: "), F.coalesce("rival", F.lit(""))), False))
    return make_each(rows, "brand_names", rules)


# --- numeric consistency ---


#: What stands within the reach of a place where a whole claim begins: a look-ahead for searches by the claim's own pattern.
AHEAD = {"BONUS_AMOUNT": r"(?=[^$]{0,40}\$)", "BONUS_PERCENT": r"(?=\D{0,40}\d)", "WAGERING": r"(?=\D{0,40}\d)", "GAME_COUNT": r"(?=[^\d,]{0,40}[\d,])"}


def claims(el: DataFrame) -> DataFrame:
    """(doc_id, idx, category, kind, value, number, context, offset) of the numeric claims of paragraphs, in one scan.

    Patterns look for the value with what follows it. The text in front, whose reach the claim's pattern begins with, is taken
    from the gap: it begins behind the claim before, behind the last line end, or as far back as it reaches.
    """

    def of(category: str, p: str) -> Column:
        reach = re.match(r"\.\{0,(\d+)\}\?", p)
        rest = p[reach.end() :]
        front = lambda x: F.regexp_replace(x["before"], r"(?s)^.*[\n\r\u0085\u2028\u2029]", "")
        claim = lambda x, f: F.struct(
            F.lit(category).alias("category"), (x["start"] - F.length(f)).alias("s"), F.concat(f, x["text"]).alias("m"),
            F.regexp_extract(x["text"], "(?i)" + rest, 1).alias("value"), F.lower(F.concat(f, x["text"])).alias("low"),
        )
        found = T.match_spans(F.col("text"), rest, True, before=int(reach[1]))
        return F.transform(found, lambda x: T.let(front(x), lambda f: claim(x, f)))

    rows = of_type(el, "paragraph").where(F.col("text").rlike(r"\d"))
    rows = rows.select("doc_id", "idx", "start_offset", F.explode(F.flatten(F.array(*(of(*c) for c in L.CLAIM_PATTERNS.items())))).alias("c")).select("doc_id", "idx", "start_offset", "c.*")
    number = F.regexp_replace(F.regexp_replace("value", r"[$,\s]", ""), r"(?i)[x%+]$", "")
    rows = rows.withColumn("number", F.coalesce(number.try_cast("double"), F.lit(0.0)))
    rows = rows.where("NOT (category = 'GAME_COUNT' AND number < 10) AND NOT (category = 'BONUS_AMOUNT' AND number < 5)")
    kind = None
    for name, words in L.CLAIM_KINDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains("low", F.lit(w))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return rows.select("doc_id", "idx", "category", kind.otherwise("generic").alias("kind"), "value", "number", F.trim("m").alias("context"), at("s").alias("offset"))


def claim_classes(found: DataFrame, carry: tuple[str, ...] = ("value", "idx", "context")) -> DataFrame:
    """(doc_id, category, kind, number, n, first, links, lead): the values that claims of one kind in a document give.

    n claims give the value, the first of them at first; links of them with claims that give another one. lead is the value
    most claims give, the earliest of equals. Only kinds with more than one value have rows: one a value, however many pairs.
    carry: what first has beside its offset; without any the claims are counted by hash, not sorted.
    """
    whole = Window.partitionBy("doc_id", "category", "kind")
    one = (F.min(F.struct("offset", *carry)) if carry else F.struct(F.min("offset").alias("offset"))).alias("first")
    rows = found.groupBy("doc_id", "category", "kind", "number").agg(F.count("*").alias("n"), one)
    lead = F.min(F.struct((-F.col("n")).alias("less"), F.col("first.offset").alias("offset"), "number", "first")).over(whole)
    rows = rows.withColumn("links", F.col("n") * (F.sum("n").over(whole) - F.col("n"))).withColumn("lead", lead)
    return rows.where("links > 0").withColumn("lead", F.struct(F.col("lead.number").alias("number"), F.col("lead.first").alias("first")))


def claim_conflicts(found: DataFrame) -> DataFrame:
    """Pairs of claims of one kind in a document that give different values: each value's first claim with that of the lead.

    The earlier claim of a pair comes first. links: how many claims of the document the value's claims disagree with.
    """
    rows = claim_classes(found).where("number <> lead.number")
    mine, other = F.struct(F.col("first"), F.col("number")), F.struct(F.col("lead.first").alias("first"), F.col("lead.number").alias("number"))
    early = F.struct(F.col("first.offset"), F.col("first.value")) < F.struct(F.col("lead.first.offset"), F.col("lead.first.value"))
    rows = rows.withColumn("a", F.when(early, mine).otherwise(other)).withColumn("b", F.when(early, other).otherwise(mine))
    sides = [(F.col(f"{side}.number") if c == "number" else F.col(f"{side}.first.{c}")).alias(c + end) for side, end in (("a", ""), ("b", "_b")) for c in ("idx", "value", "number", "context", "offset")]
    rows = rows.select("doc_id", "category", "kind", "links", *sides)
    return rows.withColumn("pair", F.row_number().over(Window.partitionBy("doc_id").orderBy("category", "kind", "offset", "offset_b", "value", "value_b")).cast("long"))


def judge(pairs: DataFrame, ask: Callable[[str], str | None] | None = None) -> DataFrame:
    """Adds a verdict to each pair: CONFLICT, DIFFERENT or UNCLEAR. ask answers one prompt per document with pairs.

    Without ask, or where it fails, there is no verdict. Only documents with pairs are asked about.
    """
    line = F.concat(F.lit("PAIR "), "pair", F.lit(": "), "context", F.lit(" // "), "context_b")
    prompts = pairs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair", line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))

    def run(it):
        for pdf in it:
            answers = []
            for p in pdf["prompt"]:
                try:
                    answers.append(ask(p) if ask else None)
                except Exception:  # a failed call is no verdict
                    answers.append(None)
            yield pdf.assign(answer=answers)[["doc_id", "answer"]]

    kind = prompts.schema["doc_id"].dataType.simpleString()
    answered = prompts.mapInPandas(run, f"doc_id {kind}, answer string") if ask else prompts.select("doc_id", F.lit(None).cast("string").alias("answer"))
    line = F.concat(F.lit(r"(?i)PAIR\s+"), F.col("pair").cast("string"), F.lit(r"\s*:\s*(CONFLICT|DIFFERENT|UNCLEAR)"))
    verdict = F.upper(F.call_function("regexp_extract", F.col("answer"), line, F.lit(1)))
    return pairs.join(answered, "doc_id", "left").withColumn("verdict", F.when(F.col("answer").isNotNull(), F.when(verdict == "", "UNCLEAR").otherwise(verdict))).drop("answer")


@check("consistency")
def consistency(el: DataFrame, ask: Callable[[str], str | None] | None = None) -> DataFrame:
    bad = judge(claim_conflicts(claims(el)), ask).where("verdict = 'CONFLICT'")
    return make(bad, "consistency", F.col("category"), "consistency", "warning", 0.85, F.col("offset"), F.col("offset") + F.length("context"), F.col("context"), None, F.concat(F.lit("elsewhere: "), "value_b"), False)
