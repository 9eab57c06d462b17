"""Column expressions over text: match spans, words, sentences, case, keywords, quantities."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def lit_regex(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + pattern


def either(words: Iterable[str]) -> str:
    """A pattern of any of the words, the longest first, that looks at the letters they share once."""
    tails: dict[str, set[str]] = {}
    for w in words:
        tails.setdefault(w[:1], set()).add(w[1:])
    parts = [re.escape(c) + either(rest) for c, rest in sorted(tails.items()) if c]
    if "" in tails:
        return f"(?:{'|'.join(parts)}|)" if parts else ""
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def running(lengths: Column, base: Column) -> Column:
    """base plus the sum of the lengths before each one. The state is copied at each step: for short arrays."""
    zero = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(lengths, zero, step, lambda a: a["out"])


def starts(lengths: Column) -> Column:
    """Where each of several parts begins, from their lengths (integers). Long arrays are summed in blocks of the root of their size."""

    def blocked(all_: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda k: F.slice(all_, k * size + 1, size))
        total = lambda block: F.aggregate(block, F.lit(0), lambda x, n: x + n)
        return let(cut, lambda blocks: F.flatten(F.zip_with(blocks, running(F.transform(blocks, total), F.lit(0)), running)))

    return let(lengths, lambda x: F.when(F.size(x) <= 64, running(x, F.lit(0))).otherwise(blocked(x)))


SPAN = "struct<start:int,end:int,text:string>"
#: A span with what stands in front of it.
PLACED = "struct<start:int,end:int,text:string,before:string>"


def located(gaps: Column, hits: Column, before: int = 0) -> Column:
    """Spans of hits, from the gaps before each of them: gaps and hits walk the text together."""
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    at = lambda ps: starts(F.transform(ps, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
    begin = lambda x, s: s + F.length(x["gap"])
    front = lambda x: [F.substring(x["gap"], -before, before).alias("before")] if before else []
    span = lambda x, s: F.struct(begin(x, s).alias("start"), (begin(x, s) + F.length(x["hit"])).alias("end"), x["hit"].alias("text"), *front(x))
    return let(pairs, lambda ps: F.zip_with(ps, at(ps), span))


#: Marks put around matches; texts that hold them are walked by their gaps instead.
OPEN, CLOSE = "\ue000", "\ue001"


def match_spans(text: Column, pattern: str, ignore_case: bool = False, before: int = 0) -> Column:
    """array<struct<start, end, text>> of the matches, in order. The pattern must not match the empty string.

    One pass of the pattern puts marks around its matches; the pieces between the marks give the offsets without Python.
    Texts without a match are only searched, not copied and cut. With before, a span also has before: up to so many characters
    of what stands between it and the match in front of it.
    """
    p = lit_regex(pattern, ignore_case)
    nothing = F.array().cast(f"array<{PLACED if before else SPAN}>")

    def marked(pieces: Column) -> Column:
        hit = lambda x: F.substring_index(x, CLOSE, 1)
        span = lambda x, at: let(hit(x), lambda h: F.struct(at.alias("start"), (at + F.length(h)).alias("end"), h.alias("text")))
        at = starts(F.transform(pieces, lambda x, i: F.length(x) - F.when(i > 0, 1).otherwise(0)))
        found = F.slice(F.zip_with(pieces, at, span), 2, F.size(pieces) - 1)
        if before:
            # a piece's gap, behind its mark, stands before the next piece's match
            gaps = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.substring(F.substring_index(x, CLOSE, -1), -before, before))
            found = F.zip_with(found, gaps, lambda x, gap: x.withField("before", gap))
        return F.when(F.size(pieces) > 1, found).otherwise(nothing)

    plain = let(F.split(F.regexp_replace(text, p, f"{OPEN}$0{CLOSE}"), OPEN, -1), marked)
    walked = located(F.split(text, p, -1), F.regexp_extract_all(text, F.lit(p), F.lit(0)), before)
    return F.when(~text.rlike(p), nothing).when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), walked).otherwise(plain)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def space_words(text: Column) -> Column:
    return F.size(tokens(text))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


def sentences(text: Column) -> Column:
    """Parts between sentence ends and capitals; blank parts go."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s) != "")


def prose_sentences(text: Column) -> Column:
    """Sentences of the style profile: abbreviations and decimals don't end one; parts of one character go.

    Protected abbreviations come out in lower case.
    """
    mark = "\u0001"
    out = text

    def protect(text: Column, a: str) -> Column:
        found = lambda x: F.regexp_replace(x, r"(?i)\b" + a.replace(".", r"\.") + r"\.", a + mark)
        return let(text, lambda x: F.when(F.contains(F.lower(x), F.lit(a + ".")), found(x)).otherwise(x))

    # one search tells the texts that hold no abbreviation; in the others each is looked for only where it stands
    for a in L.ABBREVIATIONS:
        out = protect(out, a)
    out = let(text, lambda x: F.when(x.rlike(r"(?i)\b" + either(L.ABBREVIATIONS) + r"\."), out).otherwise(x))
    out = F.regexp_replace(out, r"(\d)\.(\d)", "$1" + mark + "$2")
    out = F.regexp_replace(out, r"([.!?]+)\s+(?=[A-Z])", "$1\u0002")
    parts = F.transform(F.split(out, "\u0002"), lambda s: F.trim(F.replace(s, F.lit(mark), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s) > 1)


def capital(word: Column) -> Column:
    """First character upper, the others lower."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def letters_of(word: Column) -> Column:
    return F.regexp_replace(word, "[^A-Za-z]", "")


def is_acronym(word: Column) -> Column:
    return F.lower(letters_of(word)).isin([a.lower() for a in L.ACRONYMS])


def acronym(word: Column) -> Column:
    """The word with its letters in the acronym's own case, where they are found in lower case."""
    out = word
    for a in L.ACRONYMS:
        out = F.when(F.lower(letters_of(word)) == a.lower(), F.replace(word, F.lit(a.lower()), F.lit(a))).otherwise(out)
    return out


def title_case(text: Column) -> Column:
    words = F.split(text, " ")
    last = F.size(words) - 1

    def one(w: Column, i: Column) -> Column:
        edge = (i == 0) | (i == last)
        return F.when(is_acronym(w), acronym(w)).when(~edge & F.lower(w).isin(L.MINOR_WORDS), F.lower(w)).otherwise(capital(w))

    return F.array_join(F.transform(words, one), " ")


def mixed_case(word: Column) -> Column:
    return word.rlike("^[A-Za-z]") & F.substring(word, F.lit(2), F.length(word)).rlike("[A-Z]") & word.rlike("[a-z]")


def sentence_case(text: Column) -> Column:
    words = F.split(text, " ")

    def one(w: Column, i: Column) -> Column:
        upper = (F.length(letters_of(w)) >= 2) & (F.upper(letters_of(w)) == letters_of(w))
        return F.when(is_acronym(w), acronym(w)).when(upper | mixed_case(w), w).when(i == 0, capital(w)).otherwise(F.lower(w))

    return F.array_join(F.transform(words, one), " ")


def preserve_case(source: Column, target: Column) -> Column:
    """target in the case of source: all upper, title, first upper, else lower."""
    first = F.substring(source, 1, 1)
    return (
        F.when((F.upper(source) == source) & (F.lower(source) != source), F.upper(target))
        .when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, F.lit(2), F.length(target))))
        .otherwise(F.lower(target))
    )


def normal_heading(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""))


def fuzzy_heading(required: Column, actual: Column, share: float = 0.5) -> Column:
    """Whether a heading covers a required section: it contains it, or half of its distinct words."""
    r, a = normal_heading(required), normal_heading(actual)
    words = F.array_distinct(tokens(r))
    return (r != "") & (F.contains(a, r) | ((F.size(words) > 0) & (F.size(F.array_intersect(words, tokens(a))) >= share * F.size(words))))


def normal_keyword(text: Column) -> Column:
    return F.array_join(tokens(F.lower(text)), " ")


def keyword_variants(text: Column) -> Column:
    """The keyword and the plural and singular forms of its last word; the order is fixed."""
    k = normal_keyword(text)
    last = F.element_at(F.split(k, " "), -1)
    cut = lambda n: F.substring(k, F.lit(1), F.length(k) - n)
    ends = lambda *xs: last.rlike("(" + "|".join(xs) + ")$")
    n = F.length(last)
    forms = [
        k,
        F.when(ends("ies") & (n > 3), F.concat(cut(3), F.lit("y"))),
        F.when(ends("ses", "xes") & (n > 3), cut(2)),
        F.when(ends("ches", "shes") & (n > 4), cut(2)),
        F.when(ends("s") & ~ends("ss", "us", "is", "es") & (n > 2), cut(1)),
        F.when(~ends("s"), F.concat(k, F.lit("s"))),
        F.when(ends("s", "x", "ch", "sh") & ~ends("es"), F.concat(k, F.lit("es"))),
        F.when(ends("y") & (n > 1) & ~last.rlike("[aeiou]y$"), F.concat(cut(1), F.lit("ies"))),
    ]
    return F.when(k == "", F.array(k)).otherwise(F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull())))


def quantity_range(value: Column) -> Column:
    """struct<low, high> of a quantity such as '1-3', 'Min 2', '3x', 'Exact 1', 'Any'."""
    t = F.lower(F.trim(value))
    num = lambda p, g=1: F.regexp_extract(t, p, g).cast("int")
    pair = lambda a, b: F.struct(a.cast("int").alias("low"), b.cast("int").alias("high"))
    none = F.lit(None)
    out = F.when(t.isNull() | t.isin("", "any"), pair(none, none))
    for p in (r"^exact\s+(\d+)$",):
        out = out.when(t.rlike(p), pair(num(p), num(p)))
    span = r"^(\d+)\s*[-–]\s*(\d+)$"
    out = out.when(t.rlike(span), pair(num(span), num(span, 2)))
    out = out.when(t.rlike(r"^min\s+(\d+)$"), pair(num(r"^min\s+(\d+)$"), none)).when(t.rlike(r"^max\s+(\d+)$"), pair(none, num(r"^max\s+(\d+)$")))
    return out.when(t.rlike(r"\d"), pair(num(r"(\d+)"), num(r"(\d+)"))).otherwise(pair(none, none))


def clean_keyword(text: Column) -> Column:
    """Without a parenthesis at either end and with single spaces."""
    out = F.regexp_replace(text, r"^\s*\([^)]+\)\s*", "")
    return F.array_join(tokens(F.regexp_replace(out, r"\s*\([^)]+\)\s*$", "")), " ")


def article_type(name: Column, brand: Column | None = None) -> Column:
    """The type that a file name suggests; the first list with a hit counts."""
    n = F.lower(F.translate(name, "-_", "  "))
    if brand is not None:
        n = F.when(F.coalesce(brand, F.lit("")) != "", F.replace(n, F.lower(brand), F.lit(""))).otherwise(n)
    out = None
    for kind, words in L.TYPE_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(n, F.lit(w))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("general")


def task_type(name: Column) -> Column:
    """struct<type, confidence> of a task name: 0.95 if the pattern is at its start, 0.75 elsewhere, 0.5 if none, 0.3 if empty."""
    t = F.lower(F.trim(name))
    result = lambda k, c: F.struct(F.lit(k).alias("type"), F.lit(c).alias("confidence"))
    out = F.when(F.coalesce(name, F.lit("")) == "", result("general", 0.3))
    for kind, patterns in L.TASK_PATTERNS.items():
        for p in patterns:
            out = out.when(t.rlike("^(?:" + p + ")"), result(kind, 0.95))
            if p not in L.WHOLE_NAME:
                out = out.when(t.rlike(p), result(kind, 0.75))
    return out.otherwise(result("general", 0.5))


def is_metadata_label(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    hit = (t == "") | t.isin(L.METADATA_LABELS)
    for p in L.METADATA_PATTERNS:
        hit = hit | t.rlike("(?i)" + p)
    return hit


def formatting_hint(text: Column) -> Column:
    """'none' or 'required' for blank rows, else null; 'none' wins."""
    any_of = lambda ps: F.lower(text).rlike("|".join(f"(?:{p})" for p in ps))
    return F.when(any_of(L.BLANK_ROWS_NONE), "none").when(any_of(L.BLANK_ROWS_REQUIRED), "required")
