"""A lexicon against text: leaves are cut into tokens once, and terms meet them in an equi-join on their first token.

A term is a sequence of tokens (letters, digits, underscores; case doesn't count) with the text between them. The cost of a
scan doesn't depend on the number of terms: every token is looked up once by hash, and only where the first token of a term
stands the tokens behind it are compared with the rest of the term.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T

LETTERS, ASCII = r"\p{L}\p{N}_", r"\w"
#: A lexicon with no more terms than these is looked up inside the leaves, then broadcast; a larger one is joined by hash.
SMALL = 20_000
#: A lexicon whose terms begin with no more different tokens than these is found by one pattern of them; leaves aren't cut.
FEW = 200
#: No more terms than these are put into one pattern as a whole, each with so many characters at most.
WHOLE, LONG = 2_000, 64


def cut(text: Column, letters: str = LETTERS) -> Column:
    """array<struct<raw, before, gap, s>>: the tokens of a text with the text on either side, up to the next token."""
    token = f"[{letters}]+"

    def both(gaps: Column, raws: Column) -> Column:
        n = F.size(raws)
        ahead = F.slice(gaps, 1, n)
        at = T.starts(F.zip_with(ahead, raws, lambda g, r: F.length(g) + F.length(r)))
        zipped = F.arrays_zip(raws.alias("raw"), ahead.alias("before"), F.slice(gaps, 2, n).alias("gap"), at.alias("at"))
        return F.transform(zipped, lambda x: F.struct(x["raw"], x["before"], x["gap"], (x["at"] + F.length(x["before"])).alias("s")))

    return T.let(F.split(text, token, -1), lambda gaps: T.let(F.regexp_extract_all(text, F.lit(token), F.lit(0)), lambda raws: both(gaps, raws)))


def terms(df: DataFrame, term: str = "term", loose: Column | None = None) -> DataFrame:
    """A lexicon: the columns of df with first (a token), rest (gap and token, one after the other), head and tail.

    Gaps are the term's own text, or, where loose holds, any white space and hyphens. head and tail are what the term has
    before its first and after its last token. Terms without a token are left out.
    """
    rows = df.withColumn("t", cut(F.col(term))).where("size(t) > 0")
    rest = F.transform(F.slice("t", 2, F.size("t")), lambda x: F.struct(x["before"].alias("gap"), F.lower(x["raw"]).alias("word")))
    head, tail = F.get("t", 0)["before"], F.element_at("t", -1)["gap"]
    rows = rows.withColumn("first", F.lower(F.get("t", 0)["raw"])).withColumn("rest", rest).withColumn("head", head).withColumn("tail", tail)
    return rows.withColumn("loose", F.lit(False) if loose is None else loose).drop("t")


def lexicon(spark: SparkSession, rows: Iterable[tuple], schema: str, loose: bool = False) -> DataFrame:
    """terms() of a list of rows that has a column term."""
    return terms(spark.createDataFrame(list(rows), schema), loose=F.lit(loose))


def hits(el: DataFrame, words: DataFrame, context: int = 0, spans: Column | None = None, after: bool = False, letters: str = LETTERS) -> DataFrame:
    """The columns of el but text, those of the lexicon, s, e and m of each place where a term stands as whole tokens.

    Places may overlap. context adds before: so many characters in front of each, in the leaf; with after also those behind
    it, if the terms end in a token. With spans, an expression
    over text that gives array<struct<start, end>>, hits that lie in one of them are left out.
    letters are what tokens are made of; with ASCII, others part them, and the terms must have none.
    """
    spark, keep = el.sparkSession, [c for c in el.columns if c != "text"]
    # the bound is checked first: a lexicon of up to SMALL terms is a list, a larger one stays a table
    some = words.limit(SMALL + 1).collect()
    if not some:
        return nothing(el, words, keep, context, after)
    small = len(some) <= SMALL
    longest = max((len(r["rest"]) for r in some), default=0) if small else words.agg(F.max(F.size("rest"))).first()[0]
    longest, firsts = max(longest, 1), sorted({r["first"] for r in some}) if small else None
    if small:
        words = spark.createDataFrame(some, words.schema)
    # a letter that has two in lower case would make lengths differ
    literal = small and spans is None and not any(r["loose"] or r["head"] or r["tail"] or "\u0307" in r["first"] + "".join(x["gap"] + x["word"] for x in r["rest"]) for r in some)
    if literal and len(firsts) <= FEW:
        sides = ["before"] * bool(context) + ["after"] * after
        return marked(el, words, some, letters, context, after).select(*keep, *own(words), "s", "m", *sides, "e")
    known = (lambda raw: F.lower(raw).isin(firsts)) if firsts is not None else (lambda raw: F.lit(True))
    rows = el
    if firsts is not None:  # most leaves hold none of the first tokens
        some_first = few(firsts, letters)
        rows = rows.where(F.col("text").rlike(some_first) if some_first else F.exists(F.split("text", f"[^{letters}]+"), known))

    def one(tokens: Column, x: Column, i: Column) -> Column:
        some = context // 2 + 1  # tokens that hold so many characters
        behind = F.slice(tokens, F.greatest(i - some + 1, F.lit(1)), F.least(i, F.lit(some)))
        back = F.concat(F.array_join(F.transform(behind, lambda t: F.concat(t["before"], t["raw"])), ""), x["before"])
        more = [F.substring(back, -context, context).alias("before")] if context else []
        some = longest + some if after else longest
        return F.struct(F.lower(x["raw"]).alias("first"), x["raw"], x["before"].alias("gap"), x["s"], F.slice(tokens, i + 2, some).alias("ahead"), x["gap"].alias("behind"), *more)

    placed = T.let(cut(F.col("text"), letters), lambda ts: F.filter(F.transform(ts, lambda x, i: F.when(known(x["raw"]), one(ts, x, i))), lambda x: x.isNotNull()))
    if spans is not None:
        rows = rows.withColumn("excluded", F.transform(spans, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"))))
        each = F.concat(F.transform(placed, lambda x: F.struct(x.alias("x"), F.lit(None).cast("struct<s:int,e:int>").alias("span"))), F.transform("excluded", lambda x: F.struct(F.lit(None).alias("x"), x.alias("span"))))
        rows = rows.select(*keep, F.explode(each).alias("y")).select(*keep, "y.x", "y.span")
    else:
        rows = rows.select(*keep, F.explode(placed).alias("x"))
    joined = rows.withColumn("first", F.col("x.first")).join(F.broadcast(words) if firsts is not None else words, "first", "left" if spans is not None else "inner")
    n = F.size("rest")
    tokens = F.slice("x.ahead", 1, n)
    same = (F.size(tokens) == n) & F.forall(
        F.zip_with(tokens, "rest", lambda t, r: (F.lower(t["raw"]) == r["word"]) & F.when(F.col("loose"), t["before"].rlike(r"^[\s-]+$")).otherwise(t["before"] == r["gap"])), lambda ok: ok
    )
    behind = F.when(n > 0, F.element_at(tokens, F.greatest(n, F.lit(1)))["gap"]).otherwise(F.col("x.behind"))
    same = same & F.endswith("x.gap", F.col("head")) & F.startswith(behind, F.col("tail"))
    m = F.concat("head", "x.raw", F.array_join(F.transform(tokens, lambda t: F.concat(t["before"], t["raw"])), ""), "tail")
    s = (F.col("x.s") - F.length("head")).alias("s")
    extra = [F.col("x.before").alias("before")] if context else []
    if after:
        rest = F.slice("x.ahead", n + 1, context // 2 + 1)
        extra.append(F.substring(F.concat(behind, F.array_join(F.transform(rest, lambda t: F.concat(t["raw"], t["gap"])), "")), 1, context).alias("after"))
    if spans is None:
        out = joined.where(same).select(*keep, *own(words), s, m.alias("m"), *extra)
        return out.withColumn("e", F.col("s") + F.length("m"))
    out = joined.where(F.col("span").isNotNull() | same).select(*keep, "span", *own(words), F.coalesce(F.col("span.s"), s).alias("s"), m.alias("m"), *extra)
    out = out.withColumn("e", F.coalesce(F.col("span.e"), F.col("s") + F.length("m")))
    return outside(out, F.col("span").isNotNull(), "doc_id", "idx").drop("span")


def few(firsts: list[str], letters: str) -> str | None:
    """A pattern of any of the first tokens, whole and in any case; none if they are many, or a letter has two in lower case."""
    if len(firsts) > FEW or any("\u0307" in x for x in firsts):
        return None
    return f"{begin(firsts, letters)}(?iu:{T.either(firsts)})(?![{letters}])"


@lru_cache(1)
def cased() -> dict[str, str]:
    """The other characters that have each character in lower case."""
    out = defaultdict(str)
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.lower() != c:
            out[c.lower()] += c
    return dict(out)


def begin(firsts: Iterable[str], letters: str) -> str:
    """A pattern of the places where a token begins like one of the first tokens. Most places are told by one character or two."""
    heads = {x[0] for x in firsts}
    either = "".join(re.escape(c) for c in sorted(heads | {*"".join(cased().get(c, "") for c in heads)}))
    return f"(?<![a-z])(?=[{either}])(?<![{letters}])"


def whole(terms: list[Row], letters: str) -> str:
    """A pattern of the first tokens of terms, in any case, where a whole term stands, or the first LONG characters of a long one."""
    texts = {r["first"] + "".join(x["gap"] + x["word"] for x in r["rest"]) for r in terms}
    short, cut_ = [x for x in texts if len(x) <= LONG], {x[:LONG] for x in texts if len(x) > LONG}
    ways = [f"{T.either(short)}(?![{letters}])"] * bool(short) + [T.either(cut_)] * bool(cut_)
    return f"{begin(texts, letters)}(?iu:(?={'|'.join(ways)}))[{letters}]+"


def marked(el: DataFrame, words: DataFrame, terms: list[Row], letters: str, context: int = 0, after: bool = False) -> DataFrame:
    """hits of terms as they stand: one pattern marks the first tokens, and the text behind each is compared with the rest.

    Up to WHOLE terms are looked for as a whole: where first tokens are frequent words, most of them begin no term.

    The pattern takes what stands behind a token along with it, and what stands before it is the end of the pieces before, so
    no place is counted from the beginning of its text: long texts cost in proportion to their length.
    """
    words = words.withColumn("more", F.array_join(F.transform("rest", lambda x: F.concat(x["gap"], x["word"])), ""))
    reach = words.agg(F.max(F.length("more"))).first()[0] + 1 + (context if after else 0)
    token = whole(terms, letters) if len(terms) <= WHOLE else few(sorted({r["first"] for r in terms}), letters)
    rows = el.where(F.col("text").rlike(token))

    def piece(x: Column, i: Column) -> Column:
        own_ = lambda k: F.substring_index(F.substring_index(x, T.CLOSE, k), T.CLOSE, -1)
        some = F.struct(own_(1).alias("raw"), own_(2).alias("behind"), F.substring_index(x, T.CLOSE, -1).alias("gap"))
        return F.when(i == 0, F.struct(F.lit("").alias("raw"), F.lit("").alias("behind"), x.alias("gap"))).otherwise(some)

    def before(pieces: Column, i: Column) -> list[Column]:
        if not context:
            return []
        text = lambda x: F.concat(x["raw"], x["gap"])
        few = F.least(i, F.lit(context // 2 + 1))  # pieces that hold so many characters: a token and what parts it from the next
        last = F.substring(text(F.get(pieces, i - 1)), -context, context)
        more = F.array_join(F.transform(F.slice(pieces, i - few + 1, few), text), "")
        return [F.when(F.length(last) == context, last).otherwise(F.substring(more, -context, context)).alias("before")]

    def place(pieces: Column, at: Column) -> Column:
        one = lambda x, i: F.struct(F.lower(x["raw"]).alias("first"), F.get(at, i).alias("s"), x["raw"], x["behind"], *before(pieces, i))
        return F.slice(F.transform(pieces, one), 2, F.size(pieces) - 1)

    size = lambda x: F.length(x["raw"]) + F.length(x["gap"])
    marks = F.regexp_replace("text", f"{token}(?=((?s:.{{0,{reach}}})))", f"{T.OPEN}$0{T.CLOSE}$1{T.CLOSE}")
    plain = T.let(F.transform(F.split(marks, T.OPEN, -1), piece), lambda ps: T.let(T.starts(F.transform(ps, size)), lambda at: place(ps, at)))
    # texts that hold the marks are read from their beginning
    ahead = lambda x: [F.substring(F.col("text"), F.greatest(x["start"] - context, F.lit(0)) + 1, F.least(x["start"], F.lit(context))).alias("before")] * bool(context)
    read = lambda x: F.struct(F.lower(x["text"]).alias("first"), x["start"].alias("s"), x["text"].alias("raw"), F.substring(F.col("text"), x["end"] + 1, F.lit(reach)).alias("behind"), *ahead(x))
    walked = F.transform(T.match_spans(F.col("text"), token), read)
    odd = F.contains("text", F.lit(T.OPEN)) | F.contains("text", F.lit(T.CLOSE))
    rows = rows.select(*(c for c in el.columns if c != "text"), F.explode(F.when(odd, walked).otherwise(plain)).alias("x"))
    joined = rows.withColumn("first", F.col("x.first")).join(F.broadcast(words), "first")
    n = F.length("more")
    core = F.substring(F.col("x.behind"), F.lit(1), n)
    # the last token of the term ends where the text's does
    same = (n == 0) | ((F.lower(core) == F.col("more")) & ~F.substring(F.col("x.behind"), n + 1, F.lit(1)).rlike(f"[{letters}]"))
    out = joined.where(same).withColumn("s", F.col("x.s")).withColumn("m", F.concat("x.raw", core))
    if context:
        out = out.withColumn("before", F.col("x.before"))
    if after:
        out = out.withColumn("after", F.substring(F.col("x.behind"), n + 1, F.lit(context)))
    return out.withColumn("e", F.col("s") + F.length("m"))


def own(words: DataFrame) -> list[str]:
    return [c for c in words.columns if c not in ("first", "rest", "head", "tail", "loose")]


def nothing(el: DataFrame, words: DataFrame, keep: list[str], context: int, after: bool) -> DataFrame:
    """No hits, with the columns of hits."""
    typed = [F.lit(None).cast(words.schema[c].dataType).alias(c) for c in own(words)]
    sides = [F.lit("").alias(c) for c in ("before",) * bool(context) + ("after",) * after]
    return el.where("false").select(*keep, *typed, F.lit(0).alias("s"), F.lit("").alias("m"), *sides, F.lit(0).alias("e"))


def outside(rows: DataFrame, is_span: Column, *leaf: str) -> DataFrame:
    """Of rows with s and e in the leaf that the columns name, those that are no spans and lie in none of the spans.

    A sweep: rows in the order of their starts meet the largest end of the spans that began before or with them.
    """
    sweep = Window.partitionBy(*leaf).orderBy("s", F.col("span_last")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("span_last", ~is_span)
    reach = F.max(F.when(~F.col("span_last"), F.col("e"))).over(sweep)
    return rows.withColumn("reach", reach).where(F.col("span_last") & (F.col("reach").isNull() | (F.col("reach") < F.col("e")))).drop("reach", "span_last")


def excluded(text: Column) -> Column:
    """Spans of URLs, addresses and quotes; texts that can't hold any aren't looked at."""
    risky = text.rlike("[@\"'“‘]|(?i)https?://|www\\.|\\.(com|org|net|co\\.uk|io|ai|bet|casino|gg)")
    found = F.flatten(F.array(*(T.match_spans(text, p, True) for p in (L.URL, L.EMAIL, L.QUOTED))))
    return F.when(risky, found).otherwise(F.array().cast(f"array<{T.SPAN}>"))


def join_forms(parts: list[str]) -> list[str]:
    """The ways to write the parts of a name, each two together or apart."""
    forms = [parts[0]]
    for p in parts[1:]:
        forms = [f + gap + p for f in forms for gap in ("", " ")]
    return forms
