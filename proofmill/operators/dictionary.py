"""Which words are in the dictionary: a table of word frequencies from the corpus itself, probed by lemma keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored
from .document import of_type

#: A dictionary of up to so many words is broadcast, some 20 MB; a larger one is joined by hash, after a Bloom filter.
MOST = 500_000
#: Bits of a part of the filter, as the bitmap functions make them, and the number of parts: 4 MB in all.
PART, PARTS = 32_768, 1024


def word_frequencies(el: DataFrame) -> DataFrame:
    """(word, n, freq) of the words that paragraphs have in lower case: names, which have capitals, don't count."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("word")
    counted = of_type(el, "paragraph").select(words).where(F.col("word") == F.lower("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = stored(counted, "words")  # the corpus is read once, however often its words are looked up
    total = counted.agg(F.sum("n")).first()[0] or 1
    return counted.withColumn("freq", F.col("n") / total)


def lemma_keys(word: Column) -> Column:
    """The forms under which a word may stand: without a possessive, and also without a plural s if over three letters are left."""
    base = F.regexp_replace(F.lower(word), r"(['’]s|(?<=s)['’])$", "")
    return F.array_distinct(F.when((F.length(base) > 3) & base.endswith("s"), F.array(base, F.substring(base, F.lit(1), F.length(base) - 1))).otherwise(F.array(base)))


def place(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(PART * PARTS)) + 1


def bloom(words: DataFrame) -> DataFrame:
    """(part, bits): a filter of the words, PARTS bitmaps of PART bits at most."""
    at = words.select(place(F.col("word")).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def maybe(rows: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Rows whose word may be among words: none is lost, some that aren't stay. The filter's size doesn't grow, so it is broadcast."""
    at = rows.withColumn("part", F.bitmap_bucket_number(place(F.col(column)))).withColumn("bit", F.bitmap_bit_position(place(F.col(column))))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = at.join(F.broadcast(bloom(words)), "part").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
    return found.select(*rows.columns)


def known_words(words: DataFrame, dictionary: DataFrame, most: int = MOST) -> DataFrame:
    """Those of words (word) of which a lemma key is in the dictionary (word)."""
    keyed = words.select("word").distinct().select("word", F.explode(lemma_keys(F.col("word"))).alias("key"))
    entries = dictionary.select("word").distinct()
    small = entries.limit(most + 1).count() <= most  # the size is measured before a side is chosen
    keyed = keyed if small else maybe(keyed, "key", entries)
    entries = entries.withColumnRenamed("word", "key")
    return keyed.join(F.broadcast(entries) if small else entries, "key", "left_semi").select("word").distinct()


def unknown_capitals(el: DataFrame, dictionary: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, idx, no, word) of words of headings, the first left out, that have a capital and aren't in the dictionary."""
    bare = F.regexp_replace("w", r"^[^\p{L}]+|[^\p{L}'’]+$", "")
    rows = of_type(el, "heading").select("doc_id", "idx", F.posexplode(T.tokens(F.col("text"))).alias("no", "w")).where((F.col("no") > 0) & F.col("w").rlike(r"^\p{Lu}"))
    rows = stored(rows.select("doc_id", "idx", "no", bare.alias("word")), "capitals")
    return rows.join(known_words(rows, dictionary, most), "word", "left_anti").select("doc_id", "idx", "no", "word")
