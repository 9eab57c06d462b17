"""Benchmark decontamination with DataFrame operations alone.

Texts are lower-cased words ``[^\\x20\\x09-\\x0D]+`` and their 5-word shingles, repeats included. An item is found in a
document if one of the document's windows of the item's size (the whole document if that is shorter) has a weighted
shingle similarity of 0.8 or more with it: shared shingles over all shingles, each counted as often as it occurs.

Windows: a window that similar has a fixed share of its shingles in the items of its size, wherever these lie in them. So
the windows are all those with as many such shingles, counted by position; the others are no match. Shingles travel as hashes
with their places; words are fetched once the windows are known.

Each window gets a 64-bit SimHash of its shingles. Retrieval: fingerprints are cut into four blocks of 16 bits. An item is
listed with all values within three bits of each of its blocks, a fingerprint asks for all within one bit, among the items of
its size: an equality join on (size, block, value) returns every item within RADIUS = 4 * (3 + 1 + 1) - 1 = 19 bits. At
similarity 0.8 the distance is 9.7 on average with a deviation of 2.9. Of items of another size none is tested, of the same
size 15 % of random ones. Equal fingerprints ask once. Verification: the exact similarity decides.

Items and documents of fewer than five words have no shingle and match nothing; so do null texts and null ids. Rows that
share an id count as one document, of which the best window is reported.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_join, stored

K, SIMILAR, BLOCKS, WIDTH = 5, 0.8, 4, 16
#: Bits within which an item is listed, and within which a window asks, in each block.
LISTED, ASKED = 3, 1
RADIUS = BLOCKS * (LISTED + ASKED + 1) - 1


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row. The optimizer moves plain projections into the lambdas that use them,
    where they would run again for each element; it doesn't move what a generator makes."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def gram(w: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(w, i + j) for j in range(K)))


def grams(w: Column) -> Column:
    return F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: gram(w, i))).otherwise(F.array().cast("array<bigint>"))


def simhash(g: Column) -> Column:
    """A bit is set if over half of the shingles' hashes have it."""
    ones = lambda b: F.aggregate(g, F.lit(0), lambda n, h: n + F.getbit(h, b))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(2 * ones(b) > F.size(g), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def counted(g: Column) -> Column:
    """Shingles with the number of their earlier occurrences: as sets, these intersect as the multisets do."""
    tagged = F.transform(g, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(g, 1, i), lambda y: y == x))))
    return F.when(F.size(F.array_distinct(g)) < F.size(g), tagged).otherwise(F.transform(g, lambda x: F.xxhash64(x, F.lit(0))))


def probes(fp: Column, within: int) -> Column:
    """(block, value) of all values within so many bits of each block of fp."""
    near = [sum(1 << b for b in bits) for k in range(within + 1) for bits in combinations(range(WIDTH), k)]

    def one(i: int) -> Column:
        value = F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND((1 << WIDTH) - 1)
        return F.transform(F.array(*map(F.lit, near)), lambda x: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(x).alias("value")))

    each = [one(i) for i in range(BLOCKS)]
    return F.explode(F.concat(*each))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): one row per document and item found in it, with the best window."""
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = pinned(pinned(items, "iw", words(F.col("text"))).where(F.size("iw") >= K).drop("text"), "ig", grams(F.col("iw")))
    items = items.select("item_id", F.size("iw").alias("size"), "ig", simhash(F.col("ig")).alias("ifp"), counted(F.col("ig")).alias("it"))
    items = stored(items.dropDuplicates(["item_id", "it"]), "items")

    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("r"))
    split = lambda df: pinned(df, "w", words(F.col("text"))).drop("text").where(F.size("w") >= K)
    rows = split(texts)
    at = F.transform(grams(F.col("w")), lambda g, i: F.struct(g.alias("g"), i.alias("p")))
    hits = rows.select("doc_id", "r", F.size("w").alias("n"), F.explode(at).alias("h")).select("doc_id", "r", "n", "h.*")
    # by broadcast while Spark finds the table small enough
    places = stored(items.select("size", F.explode("ig").alias("g")).distinct(), "places")
    starts = hits.join(places, "g").groupBy("doc_id", "r", "n", "size").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    # similarity s of x and y shingles takes s / (1 + s) * (x + y) shared ones
    shingles = F.least("n", "size") - (K - 1)
    need = F.ceil(F.lit(similar / (1 + similar)) * (shingles + F.col("size") - (K - 1)) - 1e-6).cast("int")
    starts = starts.withColumn("need", F.greatest(F.lit(1), need)).withColumn("shingles", shingles).where(F.size("ps") >= F.col("need"))
    # starts between the hit before (or the text's start) and hit i, from which the hits i to i + need - 1 are in the window
    low = lambda p, i: F.greatest(F.lit(0), F.when(i > 0, F.get("ps", i - 1) + 1).otherwise(0), F.coalesce(F.get("ps", i + F.col("need") - 1), F.lit(1 << 30)) - F.col("shingles") + 1)
    span = lambda p, i: F.struct(low(p, i).alias("a"), F.least(p, F.greatest(F.lit(0), F.col("n") - F.col("size"))).alias("b"))
    spans = F.filter(F.transform("ps", span), lambda x: x["a"] <= x["b"])
    starts = pinned(starts, "spans", spans).select("doc_id", "r", "size", F.explode("spans").alias("x")).select("doc_id", "r", "size", F.explode(F.sequence("x.a", "x.b")).alias("start"))
    # one row a text, so that its words are fetched and cut once
    wanted = stored(starts.groupBy("doc_id", "r").agg(F.collect_set(F.struct("size", "start")).alias("cuts")), "cuts")
    held = split(texts.join(wanted, ["doc_id", "r"]).dropDuplicates(["doc_id", "r"]))
    cut = held.select("doc_id", F.size("w").alias("n"), "w", F.explode("cuts").alias("c")).select("doc_id", "n", "c.size", "c.start", F.slice("w", F.col("c.start") + 1, F.col("c.size")).alias("window"))
    windows = pinned(cut, "dg", grams(F.col("window")))
    windows = stored(windows.select("doc_id", "n", "start", "size", "dg", simhash(F.col("dg")).alias("fp")), "windows")

    prints = stored(windows.groupBy("size", "fp").agg(F.count("*").alias("n")), "prints")
    listed = items.select("size", "ifp", "item_id", probes(F.col("ifp"), LISTED).alias("k")).select("size", "ifp", "item_id", "k.*")
    asked = prints.select("size", "fp", probes(F.col("fp"), ASKED).alias("k")).select("size", "fp", "k.*")
    # probes are many times the rows they come from, by which Spark would judge their size: no broadcast
    near = asked.hint("merge").join(listed, ["size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    found = near.groupBy("size", "fp").agg(F.collect_set("item_id").alias("items"))
    found = stored(prints.join(found, ["size", "fp"]), "found")
    pairs = split_join(windows.withColumnRenamed("n", "words"), found, ["size", "fp"])
    pairs = pairs.select("doc_id", "start", F.col("words").alias("n"), "size", "dg", F.explode("items").alias("item_id"))
    # items of one id may differ: each is judged
    often = stored(found.select("n", F.explode("items").alias("item_id")).groupBy("item_id").agg(F.sum("n").alias("n")), "often")
    whole = items.groupBy("item_id", "size").agg(F.collect_list(F.struct("it", "ig")).alias("texts")).join(often, "item_id")
    full = split_join(pairs, stored(whole, "texts"), ["item_id", "size"]).withColumn("i", F.explode("texts")).select("doc_id", "item_id", "start", "n", "size", "dg", "i.*")
    # more shingles than this in common are impossible
    both = F.size(F.array_intersect(counted(F.col("dg")), F.col("it")))
    judged = full.where(F.least(F.size("dg"), F.size("it")) >= similar * F.greatest(F.size("dg"), F.size("it")))
    judged = pinned(judged, "both", both)
    similarity = F.col("both") / (F.size("dg") + F.size("it") - F.col("both"))
    # of windows as similar, the first in which a shingle lies where the item has it; at the ends of a text, or beyond there
    same = lambda i: F.get("dg", i) == F.get("ig", i)
    before = lambda i: (F.col("start") == 0) & F.array_contains(F.slice("ig", i + 1, F.size("ig")), F.get("dg", i))
    after = lambda i: (F.col("start") == F.col("n") - F.col("size")) & F.array_contains(F.slice("ig", 1, i + 1), F.get("dg", i))
    lies = F.exists(F.sequence(F.lit(0), F.size("dg") - 1), lambda i: F.coalesce(same(i), F.lit(False)) | before(i) | after(i))
    best = F.max(F.struct(similarity.alias("similarity"), lies.alias("lies"), (-F.col("start")).alias("s"), F.col("size").alias("n")))
    return judged.where(similarity >= similar).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.similarity", (-F.col("b.s")).cast("long").alias("start"), F.col("b.n").cast("long").alias("n_words"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dp AS (SELECT doc_id, len(w) AS n, w, unnest(range(len(w) - 4)) AS p FROM d WHERE len(w) >= 5),
dg AS (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + 5], ' ') AS g FROM dp),
bp AS (SELECT item_id, len(w) AS size, w, unnest(range(len(w) - 4)) AS q FROM b WHERE len(w) >= 5),
bg AS (SELECT item_id, size, q, array_to_string(w[q + 1 : q + 5], ' ') AS g FROM bp),
c AS (SELECT DISTINCT doc_id, n, item_id, size, greatest(0, least(p - q, n - size)) AS start FROM dg JOIN bg USING (g)),
wg AS (SELECT c.doc_id, c.item_id, c.start, dg.g, count(*) AS k FROM c JOIN dg ON dg.doc_id = c.doc_id AND dg.p BETWEEN c.start AND c.start + c.size - 5 GROUP BY ALL),
ig AS (SELECT item_id, g, count(*) AS k FROM bg GROUP BY ALL),
i AS (SELECT wg.doc_id, wg.item_id, wg.start, sum(least(wg.k, ig.k)) AS both_n FROM wg JOIN ig USING (item_id, g) GROUP BY ALL),
s AS (SELECT i.doc_id, i.item_id, i.start, c.size, i.both_n / (least(c.n, c.size) - 4 + c.size - 4 - i.both_n) AS similarity FROM i JOIN c USING (doc_id, item_id, start))
SELECT doc_id, item_id, similarity, CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS n_words FROM s WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
