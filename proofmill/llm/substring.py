"""Substring deduplication: words covered by a window that also starts in a document with a smaller id go.

Matching is done by compressed full-text indexes, one per shard of text: backward search computes, for each streamed
sequence, how far matches in smaller documents reach, and intervals of width words or more are reported.

So that no document meets text it cannot share, windows are routed first. Each window's anchor is the smallest hash of
its gram-word grams; equal windows have equal anchors. Runs of windows with one anchor are sequences of width to
width + RUN - 1 words. Anchors seen in one document only drop out; equal sequences, compared by two 64-bit hashes, collapse
to their smallest document before any text moves; a shard is a set of anchors with the sequences of all their documents.

An anchor with more than HOT distinct sequences (a phrase in very many documents, with other text around it) would fill a
shard by itself. Its sequences get new anchors from longer grams, last from whole windows, and go through the same steps and
indexes: with a window for its anchor, an anchor has few sequences. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_WORDS, Words, record, split_join, stored
from .fmindex import FMIndex, repeated_windows

WIDTH, GRAM, RUN, HOT = 50, 12, 64, 2000
SHARD_WORDS = 1_000_000
BASE, OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Hashes:
    """64-bit hashes of words, looked up by a task's word numbers."""

    def __init__(self) -> None:
        self.words, self.table = Words(), np.zeros(0, np.uint64)

    def of(self, texts: list[bytes]):
        """The hashes of each text's words, in turn. The table grows once in 500 texts, as growing copies it."""
        for lo in range(0, len(texts), 500):
            if len(self.words.number) > MAX_WORDS:
                self.__init__()
            numbers = [self.words.numbers(t.split()) for t in texts[lo : lo + 500]]
            if new := self.words.new():
                self.table = np.concatenate([self.table, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))])
            yield from (self.table[n] for n in numbers)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = 2 * n
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.n, b, np.uint64))]) for b in (self.base, inverse))
        return self.up, self.down

    def parts(self, h: np.ndarray):
        """A function that gives the hash of the size words at each place."""
        up, down = self.upto(len(h) + 1)
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
        return lambda a, size: mixed((prefix[a + size] - prefix[a]) * down[a])


def anchors(h: np.ndarray, powers: tuple[Powers, Powers], width: int, gram: int, run: int) -> tuple[np.ndarray, ...]:
    """(anchor, two hashes of the sequence, first window, windows) for the runs of one document's word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 2
    part, other = (p.parts(h) for p in powers)
    low, span, want = part(np.arange(len(h) - gram + 1), gram), 1, width - gram + 1
    while 2 * span <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < want:
        low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.append(start, n))
    cuts = -(-size // run)
    first = np.repeat(start, cuts) + run * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    count = np.diff(np.append(first, n))
    return low[first], part(first, count + width - 1) + count.astype(np.uint64), other(first, count + width - 1), first, count


RUNS = "anchor long, seq long, other long, id long, t long, x int, w int"
RUN_SCHEMA = pa.schema([("anchor", pa.int64()), ("seq", pa.int64()), ("other", pa.int64()), ("id", pa.int64()), ("t", pa.int64()), ("x", pa.int32()), ("w", pa.int32())])
SEQUENCE = ["anchor", "seq", "other"]


def duplicate_spans(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, gram: int = GRAM, run: int = RUN, hot: int = HOT) -> DataFrame:
    """(id, t, spans): for each text with repeated windows, the word spans [lo, hi) that they cover. t is the text's hash."""
    text = F.col(text_col).cast("string").cast("binary")
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))

    def scan(it):
        hashes, powers = Hashes(), (Powers(BASE), Powers(OTHER))
        for b in it:
            cols, sizes = [], []
            for h in hashes.of(b.column(2).to_pylist()):
                cols.append(anchors(h, powers, width, gram, run))
                sizes.append(len(cols[-1][0]))
            if cols:
                a, s, o, x, w = (np.concatenate(c) for c in zip(*cols))
                ids = (np.repeat(b.column(i).to_numpy(), sizes) for i in (0, 1))
                yield record(RUN_SCHEMA, a.view(np.int64), s.view(np.int64), o.view(np.int64), *ids, x.astype(np.int32), w.astype(np.int32))

    every, spans = stored(rows.mapInArrow(scan, RUNS), "anchors"), None
    for longer in ((gram + width) // 2, width, None):
        found, crowded = matches(every, rows, width, run, hot, longer)
        spans = found if spans is None else spans.union(found)
        if longer is None or crowded.isEmpty():
            break
        every = crowded
    return spans.groupBy("id", "t").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def matches(every: DataFrame, rows: DataFrame, width: int, run: int, hot: int, longer: int | None) -> tuple[DataFrame, DataFrame]:
    """Spans (id, t, lo, hi) of repeated windows among the given runs, and the runs of crowded anchors by grams of longer words.

    Runs of the first level have no words yet: they are fetched from rows. Those made of crowded anchors bring theirs along.
    """
    bring = [c for c in ("words",) if c in every.columns]
    shared = every.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("a < b").select("anchor", "n")
    every = stored(split_join(every, stored(shared, "heads"), ["anchor"]), "shared")
    first = every.groupBy(*SEQUENCE).agg(F.min(F.struct("id", "t", "x", "w", *bring)).alias("f"), F.count("*").alias("n")).select(*SEQUENCE, "f.*", "n")
    first = stored(first, "first")
    runs = first.drop("n").withColumn("hot", F.lit(False))
    if longer:
        crowded = first.groupBy("anchor").agg(F.count("*").alias("size")).where(F.col("size") > hot).select("anchor", F.lit(True).alias("hot"))
        runs = runs.drop("hot").join(crowded, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    schema = pa.schema([*RUN_SCHEMA, ("words", pa.binary()), ("again", pa.bool_())])

    def cut(it):
        """Sequences with their words; those of crowded anchors as runs of other anchors."""
        hashes, powers = Hashes(), (Powers(BASE), Powers(OTHER))
        for b in it:
            if bring:
                names, texts = b.column("id").to_pylist(), [np.frombuffer(x, np.uint64) for x in b.column("words").to_pylist()]
                wanted = [[r | {"x": 0, "at": r["x"]}] for r in b.select([*SEQUENCE, "x", "w", "hot"]).to_pylist()]
            else:
                names, texts = b.column("id").to_pylist(), hashes.of(b.column("text").to_pylist())
                wanted = [[r | {"at": r["x"]} for r in one] for one in b.column("runs").to_pylist()]
            for i, t, h, some in zip(names, b.column("t").to_pylist(), texts, wanted):
                parts = []
                for r in some:
                    own = h[r["x"] : r["x"] + r["w"] + width - 1]
                    if r["hot"]:
                        for a, s, o, x, w in zip(*(c.view(np.int64).tolist() for c in anchors(own, powers, width, longer, run))):
                            parts.append((a, s, o, i, t, r["at"] + x, w, own[x : x + w + width - 1].tobytes(), True))
                    else:
                        parts.append((r["anchor"], r["seq"], r["other"], i, t, r["at"], r["w"], own.tobytes(), False))
                for lo in range(0, len(parts), 20_000):
                    yield record(schema, *zip(*parts[lo : lo + 20_000]))

    if bring:
        held = runs
    else:
        wanted = runs.groupBy("id", "t").agg(F.collect_list(F.struct(*SEQUENCE, "x", "w", "hot")).alias("runs"))
        # one row for each (id, t), should the table repeat rows
        held = rows.join(wanted, ["id", "t"]).select("id", "t", "text", "runs").dropDuplicates(["id", "t"])
    parts = stored(held.mapInArrow(cut, RUNS + ", words binary, again boolean"), "sequences")
    dealt = parts.where("not again").select(*SEQUENCE, "id", "words").repartition("anchor").sortWithinPartitions("anchor")
    hits = stored(dealt.mapInArrow(lambda it: search(it, width), "seq long, other long, first int, last int, id long"), "hits")
    # a later document has every window of its sequence in the first one; the first has what the index reports
    later = split_join(every, first.select(*SEQUENCE, F.col("id").alias("own"), "n"), SEQUENCE).where("id > own")
    spans = later.select("id", "t", F.col("x").alias("lo"), (F.col("x") + F.col("w") + (width - 1)).alias("hi"))
    own = every.join(hits, ["seq", "other", "id"]).select("id", "t", F.col("x") + F.col("first"), F.col("x") + F.col("last") + width)
    return spans.union(own), parts.where("again").drop("again")


def search(it, width: int):
    """Builds an index over each shard of sequences, sorted by anchor, and streams the same sequences through it."""
    schema = pa.schema([("seq", pa.int64()), ("other", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("id", pa.int64())])

    def shard(held):
        anchor, seq, other, ids = (np.concatenate([h[k] for h in held]) for k in range(4))
        words = [w for h in held for w in h[4]]
        size = np.array([len(w) // 8 for w in words])
        # sequences alone with their anchor share nothing
        start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        many = np.diff(np.append(start, len(anchor))) > 1
        keep = np.flatnonzero(np.repeat(many, np.diff(np.append(start, len(anchor)))))
        if not len(keep):
            return record(schema, *[[]] * 5)
        codes = np.unique(np.frombuffer(b"".join(words[i] for i in keep), np.uint64), return_inverse=True)[1] + 1
        size = size[keep]
        base = np.cumsum(size) - size
        names, doc = np.unique(ids[keep], return_inverse=True)
        index = FMIndex([codes[b : b + s] for b, s in zip(base, size)], doc.astype(np.int32), 1 << (width - 1).bit_length())
        hits = repeated_windows(index, codes, base, size, doc, width)
        at = keep[[i for i, _, _ in hits]] if hits else np.zeros(0, np.int64)
        return record(schema, seq[at], other[at], [a for _, a, _ in hits], [b for _, _, b in hits], ids[at])

    held, words = [], 0
    for b in it:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in range(4)] + [b.column(4).to_pylist()]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if words >= SHARD_WORDS and (cut or held[-1][0][-1] != cols[0][0]):
            if cut:
                held.append([c[:cut] for c in cols])
                cols = [c[cut:] for c in cols]
            yield shard(held)
            held, words = [], 0
        held.append(cols)
        words += sum(map(len, cols[4])) // 8
    if held:
        yield shard(held)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """(id, n_words, n_removed, kept, words_sha256) and the columns in carry. kept: the kept words joined by one space, or
    the text itself if nothing went; words_sha256: of the kept words joined by one space.

    A null text has no words. A row with a null id is kept whole and is no source. Rows that share an id never match each
    other; equal rows are treated alike.
    """
    spans = duplicate_spans(docs, id_col, text_col, width, hot=hot)
    text = F.col(text_col).cast("string").cast("binary")
    more = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("t"), text.alias("text"), *more)
    joined = rows.join(spans, ["id", "t"], "left").select("id", "text", "spans", *(f"carried_{k}" for k in range(len(carry))))
    made = "id long, n_words long, n_removed long, kept binary, words_sha256 string"

    def clean(it):
        for b in it:
            for lo in range(0, b.num_rows, 1000):
                part, out = b.slice(lo, 1000), []
                for t, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words, n = t.split() if t else [], 0
                    kept = words
                    if spans:
                        gone = np.zeros(len(words) + 1, np.int32)
                        np.add.at(gone, [s["lo"] for s in spans], 1)
                        np.add.at(gone, [s["hi"] for s in spans], -1)
                        stay = np.cumsum(gone[:-1]) == 0
                        n = int((~stay).sum())
                        kept = [words[k] for k in np.flatnonzero(stay)]
                    joined = b" ".join(kept)
                    out.append((len(words), n, joined if n else t, hashlib.sha256(joined).hexdigest()))
                cols = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.string()))]
                names = ["id", "n_words", "n_removed", "kept", "words_sha256", *(f"carried_{k}" for k in range(len(carry)))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, *part.columns[3:]], names)

    kinds = "".join(f", carried_{k} {joined.schema[3 + k].dataType.simpleString()}" for k in range(len(carry)))
    found = joined.mapInArrow(clean, made + kinds).withColumn("kept", F.col("kept").cast("string"))
    return found.withColumnsRenamed({f"carried_{k}": c for k, c in enumerate(carry)})
