"""SimHash near-duplicates: fingerprints linked by bit-sliced comparison inside equal-block buckets.

Fingerprints: XXH64 (seed 42) of 3-word shingles, repeats included; a bit is 1 if set in over half the hashes. Texts of
fewer words hash their whole word sequence; texts without words, empty or null, have fingerprint zero.

Links: equal fingerprints are collapsed first. The 64 bits are cut into five blocks; two fingerprints within 3 bits
agree in at least two of them, so the ten pairs of blocks are ten bucket keys and lose no link. In a bucket the bit
planes stand vertically, 64 fingerprints a machine word; carry-save counters add up differing bits for whole words and
a word of lanes is abandoned once all of its lanes exceed the radius. A bucket emits links that span its clusters, at
most one per row, never all pairs.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARE, as_bytes, batches, record, split_join, stored
from .graph import components

RADIUS, CROWD = 3, 4096
#: First bit and width of each block.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SPREAD = np.uint64(0x0101010101010101)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(text: bytes | None, k: int = 3) -> np.ndarray:
    words = text.lower().split() if text else []
    if len(words) < k:
        return np.array([_hash(b" ".join(words))] if words else [], np.uint64)
    return np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(k))))), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: a bit is set if over half of the run have it. Empty runs give zero.

    Eight shifts spread the 64 bits over byte lanes of a word; runs are summed in pieces of 255, which a byte can hold.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    pieces = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    fp = np.zeros(len(full), np.uint64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & SPREAD, cuts).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
        for j in range(8):
            fp |= (2 * ones[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    out[full] = fp
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp): one row for each row of docs; fp is the fingerprint's 64 bits as a signed long."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(it):
        for ids, texts in batches(it):
            for lo in range(0, len(ids), 500):
                runs = [shingle_hashes(t, k) for t in texts[lo : lo + 500]]
                fps = majority(np.concatenate(runs), np.array([len(r) for r in runs]))
                yield record(schema, ids[lo : lo + 500], fps.view(np.int64))

    return as_bytes(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """The bits of values stood up vertically: row p holds bit p of 64 values in each word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, words: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For each query i and lane word words[i]: a mask of the 64 lanes at distance radius or less. Returns (i, mask).

    Three counters hold the binary digits of the count so far, a fourth notes overflow; every fourth plane drops the
    pairs in which all lanes exceed. radius is below 8.
    """
    at, q = np.arange(len(queries)), queries
    c0 = np.zeros(len(q), np.uint64)
    c1, c2, over = c0.copy(), c0.copy(), c0.copy()
    for p in range(64):
        d = lanes[p, words] ^ ((q >> np.uint64(p)) & np.uint64(1)) * ALL
        c0, d = c0 ^ d, c0 & d
        c1, d = c1 ^ d, c1 & d
        c2, d = c2 ^ d, c2 & d
        over |= d
        if p % 4 == 3:
            live = np.flatnonzero(~beyond(c0, c1, c2, over, radius))
            if len(live) < len(q):
                at, q, words, c0, c1, c2, over = (x[live] for x in (at, q, words, c0, c1, c2, over))
            if not len(q):
                break
    return at, ~beyond(c0, c1, c2, over, radius)


def beyond(c0, c1, c2, over, radius: int):
    """Lanes whose count exceeds radius, from the counters' binary digits."""
    digits, more, equal = (c0, c1, c2), over.copy(), ~over
    for k in (2, 1, 0):
        if radius >> k & 1:
            equal = equal & digits[k]
        else:
            more |= equal & digits[k]
            equal = equal & ~digits[k]
    return more


class Forest:
    """Smallest row of each cluster, by rounds of hooking and pointer jumping over arrays of links."""

    def __init__(self, n: int) -> None:
        self.top = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.top[a], self.top[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.top, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.top[self.top]
                if (up == self.top).all():
                    break
                self.top = up


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the clusters of each bucket; rows are sorted by key."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    keep = np.repeat(size > 1, size)
    fps, size = fps[keep].view(np.uint64), size[size > 1]
    n = len(fps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.repeat(np.cumsum(size), size)
    lanes, forest, row = planes(fps), Forest(n), np.arange(n)
    for ahead in range(int(((end - 1) // 64 - row // 64).max()) + 1):
        asked = np.flatnonzero(row // 64 + ahead <= (end - 1) // 64)
        for lo in range(0, len(asked), 4096):
            i = asked[lo : lo + 4096]
            w = i // 64 + ahead
            at, mask = within(fps[i], w, lanes, radius)
            hit = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(hit)
            a, b = i[at[r]], w[at[r]] * 64 + lane
            ok = (b > a) & (b < end[a])
            forest.join(a[ok], b[ok])
    linked = np.flatnonzero(forest.top != row)
    return fps[forest.top[linked]].view(np.int64), fps[linked].view(np.int64)


def link_buckets(it):
    """Arrow batches of (key, fp) sorted by key; a bucket is held as a whole, 16 bytes a row."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys, fps = [], []

    def flush():
        a, b = bucket_links(np.concatenate(keys), np.concatenate(fps))
        return record(schema, a, b)

    for batch in it:
        k, f = (batch.column(i).to_numpy() for i in range(2))
        if keys and len(k) and sum(map(len, keys)) >= 50_000 and k[0] != keys[-1][-1]:
            yield flush()
            keys, fps = [], []
        if len(k):
            cut = np.searchsorted(k, k[-1])  # rows before the last bucket of this batch are complete
            if cut and sum(map(len, keys)) >= 50_000:
                keys.append(k[:cut])
                fps.append(f[:cut])
                yield flush()
                keys, fps, k, f = [], [], k[cut:], f[cut:]
            keys.append(k)
            fps.append(f)
    if keys:
        yield flush()


def rest_of(fp, x: int, y: int):
    """The bits of fp outside blocks x and y, moved together: 39 at most."""
    out, at = F.lit(0).cast("long"), 0
    for k, (lo, n) in enumerate(BLOCKS):
        if k not in (x, y):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, lo).bitwiseAND((1 << n) - 1), at))
            at += n
    return out


def fingerprint_links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints of column fp that join all within RADIUS bits, directly or not.

    Buckets of over crowd fingerprints that also have over a SHARE-th of all bucket rows (so at most SHARE of them) are cut
    again: two of their fingerprints agree in one of four parts of the 39 bits outside the bucket's blocks.
    """
    part = [F.shiftrightunsigned("fp", lo).bitwiseAND((1 << n) - 1) for lo, n in BLOCKS]
    pairs = list(combinations(range(5), 2))
    keys = [F.lit(i << 32).bitwiseOR(F.shiftleft(part[x], 13).bitwiseOR(part[y])) for i, (x, y) in enumerate(pairs)]
    buckets = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    total = 10 * distinct.count()
    hot = stored(buckets.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") > crowd) & (F.col("n") * SHARE > total)).select("key"), "crowded")
    rest = F.get(F.array(*(rest_of(F.col("fp"), x, y) for x, y in pairs)), F.shiftrightunsigned("key", 32).cast("int"))
    fine = F.explode(F.array(*(F.xxhash64("key", F.lit(j), F.shiftrightunsigned(rest, 10 * j).bitwiseAND(1023)) for j in range(4))))
    cut = buckets.join(F.broadcast(hot), "key").select(fine.alias("key"), "fp")
    dealt = buckets.join(F.broadcast(hot), "key", "left_anti").unionByName(cut).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(link_buckets, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable through fingerprints that differ in 3 bits or fewer.

    Null and empty texts have fingerprint zero and link with each other; repeated ids keep all their rows. The rows of a
    fingerprint that very many share stay where they are when components are told to them.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    label = components(fingerprint_links(distinct.select("fp")))
    low = label.join(distinct, label.node == distinct.fp).select("label", "node", "least")
    least = low.groupBy("label").agg(F.min("least").alias("component"))
    joined = low.join(least, "label").select(F.col("node").alias("fp"), "component")
    by_fp = stored(distinct.join(joined, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component")), "components")
    return split_join(prints, by_fp, ["fp"]).select("id", "fp", "component")
