"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by the permutation of its NEAREST nearest pivots, the nearest first. It is posted, with its
permutation, to one inverted list for each of the first POSTED of them. In a list, shared pivots are counted for all its
vectors at once; pairs that share SHARED or more pivots are verified by their cosine in double precision, once, in the
list of the smallest-numbered pivot that both are posted to. Links found are therefore exact; the index may miss some.

Pivots are vectors of a bounded sample, the first SAMPLE times as many in the order of their hash as pivots are wanted,
no two of which have a cosine of DIVERSE or more: a cluster with much of the sample still gets one pivot. Their number
grows with the square root of the number of vectors, up to MAX_PIVOTS; every vector is indexed, those of other lengths
against as many components of the pivots.

Equal vectors are collapsed and counted. A list of more than BLOCK vectors is dealt out in pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, split_join, stored
from .graph import components
from .simhash import Forest

NEAREST, POSTED, SHARED, MAX_PIVOTS, SAMPLE, DIVERSE, BLOCK = 8, 4, 3, 4096, 4, 0.7, 2000


def choose(sample: np.ndarray, n: int) -> np.ndarray:
    """The first n rows of the normalised sample that are no closer than DIVERSE to an earlier choice."""
    out = np.zeros((0, sample.shape[1]))
    for v in sample:
        if len(out) < n and not (out @ v >= DIVERSE).any():
            out = np.vstack([out, v])
    return out


def normal(v: np.ndarray) -> np.ndarray:
    v = v / np.maximum(np.abs(v).max(1, keepdims=True), np.finfo(np.float64).tiny)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(np.float64).tiny)


def of_length(pivots: np.ndarray, dim: int) -> np.ndarray:
    """The pivots' first dim components, with zeros behind where they have fewer."""
    out = np.zeros((len(pivots), dim))
    out[:, : pivots.shape[1]] = pivots[:, :dim]
    return normal(out)


def permutations(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each vector's nearest pivots, the nearest first; of pivots as near the smaller number comes first."""
    k = min(NEAREST, len(pivots))
    close = -(v @ pivots.T)
    part = np.argpartition(close, k - 1, axis=1)[:, :k]
    rows = np.arange(len(v))[:, None]
    return part[rows, np.lexsort((part, close[rows, part]))].astype(np.int32)


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component) for each row of df: linked rows, and the smallest id reachable by links.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do rows without an id.
    Vectors of different lengths don't link; equal vectors do. Rows that repeat, or share an id, count as vectors of their own.
    """
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zeros
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(good & F.col("id").isNotNull(), F.lit(False)), F.col("v")))
    rows = stored(rows.withColumn("a", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("check", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))), "vectors")
    distinct = rows.where("v is not null").groupBy("a", "check").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = stored(distinct, "distinct")
    want = min(MAX_PIVOTS, max(32, int(2 * distinct.count() ** 0.5)))
    sample = distinct.orderBy(F.xxhash64("least"), "a").limit(SAMPLE * want).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    sizes = np.array(sample.value_lengths())
    dim = int(np.bincount(sizes).argmax())
    pivots = choose(normal(vectors_of(sample.filter(pa.array(sizes == dim)), dim)), want)

    listed = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), ("near", pa.binary()), ("v", pa.list_(pa.float64()))])

    def describe(it):
        for b in it:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                sizes = np.array(part.column(2).value_lengths())
                for d in np.unique(sizes):
                    own = part.filter(pa.array(sizes == d))
                    near = permutations(normal(vectors_of(own.column(2), int(d))), of_length(pivots, int(d)))
                    for k in range(min(POSTED, near.shape[1])):
                        yield record(listed, (int(d) << 16) + near[:, k].astype(np.int64), own.column(0), own.column(1), [x.tobytes() for x in near], own.column(2))

    kinds = "key long, a long, n long, near binary, v array<double>"
    posts = stored(distinct.select("a", "n", "v").mapInArrow(describe, kinds), "posts")
    lists = stored(posts.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumn("n", F.col("size")), "lists")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("a", "key"), F.col("blocks")).cast("int")
    dealt = (
        split_join(posts.withColumnRenamed("n", "copies"), lists, ["key"])
        .withColumn("blocks", blocks)
        .select("key", "a", "copies", "near", "v", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "a", "copies", "near", "v")
        .repartition("key", "x", "y")
        .sortWithinPartitions("key", "x", "y")
    )
    found = stored(dealt.mapInArrow(lambda it: verify(it, threshold), "a long, b long, n long"), "links")
    degree = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("linked"))
    label = components(found.where("b is not null")).withColumnRenamed("node", "a")
    named = label.join(distinct.select("a", "least"), "a")
    low = named.groupBy("label").agg(F.min("least").alias("component"))
    by_node = label.join(low, "label").select("a", "component")
    by_vector = distinct.drop("v").join(degree, "a", "left").join(by_node, "a", "left")
    by_vector = by_vector.select("a", "check", "n", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component"))
    out = split_join(rows.select("id", "a", "check"), stored(by_vector, "classes"), ["a", "check"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def shared_counts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many pivots each of the left permutations shares with each of the right ones."""
    codes = np.unique(np.concatenate([left.ravel(), right.ravel()]), return_inverse=True)[1]
    member = np.zeros((len(left) + len(right), codes.max() + 1), np.float32)
    member[np.repeat(np.arange(len(member)), left.shape[1]), codes] = 1
    return member[: len(left)] @ member[len(left) :].T


def verify(it, threshold: float):
    """Links and degrees of the pairs in each list or pair of blocks, sorted by them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def group(cols):
        key, x, y, mine, ids, n, near, v = cols
        v = normal(v)
        least = min(SHARED, near.shape[1])
        left, right = (np.flatnonzero(mine == k) for k in (x[0], y[0]))
        degree, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for lo in range(0, len(left), 500):
            i, j = np.nonzero(shared_counts(near[left[lo : lo + 500]], near[right]) >= least)
            i, j = left[lo + i], right[j]
            if x[0] == y[0]:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 20_000):
                a, b = i[at : at + 20_000], j[at : at + 20_000]
                close = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
                a, b = a[close], b[close]
                # the smallest pivot that both are posted to is the list's own
                common = near[a][:, :POSTED, None] == near[b][:, None, :POSTED]
                first = np.where(common.any(2), near[a][:, :POSTED], 1 << 30).min(1, initial=1 << 30)
                a, b = a[first == key[0] & 0xFFFF], b[first == key[0] & 0xFFFF]
                np.add.at(degree, a, n[b])
                np.add.at(degree, b, n[a])
                forest.join(a, b)
        linked, under = np.flatnonzero(degree), np.flatnonzero(forest.top != np.arange(len(ids)))
        one = ([*ids[under], *ids[linked]], [*ids[forest.top[under]], *[None] * len(linked)], [*[None] * len(under), *degree[linked]])
        return one if len(linked) else None

    held, names = [], None
    for b in it:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in range(6)]
        cuts = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
        out = []
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            near = np.frombuffer(b"".join(b.column(6).slice(lo, hi - lo).to_pylist()), np.int32).reshape(hi - lo, -1)
            part = [*(c[lo:hi] for c in cols), near, vectors_of(b.column(7).slice(lo, hi - lo), int(cols[0][lo] >> 16))]
            name = (part[0][0], part[1][0], part[2][0])
            if held and name != names:
                out.append(group([np.concatenate(c) for c in zip(*held)]))
                held = []
            held.append(part)
            names = name
        rows = [sum((list(o[k]) for o in out if o), []) for k in range(3)]
        if rows[0]:
            yield record(schema, *rows)
    if held and (one := group([np.concatenate(c) for c in zip(*held)])):
        yield record(schema, *one)
