"""Shared plumbing of the training-data operators: shared-folder tables, Arrow batches, word tables."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import new_path, shared_dir, stored  # noqa: F401  the operators import them from here

#: Words of a task's dictionary before it is emptied: about 150 bytes each.
MAX_WORDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, n: int, key: str, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The n rows with the smallest hash h of key; ties stay in the order of all columns. made maps rows to what is kept of them.

    From large tables only rows below a hash bound, some 2 n of them, are mapped and sorted: what reaches one task doesn't
    grow. The bound rises until n rows lie below it, as ids that repeat need not spread.
    """
    space, total = 1 << 40, df.count()
    rows = df.withColumn("h", F.pmod(F.xxhash64(key), F.lit(space)))
    bound = space if total <= 8 * n else space * (2 * n + 200) // total
    while bound < space and rows.where(F.col("h") < bound).count() < n:
        bound *= 8
    kept = made(rows.where(F.col("h") < bound))
    return kept.orderBy("h", *(c for c in kept.columns if c != "h")).limit(n)


#: A key with over 1 in so many of a join's rows is a hot one; there are at most so many of them.
SHARE = 1024


def split_join(rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each key and n, how many rows have it.

    Rows of hot keys stay where they are and meet their at most SHARE rows of the table by broadcast; the others are shuffled.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * SHARE > total
    top = F.broadcast(table.where(hot).drop("n"))
    rest = rows.join(F.broadcast(table.where(hot).select(*key)), key, "left_anti").join(table.where(~hot).drop("n"), key, how)
    return rows.join(top, key).unionByName(rest)


def as_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: list | tuple = ()) -> DataFrame:
    """(id, text as UTF-8 bytes) and the columns in more: nothing else is read, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), *more)


def batches(it: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """ids and texts of each Arrow batch of as_bytes()."""
    for b in it:
        if b.num_rows:
            yield b.column(0), b.column(1).to_pylist()


def record(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)


class Words:
    """Numbers words as they come. The dictionary empties itself at MAX_WORDS, so memory stays bounded."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number = defaultdict(count().__next__)
        self.done = 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def new(self) -> list[bytes]:
        """Words numbered since the last call, in order."""
        n = len(self.number) - self.done
        out = list(islice(reversed(self.number), n))[::-1]
        self.done += n
        return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1 for every i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)
