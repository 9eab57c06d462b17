"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

A document's ids are cut into full sequences and a rest. Rests of a group go, largest first, into the first open sequence
with room, found in a tournament tree over free capacities. Gaps that remain are then filled by cutting the emptiest
sequences, so that all of a group's sequences but one are full; that one is cut at powers of two, which need no padding.

Groups are formed inside each input split: the hash of doc_id deals its documents over a few open groups, and a group is
packed when it holds group_tokens. Nothing is shuffled; a lost task repeats with the same result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import as_bytes, batches, record
from .tokens import Encoder

LENGTH = 4096
OPEN_GROUPS = 4
GROUP_TOKENS = 1_000_000


class Tournament:
    """Free capacities of bins as leaves; every inner node holds the larger of its two children."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin with room for size."""
        node, best = 1, self.best
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        return node - self.leaves

    def take(self, place: int, size: int) -> None:
        node, best = place + self.leaves, self.best
        best[node] -= size
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])


def pack_group(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, size). Every id of every document lies in exactly one piece."""
    full = [[(i, s, length)] for i, n in enumerate(lengths) for s in range(0, n - length + 1, length)]
    rests = sorted(((n % length, i) for i, n in enumerate(lengths) if n % length), key=lambda x: (-x[0], x[1]))
    if not rests:
        return full
    tree, bins = Tournament(len(rests), length), {}
    for size, i in rests:
        place = tree.first(size)
        tree.take(place, size)
        bins.setdefault(place, []).append((i, lengths[i] - size, size))
    order = sorted(bins.values(), key=lambda b: -sum(p[2] for p in b))
    used = [sum(p[2] for p in b) for b in order]
    i, j = 0, len(order) - 1
    while i < j:
        room = length - used[i]
        if not room:
            i += 1
            continue
        doc, start, size = order[j].pop()
        if size > room:
            order[j].append((doc, start, size - room))
            start, size = start + size - room, room
        order[i].append((doc, start, size))
        used[i] += size
        used[j] -= size
        if not used[j]:
            j -= 1
    last, order = order[j], [*order[:j]]
    left = sum(p[2] for p in last)
    for bit in range(length.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            want, part = 1 << bit, []
            while want:
                doc, start, size = last.pop()
                if size > want:
                    last.append((doc, start, size - want))
                    start, size = start + size - want, want
                part.append((doc, start, size))
                want -= size
            order.append(part)
    return full + order


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, group_tokens: int = GROUP_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, its ids.

    Null and empty texts are documents of the end id alone. A null id, or one that repeats, is packed row by row.
    """
    kinds = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]
    schema = pa.schema([pa.field(k, pa.int64()) for k, _ in kinds] + [pa.field("ids", pa.list_(pa.int32()))] * with_ids)

    def run(it):
        encoder, made, base = Encoder(tokenizer), 0, TaskContext.get().partitionId() << 32
        groups = [[[], [], 0] for _ in range(OPEN_GROUPS)]

        def flush(group):
            nonlocal made
            ids, tokens, _ = group
            rows, cut = [], []
            for seq in pack_group([len(t) for t in tokens], length):
                at = 0
                for doc, start, size in seq:
                    piece = tokens[doc][start : start + size]
                    rows.append((ids[doc], start, size, zlib.crc32(piece.astype("<u4").tobytes()), len(tokens[doc]), base + made, at))
                    if with_ids:
                        cut.append(piece.astype(np.int32))
                    at += size
                made += 1
            group[:] = [], [], 0
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cut)]), pa.int32()), pa.array(np.concatenate(cut))))
            return record(schema, *cols)

        for ids, texts in batches(it):
            for lo in range(0, len(ids), 500):
                part = ids[lo : lo + 500].to_pylist()
                for i, t in zip(part, encoder.encode(texts[lo : lo + 500])):
                    group = groups[zlib.crc32(str(i).encode()) % OPEN_GROUPS]
                    group[0].append(i)
                    group[1].append(t)
                    group[2] += len(t)
                    if group[2] >= group_tokens:
                        yield flush(group)
        rest = [sum((g[k] for g in groups), [] if k < 2 else 0) for k in range(3)]
        if rest[0]:
            yield flush(rest)

    return as_bytes(docs, id_col, text_col).mapInArrow(run, ", ".join(map(" ".join, kinds)) + ", ids array<int>" * with_ids)
