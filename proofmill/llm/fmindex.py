"""A compressed full-text index over word sequences: Burrows-Wheeler transform in a wavelet matrix, searched in lockstep."""

from __future__ import annotations

import numpy as np


BLOCK = 64


class FMIndex:
    """Indexes sequences of codes >= 1; every sequence belongs to a document, an integer.

    Suffixes are sorted to depth codes, so patterns may be as long as that. One bit vector with rank counts per level
    stands for the transform; minima up to and from each place of a block of BLOCK suffixes, and a table of minima over runs
    of whole blocks, tell the smallest document a pattern occurs in: some 20 bytes a word in all.
    """

    def __init__(self, sequences: list[np.ndarray], docs: np.ndarray, depth: int) -> None:
        sizes = np.array([len(s) + 1 for s in sequences])
        text = np.zeros(int(sizes.sum()), np.int64)
        ends = np.cumsum(sizes)
        inner = np.ones(len(text), bool)
        inner[ends - 1] = False
        text[inner] = np.concatenate(sequences)
        n, rank, h = len(text), text, 1
        while h < depth:
            key = rank * (n + 2)
            key[: n - h] += rank[h:] + 1
            distinct, rank = np.unique(key, return_inverse=True)
            if len(distinct) == n:
                break
            h *= 2
        order = np.argsort(rank, kind="stable")
        bwt = text[order - 1]
        self.n, top = n, int(text.max())
        self.levels = max(1, top.bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bits, self.ranks, self.zeros, codes = [], [], [], bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (codes >> level & 1).astype(bool)
            words = np.zeros(n // 64 + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint32)])[:-1].astype(np.uint32))
            self.zeros.append(int(n - bit.sum()))
            codes = np.concatenate([codes[~bit], codes[bit]])
        self.first = np.zeros(top + 1, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        self.first[codes[starts]] = starts
        self.owner = np.repeat(docs, sizes)[order]
        blocks = np.full(-(-n // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        blocks[:n] = self.owner
        blocks = blocks.reshape(-1, BLOCK)
        self.upto = np.minimum.accumulate(blocks, 1).ravel()
        self.since = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        self.least = [blocks.min(1)]
        while 2 << (len(self.least) - 1) <= len(blocks):
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))

    def step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with code c before the suffixes of [low, high)."""
        at, code = np.concatenate([low, high]), np.concatenate([c, c])
        for k in range(self.levels):
            word = at >> 6
            ones = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(code >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        at += self.before[code] - self.first[code]
        return at[: len(c)], at[len(c) :]

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document over suffixes [low, high), which are not empty."""
        a, b = low // BLOCK, (high - 1) // BLOCK
        out = np.minimum(self.since[low], self.upto[high - 1])
        # whole blocks between the two at the ends
        wide = np.flatnonzero(b - a > 1)
        level = np.frexp((b[wide] - a[wide] - 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            m = wide[level == k]
            inner = np.minimum(self.least[k][a[m] + 1], self.least[k][b[m] - (1 << int(k))])
            out[m] = np.minimum(out[m], inner)
        # ranges inside one block are read
        lane = np.flatnonzero(a == b)
        out[lane], at = self.owner[low[lane]], low[lane] + 1
        while len(lane := lane[more := at < high[lane]]):
            at = at[more]
            out[lane] = np.minimum(out[lane], self.owner[at])
            at = at + 1
        return out

    def extend(self, codes: np.ndarray, base: np.ndarray, end: np.ndarray, stop: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Backward search, all lanes at once: from position end down to stop at most, for as long as the match occurs in a
        document smaller than doc. Returns the first position of each match (end + 1: none). Lane i's codes begin at base[i].
        """
        reached = end + 1
        lane = np.flatnonzero(reached > stop)
        low, high = np.zeros(len(lane), np.int64), np.full(len(lane), self.n, np.int64)
        while len(lane):
            low, high = self.step(codes[base[lane] + reached[lane] - 1], low, high)
            some = np.flatnonzero(low < high)
            some = some[self.smallest(low[some], high[some]) < doc[lane[some]]]
            lane, low, high = lane[some], low[some], high[some]
            reached[lane] -= 1
            on = reached[lane] > stop[lane]
            if not on.all():
                lane, low, high = lane[on], low[on], high[on]
        return reached


def repeated_windows(index: FMIndex, codes: np.ndarray, base: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(lane, first, last) window starts of width codes that occur in documents smaller than the lane's.

    The longest match that ends at the last position is extended backwards. Where it stops, at f, windows that begin at f
    or before are searched each by itself. They are taken width starts at a time: such windows share the positions from the
    last of these starts to the end of the first window, and lanes without a match of these have none of the windows.
    """
    out = []
    lane, end = np.arange(len(base)), size - 1
    reached = index.extend(codes, base, end, np.zeros(len(base), np.int64), doc)
    some = np.flatnonzero(reached <= end - width + 1)
    out += zip(some.tolist(), reached[some].tolist(), (end - width + 1)[some].tolist())
    final = np.minimum(reached - 1, size - width - 1)  # the last window is known
    searched = []
    for low in range(0, int(final.max(initial=-1)) + 1, width):
        lane = np.flatnonzero(final >= low)
        high = np.full(len(lane), low + width - 1)
        at = np.minimum(final[lane], high)
        near = index.extend(codes, base[lane], high, at, doc[lane]) <= at
        searched.append((lane[near], np.full(near.sum(), low), at[near] - low + 1))
    for own, low, n in (tuple(x[k : k + 20_000] for x in part) for part in searched for k in range(0, len(part[0]), 20_000)):
        each = np.repeat(own, n)
        start = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        good = index.extend(codes, base[each], start + width - 1, start, doc[each]) == start
        each, start = each[good], start[good]
        if not len(each):
            continue
        first = np.flatnonzero(np.concatenate([[True], (each[1:] != each[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.append(first[1:], len(each)) - 1
        out += zip(each[first].tolist(), start[first].tolist(), start[last].tolist())
    return out
