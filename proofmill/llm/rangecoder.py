"""Adaptive context-mixing range coder for token ids: many blocks at once, each with a state of its own.

A block predicts its next id in three ways. Order 2 and order 1: the id that last followed the two ids, or the one id,
before it, with a confidence from 0 to 3. Order 0: how often each id occurs, from a table that all blocks of a file start
with. The three are mixed: an id's share is that of order 0 times what the others leave, and more for the ids that order 1
and order 2 name. Their weights are adaptive frequencies of being right, chosen by both confidences. The mixture drives one
step of a range coder with 36-bit probabilities; a range of up to 60 bits is renewed in 20-bit digits, with carries settled
at the end; two digits are stored as five bytes. A step of 36 bits at most gives two digits at most.

Blocks start afresh and have equal lengths (padded), so numpy takes a step of all of them in each operation. Inside, ids are
numbered by their place among the file's distinct ids, so ids of any size may occur.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
ONE, DIGIT, FLOOR, MASK, TOP = 36, 20, 1 << 40, (1 << 40) - 1, 40
SLOTS1, SLOTS2 = 4096, 8192
#: Steps of the encoder for which places in tables and intervals are reckoned together.
AHEAD = 16
#: Ids below this are looked up in a table of their numbers.
DENSE = 1 << 22
#: What the two ids before a place, and the one, are multiplied by for their slots.
HASH = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B1
#: Parts of a weight, and of an order-0 share.
WEIGHT, SHARES = 12, 24
#: Counts are kept as steps of an eighth of a power of two.
STEPS = [int(16 * 2 ** (k / 8)) for k in range(256)]
#: What an entry grows by: its confidence (0 to 3) where its id was wrong, then where it was right. Wrong below 2, it is replaced.
GROW = np.array([0, 0, -2, -2, 1, 1, 1, 0])
WEIGHTS = np.arange(1 << WEIGHT, dtype=np.int32)
DOWN = WEIGHTS - (WEIGHTS - 32 >> 5)
#: The next weight, from the present one: of order 2 when wrong and right, of order 1 when wrong, right and not asked. KINDS:
#: which of them, by whether order 2 and order 1 were right.
KINDS = np.array([[0, 0, 1, 1], [2, 3, 4, 4]]) << WEIGHT
NEXT = np.concatenate([DOWN, WEIGHTS + (4064 - WEIGHTS >> 5), DOWN, WEIGHTS + (4000 - WEIGHTS >> 5), WEIGHTS])


class Order0:
    """Shares of a file's distinct ids, out of 2**SHARES, from their counts in steps."""

    def __init__(self, ids: np.ndarray, steps: np.ndarray) -> None:
        self.ids, self.steps = ids.astype(np.uint32), steps.astype(np.uint8)
        count = np.array(STEPS, np.int64)[self.steps]
        share = 1 + count * ((1 << SHARES) - len(ids)) // max(1, int(count.sum()))
        share[share.argmax()] += (1 << SHARES) - share.sum()
        self.share, self.before = share, np.cumsum(share) - share

    @classmethod
    def of(cls, flat: np.ndarray) -> Order0:
        if flat.max() < DENSE:
            n = np.bincount(flat.ravel())
            ids = np.flatnonzero(n)
            n = n[ids]
        else:
            ids, n = np.unique(flat, return_counts=True)
        return cls(ids, np.minimum(np.rint(8 * np.log2(n)), 255))

    def symbols(self, flat: np.ndarray) -> np.ndarray:
        if self.ids[-1] >= DENSE:
            return np.searchsorted(self.ids, flat).astype(np.int32)
        number = np.zeros(int(self.ids[-1]) + 1, np.int32)
        number[self.ids] = np.arange(len(self.ids))
        return number[flat]

    def holders(self) -> np.ndarray:
        """The symbol whose share holds each place."""
        return np.repeat(np.arange(len(self.ids), dtype=np.uint16 if len(self.ids) <= 1 << 16 else np.int32), self.share)


class Model:
    """Rows of two are order 2, then order 1. Every array of a step is made once: new ones would drive tables out of the cache."""

    def __init__(self, lanes: int, symbols: int) -> None:
        lane, self.kind = np.arange(lanes), np.uint16 if symbols <= 1 << 14 else np.uint32
        self.table, self.grow = np.zeros(lanes * (SLOTS1 + SLOTS2), self.kind), GROW.astype(self.kind)
        self.base = np.stack([lane, lanes * SLOTS2 + lane])  # a slot of all lanes lies together: few are used often
        start = np.array([32, 1024, 2048, 3072], np.int32)
        self.weights = np.concatenate([np.tile(np.repeat(start, 4), lanes), np.tile(np.tile(start, 4), lanes)])
        self.place = np.stack([lane * 16, (lanes + lane) * 16])
        self.sure, self.grown = np.empty((2, 2, lanes), self.kind)
        self.weight = np.empty((2, lanes), np.int32)
        self.at, self.code, self.change = np.empty((3, 2, lanes), np.int64)
        self.wrong = np.empty((2, lanes), bool)

    def predict(self, slots: np.ndarray, entry: np.ndarray, named: np.ndarray, q: np.ndarray) -> None:
        """Fills in entries, the symbols that they name and their weights, as yet each out of 2**WEIGHT."""
        self.table.take(slots, out=entry, mode="clip")
        np.bitwise_and(entry, 3, out=self.sure)
        np.right_shift(entry, 2, out=named)
        code = self.code[0]
        np.left_shift(self.sure[0], 2, out=code)
        code += self.sure[1]
        np.add(self.place, code, out=self.at)
        self.weights.take(self.at, out=q, mode="clip")

    def update(self, slots: np.ndarray, entry: np.ndarray, q: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> None:
        """Entries and weights after a symbol, whose new entry is fresh; hit tells who named it."""
        np.multiply(hit, 4, out=self.code)
        self.code += self.sure
        self.grow.take(self.code, out=self.grown, mode="clip")
        self.grown += entry
        np.less(self.code, 2, out=self.wrong)
        np.copyto(self.grown, fresh, where=self.wrong)
        self.table[slots] = self.grown
        kind = self.code[0]
        np.multiply(hit[0], 2, out=kind)
        kind += hit[1]
        KINDS.take(kind, axis=1, out=self.change, mode="clip")
        self.change += q
        NEXT.take(self.change, out=self.weight, mode="clip")
        self.weights[self.at] = self.weight


def shares(q: np.ndarray, g: np.ndarray, rest: np.ndarray) -> None:
    """From weights (rows of two in the last axis but one): what order 2 and order 1 add (g, of 2**36), and what order 0 keeps."""
    two, one = g[..., 0, :], g[..., 1, :]
    np.subtract(1 << WEIGHT, q[..., 0, :], out=rest)
    np.multiply(rest, q[..., 1, :], out=one)
    np.right_shift(one, WEIGHT, out=one)
    np.subtract(rest, one, out=rest)
    np.copyto(two, q[..., 0, :])
    np.left_shift(g, SHARES, out=g)


def encode(ids: np.ndarray, order0: Order0) -> list[bytes]:
    """The code of each row of ids (blocks x length), all of which order0 knows."""
    return encode_files([(ids, order0)])[0]


def encode_files(parts: list[tuple[np.ndarray, Order0]]) -> list[list[bytes]]:
    """What encode() gives for each of several files with blocks of one length: a step is taken of the blocks of all."""
    n, blocks, symbols = parts[0][0].shape[1], [len(ids) for ids, _ in parts], [len(o.ids) for _, o in parts]
    lanes, firsts = sum(blocks), np.cumsum([0, *blocks])
    model, steps = Model(lanes, max(symbols)), np.zeros((n + 2, lanes), np.int32)
    for (ids, o), a, b in zip(parts, firsts, firsts[1:]):
        steps[2:, a:b] = o.symbols(ids).T
    # the tables of the files, one after the other, and where each lane's begin
    before, share = np.concatenate([o.before for _, o in parts]), np.concatenate([o.share for _, o in parts])
    table_at = np.repeat(np.cumsum([0, *symbols[:-1]]), blocks)
    low, size = np.zeros(lanes, np.int64), np.full(lanes, 1 << 60)
    digits, lane = np.zeros((2 * n + 8, lanes), np.uint32), np.arange(lanes)
    flat, place = digits.reshape(-1), lane.copy()
    named, q = np.empty((2, AHEAD, 2, lanes), np.int32)
    entry = np.empty((AHEAD, 2, lanes), model.kind)
    hit = np.empty((AHEAD, 2, lanes), bool)
    g, some = np.empty((2, AHEAD, 2, lanes), np.int64)
    rest, cum, freq = np.empty((3, AHEAD, lanes), np.int64)
    top, small, bits, r = np.empty((4, lanes), np.int64)
    digit, few = np.empty(lanes, np.uint32), np.empty(lanes, bool)
    for lo in range(0, n, AHEAD):
        x = steps[lo + 2 : lo + 2 + AHEAD]
        m = len(x)
        a, b = steps[lo : lo + m].view(np.uint32), steps[lo + 1 : lo + 1 + m].view(np.uint32)
        slots = np.stack([(a * HASH[0] ^ b * HASH[1]) >> 19, b * HASH[2] >> 20], 1).astype(np.int64) * lanes + model.base
        fresh = (x * 4 + 1).astype(model.kind)
        # what the orders name doesn't depend on the code, so the intervals of several steps are reckoned together
        for k in range(m):
            model.predict(slots[k], entry[k], named[k], q[k])
            np.equal(named[k], x[k], out=hit[k])
            model.update(slots[k], entry[k], q[k], hit[k], fresh[k])
        shares(q[:m], g[:m], rest[:m])
        before.take(x + table_at, out=cum[:m], mode="clip")
        share.take(x + table_at, out=freq[:m], mode="clip")
        cum *= rest
        freq *= rest
        np.multiply(g[:m], named[:m] < x[:, None], out=some[:m])
        cum += some[:, 0]
        cum += some[:, 1]
        g *= hit
        freq += g[:, 0]
        freq += g[:, 1]
        for k in range(m):
            np.right_shift(size, ONE, out=r)
            np.multiply(r, cum[k], out=top)
            low += top
            np.multiply(r, freq[k], out=size)
            while True:  # each lane's next digit is written, and written over as long as it isn't settled
                np.right_shift(low, TOP, out=top)
                np.copyto(digit, top, casting="unsafe")
                flat[place] = digit
                np.less(size, FLOOR, out=few)
                np.copyto(small, few)
                np.left_shift(top, TOP, out=top)
                top *= small
                low -= top
                np.multiply(small, DIGIT, out=bits)
                low <<= bits
                size <<= bits
                small *= lanes
                place += small
                if size.min() >= FLOOR:
                    break
    for _ in range(3):
        flat[place] = low >> TOP
        place += lanes
        low = (low & MASK) << DIGIT
    used = place // lanes
    digits = np.ascontiguousarray(digits[: used.max() + used.max() % 2].T)
    while (over := digits >> np.uint32(20)).any():  # carries
        digits &= np.uint32(0xFFFFF)
        digits[:, :-1] += over[:, 1:]
    pairs = (digits[:, ::2].astype(np.uint64) | digits[:, 1::2].astype(np.uint64) << U(DIGIT)).astype("<u8")
    packed = np.ascontiguousarray(pairs.view(np.uint8).reshape(lanes, -1, 8)[:, :, :5]).reshape(lanes, -1)
    made = [p[: (5 * k + 1) // 2].tobytes() for p, k in zip(packed, used)]
    return [made[a:b] for a, b in zip(firsts, firsts[1:])]


def decode(codes: list[bytes], n: int, order0: Order0) -> np.ndarray:
    """The ids of blocks of length n."""
    return decode_files([(codes, n, order0)])[0]


def decode_files(parts: list[tuple[list[bytes], int, Order0]]) -> list[np.ndarray]:
    """What decode() gives for each of several files: the blocks of all are taken step by step together."""
    codes, n, blocks = [c for p in parts for c in p[0]], max(p[1] for p in parts), [len(p[0]) for p in parts]
    lanes, symbols = len(codes), [len(p[2].ids) for p in parts]
    model, out = Model(lanes, max(symbols)), np.zeros((n + 2, lanes), np.int32)
    packed = np.zeros((lanes, max(len(c) for c in codes) // 5 + 8, 8), np.uint8)
    for p, c in zip(packed, codes):
        p[:, :5] = np.frombuffer(c.ljust(5 * len(p), b"\0"), np.uint8).reshape(-1, 5)
    pairs = packed.view("<u8")[:, :, 0].T.astype(np.int64)
    digits = np.stack([pairs & (1 << DIGIT) - 1, pairs >> DIGIT], 1).reshape(-1).astype(np.int32)
    place, size, value = 3 * lanes + np.arange(lanes), np.full(lanes, 1 << 60), np.zeros(lanes, np.int64)
    for k in range(3):
        value = value << DIGIT | digits[k * lanes : (k + 1) * lanes]
    # the tables of the files, one after the other, and where each lane's begin
    table = np.stack([np.concatenate([p[2].before for p in parts]), np.concatenate([p[2].share for p in parts])])
    holders = np.concatenate([p[2].holders() for p in parts])
    table_at = np.repeat(np.cumsum([0, *symbols[:-1]]), blocks).astype(np.int32)
    holders_at = np.repeat(np.arange(len(parts)) << SHARES, blocks)
    # of what is reckoned for order 2, order 1 and, in a third row, order 0, the row is taken that holds the code
    named_, lane = np.empty((3, lanes), np.int32), np.arange(lanes)
    bounds_ = np.empty((2, 3, lanes), np.int64)
    named, bounds, symbol, symbol_bounds = named_[:2], bounds_[:, :2], named_[2], bounds_[:, 2]
    first, own, cum, freq = *bounds, *symbol_bounds
    g, some, slots = np.empty((3, 2, lanes), np.int64)
    r, v, u, rest, row, small = np.empty((6, lanes), np.int64)
    entry, q = np.empty((2, lanes), model.kind), np.empty((2, lanes), np.int32)
    past, inside = np.empty((2, 2, lanes), bool)
    less, few = np.empty((2, lanes), bool)
    ratio, more, held = np.empty(lanes), np.empty(lanes, np.int32), np.empty(lanes, holders.dtype)
    fresh, asked = np.empty(lanes, model.kind), np.empty((2, lanes), np.int32)
    two, one, ahead = np.zeros((3, lanes), np.uint32)  # the last ids' parts of the next hashes
    for t in range(n):
        np.bitwise_xor(ahead, two, out=ahead)
        np.right_shift(ahead, 19, out=slots[0])
        np.right_shift(one, 20, out=slots[1])
        slots *= lanes
        slots += model.base
        model.predict(slots, entry, named, q)
        shares(q, g, rest)
        np.add(named, table_at, out=asked)
        table.take(asked, axis=1, out=bounds, mode="clip")
        bounds *= rest
        own += g
        np.less(named[1], named[0], out=less)
        np.multiply(g[1], less, out=u)
        first[0] += u
        np.less(named[0], named[1], out=less)
        np.multiply(g[0], less, out=u)
        first[1] += u
        np.equal(named[0], named[1], out=less)
        np.multiply(g[::-1], less, out=some)  # both weights lie on one symbol
        own += some
        np.right_shift(size, ONE, out=r)
        np.floor_divide(value.view(U), r.view(U), out=v.view(U))
        np.minimum(v, (1 << ONE) - 1, out=v)
        np.subtract(v, first, out=some)
        np.greater_equal(some, 0, out=past)
        np.less(some.view(U), own.view(U), out=inside)
        np.multiply(g, past, out=some)
        gone = some[0]
        gone += some[1]
        v -= gone
        np.divide(v, rest, out=ratio)  # below 2**53, so the whole part is right; in a named symbol's interval it isn't used
        np.copyto(u, ratio, casting="unsafe")
        u += holders_at
        holders.take(u, out=held, mode="clip")
        np.copyto(symbol, held)
        np.add(symbol, table_at, out=more)
        table.take(more, axis=1, out=symbol_bounds, mode="clip")
        symbol_bounds *= rest
        cum += gone
        np.subtract(2, inside[1], out=row)
        np.logical_not(inside[0], out=less)
        row *= less
        row *= lanes
        row += lane
        found = out[t + 2]
        named_.take(row, out=found, mode="clip")
        bounds_[0].take(row, out=u, mode="clip")
        bounds_[1].take(row, out=v, mode="clip")
        u *= r
        value -= u
        np.multiply(r, v, out=size)
        while True:
            np.less(size, FLOOR, out=few)
            np.copyto(small, few)
            digits.take(place, out=more, mode="clip")
            more *= few
            np.multiply(small, DIGIT, out=u)
            value <<= u
            value |= more
            size <<= u
            small *= lanes
            place += small
            if size.min() >= FLOOR:
                break
        np.multiply(found, 4, out=fresh, casting="unsafe")
        fresh += 1
        model.update(slots, entry, q, inside, fresh)
        word = found.view(np.uint32)
        np.multiply(word, HASH[1], out=two)
        np.multiply(word, HASH[2], out=one)
        np.multiply(out[t + 1].view(np.uint32), HASH[0], out=ahead)
    firsts = np.cumsum([0, *blocks])
    return [o.ids[out[2 : length + 2, a:b]].T for (_, length, o), a, b in zip(parts, firsts, firsts[1:])]
