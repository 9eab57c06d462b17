"""Byte-level BPE by longest matches and backtracking, with the ids that merging in order of rank would give.

A sequence of tokens is what the merges give if and only if each two tokens that touch are what the merges give for their
bytes: then no merge crosses a border. So a piece is encoded from left to right. At each place the longest token of the
vocabulary is tried first (an Aho-Corasick automaton finds them all in one pass over the bytes, read as Latin-1), then the
tokens that are its prefixes; a token stays if it is compatible with the one before, which is remembered for each pair.
Where none fits, the place is dead, the last token is taken back, and no dead place is entered again: every place is tried
once, whatever the piece's length.

Null texts are empty ones: no ids, no bytes. Ids may be null or repeat, rows are encoded one by one, other columns are not
read. Very long texts, also without white space, take time and memory in proportion to their length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, ragged, record
from .tokens import Ids

#: What a worker remembers before it forgets it all: chunks, their bytes, pieces, pairs of tokens. Together some 100 MB.
MAX_CHUNKS, MAX_BYTES, MAX_PIECES, MAX_PAIRS = 200_000, 20_000_000, 200_000, 200_000
#: Bytes of text, or of new pieces, that are taken at once: a text or piece that is longer goes alone.
AT_ONCE = 1_000_000

#: Code points that the regex package, by a later Unicode version, takes for letters or numbers and the
#: pattern engine of the tiktoken library doesn't. A test compares the two over all code points.
LATER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Ends a piece in the automaton's input: no byte read as Latin-1.
APART = "\u0100"
#: Stands for them when a text is cut: neither letter nor number nor white space.
OTHER = "\ue000"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def ranks_of(path: str | None) -> dict[bytes, int]:
    with open(path or default_path(), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(1)
def tokens_of(path: str | None) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks_of(path).items()}


class Vocabulary:
    """The tokens of a rank file, with what the search needs to know of them."""

    def __init__(self, path: str | None = None) -> None:
        import ahocorasick

        ranks = ranks_of(path)
        self.rank, self.token = ranks, {r: t for t, r in ranks.items()}
        single = {r for t, r in ranks.items() if len(t) == 1}
        if len(single) != 256 or max(single) != 255:
            raise ValueError("the single bytes must have the ranks 0 to 255")
        self.size = [0] * (max(self.token) + 1)
        #: the longest token that begins a token and isn't the whole of it, or -1
        self.shorter = [-1] * len(self.size)
        #: the two tokens whose merge makes a token, and the way back
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for rank, token in sorted(self.token.items()):
            self.size[rank] = len(token)
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), rank)
        for rank, token in sorted(self.token.items()):
            self.shorter[rank] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
            if len(token) > 1:
                self.parts[rank] = pair = self.made_of(rank, token)
                self.merged[pair] = rank
        self.automaton.make_automaton()
        self.known.clear()
        self.sizes, self.single = np.array(self.size), np.array([ranks[bytes([b])] for b in range(256)])

    def made_of(self, rank: int, token: bytes) -> tuple[int, int]:
        """The pair that merges of lower rank leave of a token, so that its own merge is the last."""
        for k in range(len(token) - 1, 0, -1):
            left, right = self.rank.get(token[:k], rank), self.rank.get(token[k:], rank)
            if left < rank and right < rank and self.compatible(left, right):
                return left, right
        raise ValueError(f"merges don't lead to the token {token!r}")

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are merged to just these two.

        The merges are undone from the last to the first, on whichever side it was. A pair across the border whose merge
        has a lower rank than one that is undone would have come first; of equal ranks the one further left comes first.
        """
        limit = len(self.size)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if max(left, right) < 256:
                return True
            if left > right:
                limit, left = left, self.parts[left][1]
            else:
                limit, right = right + 1, self.parts[right][0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece of text; no merge leaves a piece."""
        return [ids for lo, hi in slices(pieces) for ids in self.encode_some(pieces[lo:hi])]

    def encode_some(self, pieces: list[bytes]) -> list[list[int]]:
        joined = APART.join([p.decode("latin-1") for p in pieces]) + APART
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        codes = np.frombuffer(joined.encode("utf-16-le"), "<u2")
        longest = np.where(codes < 256, self.single[codes & 255], -1)  # single bytes aren't in the automaton
        longest[found[:, 0] + 1 - self.sizes[found[:, 1]]] = found[:, 1]  # ends rise, so the last token of a start is its longest
        longest, dead, start, out = longest.tolist(), bytearray(len(joined)), 0, []
        for piece in pieces:
            if (whole := self.rank.get(piece)) is not None:
                out.append([whole])
            else:
                out.append(self.backtrack(longest, dead, start))
            start += len(piece) + 1
        return out

    def backtrack(self, longest: list[int], dead: bytearray, at: int) -> list[int]:
        size, shorter, known = self.size, self.shorter, self.known
        out: list[int] = []
        token, last = longest[at], -1
        while token >= 0:
            end = at + size[token]
            if not dead[end]:
                if (fits := known.get((last, token))) is None:
                    if len(known) >= MAX_PAIRS:
                        known.clear()
                    fits = known[last, token] = last < 0 or self.compatible(last, token)
                if fits:
                    out.append(token)
                    at, last, token = end, token, longest[end]
                    continue
            while (token := shorter[token]) < 0:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
        return out


class Encoder:
    """Encodes texts; each distinct chunk of a task only once. A chunk is what stands between single spaces, and the pattern
    of the pieces never reaches across such a space: it begins a piece."""

    CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import regex

        self.vocabulary, self.later = Vocabulary(path), re.compile(f"[{LATER}]")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.clear()

    def clear(self, pieces: bool = True) -> None:
        self.chunks, self.of_chunks, self.held = Words(), Ids(), 0
        if pieces:
            self.pieces, self.of_pieces = Words(), Ids()
        #: chunks with white space at an end, by number: the space beside them needn't begin a piece
        self.loose = np.zeros(0, bool)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """ids of each text as unsigned 32-bit integers; null counts as empty."""
        if len(self.chunks.number) > MAX_CHUNKS or self.held > MAX_BYTES:
            self.clear(len(self.pieces.number) > MAX_PIECES or self.held > MAX_BYTES)
        plain = [(t or b"").decode("utf-8", "replace") for t in texts]
        numbers = [self.numbers(t.split(" ")) for t in plain]
        self.learn()
        if odd := [k for k, n in enumerate(numbers) if self.loose[n].any()]:
            for k in odd:
                numbers[k] = self.numbers(self.CUT.split(plain[k]))
            self.learn()
        return [self.of_chunks.get(n) for n in numbers]

    def numbers(self, chunks: list[str]) -> np.ndarray:
        chunks[0] = (chunks[0],)  # unlike the others it has no space before it
        return self.chunks.numbers(chunks)

    def learn(self) -> None:
        """Encodes new chunks: their pieces in one pass of the pattern, and of these the new ones."""
        if not (new := self.chunks.new()):
            return
        bare = [c[0] if isinstance(c, tuple) else c for c in new]
        self.loose = np.concatenate([self.loose, np.fromiter((not c or c != c.strip() for c in bare), bool, len(bare))])
        self.held += sum(map(len, bare))
        spaced = [c[0] if isinstance(c, tuple) else " " + c for c in new]
        firm = self.loose[-len(new) :] | np.fromiter((isinstance(c, tuple) for c in new), bool, len(new))
        counts, pieces = np.zeros(len(new), np.int64), []
        apart = np.flatnonzero(firm)  # these don't follow from a chunk before
        for k in apart:
            found = self.cut(spaced[k])
            counts[k] = len(found)
            pieces.append((k, found))
        rest = np.flatnonzero(~firm)
        run = self.cut("".join([spaced[k] for k in rest]))
        ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)))
        borders = np.searchsorted(ends, np.cumsum(np.fromiter((len(spaced[k]) for k in rest), np.int64, len(rest))), "right")
        counts[rest] = np.diff(borders, prepend=0)
        flat = [p for _, found in pieces for p in found] + run
        order = np.concatenate([apart, rest])
        at = np.cumsum(counts[order]) - counts[order]
        starts = np.empty(len(new), np.int64)
        starts[order] = at
        numbers = self.pieces.numbers(flat)[ragged(starts, counts)]
        if fresh := self.pieces.new():
            found = self.vocabulary.encode_pieces([p.encode() for p in fresh])
            self.of_pieces.add(np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        sizes = np.add.reduceat(np.append(self.of_pieces.size[numbers], 0), np.minimum(np.cumsum(counts) - counts, len(numbers))) if len(counts) else counts
        self.of_chunks.add(self.of_pieces.get(numbers), np.where(counts, sizes, 0))

    def cut(self, text: str) -> list[str]:
        """The pieces of a text, one after the other."""
        shape = text if text.isascii() else self.later.sub(OTHER, text)
        pieces = self.pattern.findall(shape)
        if shape != text:
            ends = np.cumsum([0, *map(len, pieces)])
            pieces = [text[a:b] for a, b in zip(ends[:-1], ends[1:])]
        return pieces


@lru_cache(1)
def encoder_of(path: str | None) -> Encoder:
    """One for a worker: what it remembers serves its next tasks."""
    return Encoder(path)


def slices(values: list[bytes | None], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of values with not much over most bytes."""
    return ranges([len(v or b"") for v in values], most)


def ranges(sizes: list[int | None], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for hi, size in enumerate(sizes, 1):
        held += size or 0
        if held >= most or hi == len(sizes):
            yield lo, hi
            lo, held = hi, 0


def parts(it: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Arrow batches in parts of some AT_ONCE bytes of a binary column, and that column's values."""
    for b in it:
        for lo, hi in ranges(pc.binary_length(b.column(column)).to_pylist()):
            part = b.slice(lo, hi - lo)
            yield part, part.column(column).to_pylist()


SCHEMA = "id long, n_tokens long, ids binary"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids as little-endian unsigned 32-bit integers) of each row, by the rank file at path on every machine.

    With decoded, also text: what the ids decode to, in the same pass.
    """
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())] + [("text", pa.binary())] * decoded)

    def run(it):
        encoder, token = encoder_of(path), tokens_of(path)
        for part, texts in parts(it, 1):
            found = encoder.encode(texts)
            ids = [x.astype("<u4").tobytes() for x in found]
            yield record(schema, part.column(0), [len(x) for x in found], ids, *[[plain(x, token) for x in ids]] * decoded)

    return as_bytes(docs, id_col, text_col).mapInArrow(run, SCHEMA + ", text binary" * decoded)


def plain(ids: bytes | None, token: dict[int, bytes]) -> bytes:
    return b"".join(map(token.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of encode() and what their ids decode to: text as bytes. Ids that the file hasn't got raise KeyError; null ids count as none."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text", pa.binary())])

    def run(it):
        token = tokens_of(path)
        for part, ids in parts(it, 2):
            yield record(schema, *part.columns, [plain(x, token) for x in ids])

    return encoded.select("id", "n_tokens", "ids").mapInArrow(run, SCHEMA + ", text binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The ids and bytes of each row as sha256."""
    return decoded.select("id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
