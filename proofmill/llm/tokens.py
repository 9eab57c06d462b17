"""Token ids of whole texts, by a public tokenizer whose text is split at white space anyway."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import MAX_WORDS, Words, ragged

END = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Marks that may follow a word of letters and are then a pre-token of their own.
MARKS = b".,;:!?*&$%#|"


#: The steps before the merges of a tokenizer that leaves lower-case Latin letters between spaces as they are.
LOWERED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
)
#: Letters below this have neither parts to be composed nor doubtful classes.
LATIN = "\u0250"


#: Texts of which the words, in lower case, must have the same ids one by one as together.
PROBES = ("Ab  cd.", " Lead", "trail \n", "x\ty\r\nz", "MiXed CaSe, 12 ÉA it's!", "A\u000bB\u000cC don't")


def letters(word: bytes) -> bool:
    if word.isascii():
        return word.isalpha()
    s = word.decode("utf-8", "replace")
    return s.isalpha() and s.lower().isalpha()


def pieces(values: pa.Array) -> list[bytes]:
    """The bytes of strings without nulls."""
    if not len(values):
        return []
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    data = values.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class Ids:
    """The ids of numbered words, one after the other."""

    def __init__(self) -> None:
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.start = np.cumsum(self.size) - self.size

    def get(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[numbers], self.size[numbers])]

    def kept(self, numbers: np.ndarray) -> Ids:
        out = Ids()
        out.add(self.get(numbers), self.size[numbers])
        return out


class Encoder:
    """Encodes texts through the tokenizer once per distinct word; words that come once are forgotten when there are too many.

    Exact for tokenizers that drop white space and lower-case, as word_bpe_49k does: neither normalisation nor
    pre-tokenisation then looks across ASCII white space. Texts with the start of a special token keep their case. Other
    tokenizers, which PROBES tell, get whole texts.
    """

    def __init__(self, path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.last, self.bare = Tokenizer.from_file(path or default_path()), None, None
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            vocab = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
            steps = [json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
            if (steps[0], *steps[1].get("pretokenizers", ())) == LOWERED:
                self.bare = Tokenizer(self.tokenizer.model)
                self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = all(ids(p) == [i for w in p.lower().split() for i in ids(w)] for p in PROBES)
        self.clear()

    def clear(self) -> None:
        self.words, self.parts = Words(), Words()
        self.of_words, self.of_parts = Ids(), Ids()
        self.uses = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the words that came more than once since the last time, if they are not too many."""
        words, of_words, again = list(self.words.number), self.of_words, np.flatnonzero(self.uses > 1)
        self.clear()
        if len(again) <= MAX_WORDS // 2:
            self.words.numbers([words[i] for i in again])
            self.words.done, self.of_words, self.uses = len(again), of_words.kept(again), np.zeros(len(again), np.int64)

    def encode(self, texts: list[bytes | None] | pa.Array, end: int | None = END) -> list[np.ndarray]:
        """ids of each text as unsigned 32-bit integers, with the end id appended; null counts as empty."""
        if not self.by_word:
            some = texts.to_pylist() if isinstance(texts, pa.Array) else texts
            found = self.tokenizer.encode_batch_fast([(t or b"").decode("utf-8", "replace") for t in some], add_special_tokens=False)
            return [np.array(e.ids + ([] if end is None else [end]), np.uint32) for e in found]
        if len(self.words.number) > MAX_WORDS:
            self.forget()
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        given = texts.fill_null(b"").view(pa.string())
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(given, "<|"), given, pc.ascii_lower(given)))
        found = lists.flatten().dictionary_encode()  # there may be empty words at the ends of a text
        place = found.indices.to_numpy()
        number = self.words.numbers(pieces(found.dictionary))
        if new := self.words.new():
            self.learn(new)
        self.uses = np.concatenate([self.uses, np.zeros(len(self.words.number) - len(self.uses), np.int64)])
        self.uses[number] += np.bincount(place, minlength=len(number))
        numbers = number[place]
        flat, upto = self.of_words.get(numbers), np.concatenate([[0], np.cumsum(self.of_words.size[numbers])])
        words = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        tail = np.array([] if end is None else [end], np.uint32)
        return [np.concatenate([x, tail]) for x in np.split(flat, upto[words[1:-1]])] if len(texts) else []

    def learn(self, words: list[bytes]) -> None:
        """A word of letters before marks is two pre-tokens, each encoded once; any other word is one part."""
        cores = [w.rstrip(MARKS) for w in words]
        split = [c if c.isalpha() or not c.isascii() and letters(c) else w for c, w in zip(cores, words)]
        both = np.empty(2 * len(words), np.int32)
        both[::2] = self.parts.numbers(split)
        both[1::2] = self.parts.numbers([w[len(c) :] for c, w in zip(split, words)])
        if new := self.parts.new():
            self.of_parts.add(*self.encode_parts([p.decode("utf-8", "replace") for p in new]))
        size = self.of_parts.size[both].reshape(-1, 2).sum(1)
        self.of_words.add(self.of_parts.get(both), size)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and how many of each part. Parts of letters go to the tokenizer many in a text: each ends with its only end-of-word id.

        Where only the merges are left to do, they go to these alone.
        """
        run = lambda texts, by=self.tokenizer: [np.array(e.ids, np.uint32) for e in by.encode_batch_fast(texts, add_special_tokens=False)]
        size, found = np.full(len(parts), -1), []  # found: places of parts and their ids, one after the other
        plain = [i for i, p in enumerate(parts) if p.isalpha() and (p.isascii() or p.lower().isalpha())] if self.last is not None else []
        low = [i for i in plain if parts[i].islower() and max(parts[i]) < LATIN] if self.bare else []
        kinds = [(low, self.bare), (sorted({*plain} - {*low}), self.tokenizer)]
        for places, by in kinds:
            for lo in range(0, len(places), 50_000):
                some = places[lo : lo + 50_000]
                for k, ids in zip(range(0, len(some), 200), run([" ".join([parts[i] for i in some[k : k + 200]]) for k in range(0, len(some), 200)], by)):
                    ends = np.flatnonzero(self.last[ids]) + 1
                    if len(ends) == len(some[k : k + 200]):
                        size[some[k : k + 200]] = np.diff(ends, prepend=0)
                        found.append((some[k : k + 200], ids))
        rest = np.flatnonzero(size < 0).tolist()
        for i, ids in zip(rest, run([parts[i] for i in rest])):
            size[i] = len(ids)
            found.append(([i], ids))
        start = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint32)
        if found:
            places = np.concatenate([i for i, _ in found])
            flat[ragged(start[places], size[places])] = np.concatenate([ids for _, ids in found])
        return flat, size


@lru_cache(1)
def encoder_of(path: str | None) -> Encoder:
    """One for a worker: the words that it knows serve its next tasks."""
    return Encoder(path)
