"""Toxicity by a convolutional text classifier, trained here in numpy.

Words (lower-cased ASCII, without marks at the ends) are hashed into embedding rows. Filters of widths 1, 2 and 3 slide over
the whole text, padded by empty words; each filter's largest response passes a ReLU into one logistic unit. Thresholds are
calibrated by language: on a fifth of the labelled rows, kept from the fit, each language's best threshold is moved to 0.7 on
the score's scale. That language is what the byte network of langid says of the text's words, for these rows as for all
others; columns other than the text never enter a score.

Null and empty texts score as a text without words. Null ids keep their rows; rows that repeat score alike; texts of any
length are read whole; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_WORDS, Words, as_bytes, batches, bounded_sample, record, stored
from .langid import ByteGRU

ROWS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
#: Empty words before each text: as many as the widest filter has.
PAD = max(WIDTHS)
AT = 0.7
MARKS = b".,;:!?\"'()[]{}*&$%#|<>-_"


def row_of(word: bytes) -> int:
    """The embedding row of a word; row 0 is the empty word, which words that are all marks count as."""
    w = word.lower().strip(MARKS)
    return zlib.crc32(w) % (ROWS - 1) + 1 if w else 0


def side_by_side(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' rows one after the other, with PAD empty words before each and after the last; and where each one's pad begins."""
    size = np.array([len(t) + PAD for t in texts])
    start = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()) + PAD, np.int32)
    inner = np.ones(len(flat), bool)
    inner[(np.append(start, len(flat) - PAD)[:, None] + np.arange(PAD)).ravel()] = False
    flat[inner] = np.concatenate(texts)
    return flat, start


class TextCNN:
    def __init__(self, seed: int = 3, widths: tuple[int, ...] = WIDTHS) -> None:
        rng = np.random.default_rng(seed)
        self.widths = widths
        self.e = (rng.standard_normal((ROWS, DIM)) * 0.1).astype(np.float32)
        self.e[0] = 0
        self.w = [(rng.standard_normal((n, DIM, FILTERS)) * 0.3).astype(np.float32) for n in widths]
        self.b = np.zeros(len(widths) * FILTERS, np.float32)
        self.v = (rng.standard_normal(len(widths) * FILTERS) * 0.3).astype(np.float32)
        self.c = np.float32(0)
        self.shift: dict[str, float] = {}

    def project(self, rows: np.ndarray) -> np.ndarray:
        """words x filter parts: what each part of each filter makes of the words."""
        return self.e[rows] @ np.concatenate([part for w in self.w for part in w], 1)

    def convolve(self, projected: np.ndarray) -> np.ndarray:
        """The response of each filter at each position, from words side by side. The last PAD positions are pads."""
        n = len(projected) - PAD
        out, k = np.zeros((n, len(self.widths) * FILTERS), np.float32), 0
        for i, width in enumerate(self.widths):
            own = out[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(width):
                own += projected[j : j + n, k : k + FILTERS]
                k += FILTERS
        return out

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.b, 0) @ self.v + self.c

    def logits(self, projected: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self.logit(np.maximum.reduceat(self.convolve(projected), start))

    def fit(self, texts: list[np.ndarray], label: np.ndarray, epochs: int = 5, batch: int = 8, rate: float = 0.03, decay: float = 1e-4, least: int = 4, drop: float = 0.3, shrink: float = 3.0, associate: bool = True, seed: int = 3) -> None:
        """AdaGrad on batches of texts, of whose words a share of drop is emptied at random each time.

        The first component of a row starts as its association with the label: the standard score of its toxic texts
        against the overall rate, less shrink. Rows that occur in fewer than least texts stay at zero, as do unseen ones.
        """
        seen, toxic = np.zeros(ROWS), np.zeros(ROWS)
        for t, y in zip(texts, label):
            rows = np.unique(t)
            seen[rows] += 1
            toxic[rows] += y
        base = min(max(float(label.mean()), 0.01), 0.99)
        known = seen >= least
        known[0] = False
        if associate:
            self.e *= 0.3
            score = (toxic - seen * base) / np.sqrt(np.maximum(seen, 1) * base * (1 - base))
            self.e[:, 0] = np.clip(np.sign(score) * np.maximum(np.abs(score) - shrink, 0), -3, 12) / 8
            for w in self.w:
                w *= 0.3
                w[:, 0] = np.abs(w[:, 0]) + 0.5
            self.v[:] = np.abs(self.v)
        self.e[~known] = 0
        weight = np.where(label == 1, len(label) / max(1, 2 * label.sum()), len(label) / max(1, 2 * (1 - label).sum())).astype(np.float32)
        rng = np.random.default_rng(seed)
        past = {k: np.full_like(x, 0.1) for k, x in (("e", self.e), ("b", self.b), ("v", self.v), *((i, w) for i, w in enumerate(self.w)))}
        gc = 0.1
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for some in (order[k : k + batch] for k in range(0, len(order), batch)):
                flat, start = side_by_side([texts[i] for i in some])
                flat[rng.random(len(flat)) < drop] = 0
                conv = self.convolve(self.project(flat))
                pooled = np.maximum.reduceat(conv, start)
                # the first position of each largest response
                own = np.repeat(np.arange(len(some)), np.diff(np.append(start, len(conv))))
                at = np.minimum.reduceat(np.where(conv == pooled[own], np.arange(len(conv))[:, None], len(conv)), start)
                act = np.maximum(pooled + self.b, 0)
                y = act @ self.v + self.c
                d = ((1 / (1 + np.exp(-np.clip(y, -50, 50))) - label[some]) * weight[some]).astype(np.float32)
                dp = d[:, None] * self.v * (act > 0)
                for i, width in enumerate(self.widths):
                    dk = dp[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(width):
                        r = flat[at[:, i * FILTERS : (i + 1) * FILTERS] + j]
                        g = np.einsum("bf,bfd->df", dk, self.e[r])
                        on = known[r] & (dk != 0)
                        de = (self.w[i][j].T[None] * dk[:, :, None])[on]
                        past[i][j] += g * g
                        self.w[i][j] -= rate * g / np.sqrt(past[i][j])
                        np.add.at(past["e"], r[on], de * de)
                        np.add.at(self.e, r[on], -rate * de / np.sqrt(past["e"][r[on]]))
                for value, g, k in ((self.b, dp.sum(0), "b"), (self.v, d @ act + decay * self.v, "v")):
                    past[k] += g * g
                    value -= rate * g / np.sqrt(past[k])
                gc += float(d.sum()) ** 2
                self.c -= np.float32(rate * d.sum() / np.sqrt(gc))

    def calibrate(self, texts: list[np.ndarray], label: np.ndarray, lang: list[str], other: float = 1.0, least: int = 20) -> None:
        """Each language's best threshold on the given rows; the pooled one where it has too few of either class."""
        y = np.zeros(len(texts))
        for i, t in enumerate(texts):
            flat, start = side_by_side([t])
            y[i] = self.logits(self.project(flat), start)[0]
        self.shift = {"": best_threshold(y, label, other)}
        for name in sorted(set(lang)):
            own = np.array([x == name for x in lang])
            if min(label[own].sum(), (1 - label[own]).sum()) >= least:
                self.shift[name] = best_threshold(y[own], label[own], other)


def best_threshold(y: np.ndarray, label: np.ndarray, other: float = 1.0) -> float:
    """The cut with the best F1, midway between the two values around it; a row of the other class counts other times."""
    if not len(y):
        return 0.0
    order = np.argsort(-y, kind="stable")
    s, hit = y[order], np.cumsum(label[order])
    named = np.cumsum(np.where(label[order] == 1, 1.0, other))
    f1 = 2 * hit / (named + label.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1)


def spoken(model: ByteGRU, words: list[bytes]) -> np.ndarray:
    """What each word adds to a text's language: the mean probabilities of its positions, as often as it has bytes."""
    return model.pooled(words) * np.array([len(w) for w in words])[:, None]


def fit(docs: DataFrame, labels: DataFrame, lang_model: ByteGRU | None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 3000, max_other: int = 6000, max_words: int = 8_000_000) -> TextCNN:
    """A model from at most max_toxic and max_other labelled rows and max_words in all, in the order of the id's hash.

    The bounds hold for learning only; a row counts with its whole text. Rows without a label or a text are left out.
    Executors turn texts into embedding rows and languages, so no text reaches the driver.
    """
    pick = [
        bounded_sample(labels.where(F.col(label_col) == v).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")), n, "id")
        for v, n in ((1, max_toxic), (0, max_other))
    ]
    total = {r[0]: r[1] for r in labels.where(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    chosen = pick[0].union(pick[1]).dropDuplicates(["id", "y"])  # at most max_toxic + max_other rows, whatever the size of the table
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("y", pa.int32()), ("lang", pa.string()), ("rows", pa.binary()), ("n", pa.int64())])

    def read(it):
        words, table, langs = Words(), np.zeros(0, np.int32), None
        for b in it:
            out = []
            for t in b.column(3).to_pylist():
                n = words.numbers(t.split())
                if new := words.new():
                    table = np.append(table, np.array([row_of(w) for w in new], np.int32))
                    if lang_model:
                        langs = np.concatenate([*([] if langs is None else [langs]), spoken(lang_model, new)])
                out.append((lang_model.langs[int(langs[n].sum(0).argmax())] if lang_model and len(n) else "", table[n].tobytes(), len(n)))
                if len(words.number) > MAX_WORDS // 2:
                    words, table, langs = Words(), table[:0], None
            if out:
                yield record(schema, b.column(0), b.column(1), b.column(2), *zip(*out))

    text = F.col(text_col).cast("string").cast("binary")
    joined = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("t")).join(F.broadcast(chosen), "id")
    made = stored(joined.select("h", F.col("id").cast("long"), "y", "t").mapInArrow(read, "h long, id long, y int, lang string, rows binary, n long"), "toxicity-sample")
    # whole rows, by the hash, while they fit
    size = made.groupBy("h").agg(F.sum("n").alias("n")).orderBy("h").collect()
    fits = np.cumsum([r.n for r in size]) <= max_words
    last = max([r.h for r, ok in zip(size, fits) if ok], default=-1)
    rows = sorted(made.where(F.col("h") <= last).collect(), key=lambda r: (r.h, r.id, bytes(r.rows)))
    texts, label = [np.frombuffer(r.rows, np.int32) for r in rows], np.array([r.y for r in rows], np.float32)
    model = TextCNN()
    if len(rows):
        own = np.arange(len(rows)) % 5 > 0  # every fifth row is kept for the thresholds
        if not (label[own].any() and label[~own].any()):
            own[:] = True
        model.fit([t for t, x in zip(texts, own) if x], label[own], least=max(4, int(own.sum()) // 500))
        held = [i for i, x in enumerate(own) if not x] or list(range(len(rows)))
        # in the sample toxic rows are more frequent than in the table
        other = (total.get(0, 0) / max(1, total.get(1, 0))) / max((1 - label).sum() / max(1, label.sum()), 1e-9)
        model.calibrate([texts[i] for i in held], label[held], [rows[i].lang for i in held], max(1.0, float(other)))
    return model


def score(docs: DataFrame, model: TextCNN, lang_model: ByteGRU | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): a probability-like score in which AT is the calibrated threshold of the text's language."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])
    at = float(np.log(AT / (1 - AT)))
    names = lang_model.langs if lang_model else []
    shift = np.array([model.shift.get(k, model.shift.get("", 0.0)) for k in (*names, "")])

    def run(it):
        # number 0 is the empty word
        empty = model.project(np.zeros(1, np.int64)), np.zeros((1, len(names)))
        words, (table, langs) = Words(), empty
        for ids, texts in batches(it):
            y = np.zeros(len(ids))
            lo = 0
            while lo < len(ids):
                if len(words.number) > MAX_WORDS // 2:
                    words, (table, langs) = Words(), empty
                # texts of some 200,000 bytes, one at least
                hi, held = lo, 0
                while hi < len(ids) and (hi == lo or held < 200_000):
                    held += len(texts[hi] or b"")
                    hi += 1
                numbers = [words.numbers(t.split() if t else []) + 1 for t in texts[lo:hi]]
                if new := words.new():
                    table = np.concatenate([table, model.project(np.array([row_of(w) for w in new]))])
                    if names:
                        langs = np.concatenate([langs, spoken(lang_model, new)])
                flat, start = side_by_side(numbers)
                y[lo:hi] = model.logits(table[flat], start) + at
                if names:
                    said = np.add.reduceat(langs[flat[:-PAD]], start)
                    y[lo:hi] -= shift[np.where(said.any(1), said.argmax(1), len(names))]
                else:
                    y[lo:hi] -= shift[-1]
                lo = hi
            yield record(schema, ids, 1 / (1 + np.exp(-np.clip(y, -500, 500))))

    return as_bytes(docs, id_col, text_col).mapInArrow(run, "id long, score double")
