"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

Every position of a text is labelled: one recurrent layer reads the bytes forwards, one backwards, and a softmax over both
states gives each position's language probabilities. A document's probabilities are the mean over all its positions. White
space is read like any other byte, so states are carried from word to word through a document.

Texts are read in segments of SEGMENT bytes, all of them side by side, each after CONTEXT bytes of what lies before it and,
backwards, of what lies behind it: so a text of any length takes bounded memory and bounded steps. Runs of white space count
as one space.

Beside the languages the network learns a class of noise: windows of which the bytes are shuffled, and random letters, digits
and bytes of other scripts. No text is named by it, but its share is missing in a text's score, which is low for text in none
of the languages.

Null ids are kept; rows that repeat, or share an id, are named each; other columns are not read. Texts that are null or have
no letter give ``und`` with score 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_sample, record

SEGMENT, CONTEXT, LANES = 384, 24, 1024
#: Rows that a worker reads, names and hands back at a time.
ROWS = 2000
#: Bytes of the windows that the network learns from, and how many are drawn from a text.
WINDOW, PER_TEXT = 48, 8
LETTER = regex.compile(r"\p{L}")


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the units' bounded function, a few times cheaper here than the hyperbolic tangent."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def slope(y: np.ndarray) -> np.ndarray:
    """The derivative of squash where its value is y."""
    return (1 - np.abs(y)) ** 2


class ByteGRU:
    """Parameters: per direction input table (256 x 3H), recurrent matrix (H x 3H), its bias; then the output layer.

    Its classes are the languages and, last, noise.
    """

    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 7) -> None:
        rng, h = np.random.default_rng(seed), hidden
        self.langs, self.hidden, c = langs, h, len(langs) + 1
        normal = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {f"{k}{d}": normal(*s) for d in "fb" for k, s in (("x", (256, 3 * h)), ("u", (h, 3 * h)))}
        self.p |= {f"b{d}": np.zeros(3 * h, np.float32) for d in "fb"} | {"w": normal(2 * h, c), "o": np.zeros(c, np.float32)}

    def layer(self, x: np.ndarray, d: str, keep: list | None = None) -> list[np.ndarray]:
        """States after each byte of x (lanes x length), for direction d."""
        h, n = self.hidden, x.shape[1]
        table, u, b = self.p[f"x{d}"], self.p[f"u{d}"], self.p[f"b{d}"]
        state, out = np.zeros((len(x), h), np.float32), [None] * n
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            a, r = table[x[:, t]], state @ u + b
            zr = 0.5 * squash(a[:, : 2 * h] + r[:, : 2 * h]) + 0.5
            z, g = zr[:, :h], zr[:, h:]
            new = squash(a[:, 2 * h :] + g * r[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, g, new, r[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def positions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log probabilities of each language at each position: lanes x length x languages."""
        f = self.layer(x, "f", None if keep is None else keep.setdefault("f", []))
        b = self.layer(x, "b", None if keep is None else keep.setdefault("b", []))
        both = np.concatenate([np.stack(f, 1), np.stack(b, 1)], 2)
        if keep is not None:
            keep["both"] = both
        y = both @ self.p["w"] + self.p["o"]
        y -= y.max(2, keepdims=True)
        return y - np.log(np.exp(y).sum(2, keepdims=True))

    def gradients(self, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross entropy over all positions, each with a label of its own."""
        keep: dict = {}
        logp = self.positions(x, keep)
        dy, h = np.exp(logp), self.hidden
        dy[np.arange(len(x))[:, None], np.arange(x.shape[1]), label] -= 1
        dy /= x.size
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"], g["o"] = np.einsum("lth,ltc->hc", keep["both"], dy), dy.sum((0, 1))
        dboth = dy @ self.p["w"].T
        for d, part in (("f", dboth[:, :, :h]), ("b", dboth[:, :, h:])):
            back, u = np.zeros((len(x), h), np.float32), self.p[f"u{d}"]
            for t, state, z, r, new, rn in reversed(keep[d]):
                ds = part[:, t] + back
                dn = ds * (1 - z) * slope(new)
                dz = ds * (state - new) * 0.5 * slope(2 * z - 1)
                dr = dn * rn * 0.5 * slope(2 * r - 1)
                da, drec = np.concatenate([dz, dr, dn], 1), np.concatenate([dz, dr, dn * r], 1)
                np.add.at(g[f"x{d}"], x[:, t], da)
                g[f"u{d}"] += state.T @ drec
                g[f"b{d}"] += drec.sum(0)
                back = ds * z + drec @ u.T
        return g

    def sweep(self, x: np.ndarray, active: np.ndarray, d: str) -> np.ndarray:
        """Weighted states of direction d: languages x positions. x is length x lanes; the first active[t] have a byte at t."""
        h, (length, n) = self.hidden, x.shape
        table, u, b = self.p[f"x{d}"], self.p[f"u{d}"], self.p[f"b{d}"]
        split = lambda m: [np.ascontiguousarray(m[:, k : k + h]) for k in (0, h, 2 * h)]
        (uz, ur, un), (xz, xr, xn) = split(u), split(table)
        xz, xr, bn = xz + b[:h], xr + b[h : 2 * h], b[2 * h :]
        state, states = np.zeros((n, h), np.float32), np.zeros((length, n, h), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            k = active[t]
            s, byte = state[:k], x[t, :k].astype(np.intp)
            r = s @ ur
            r += xr.take(byte, 0, mode="clip")
            squash(r)
            r += 1
            r *= 0.5
            new = s @ un
            new += bn
            new *= r
            new += xn.take(byte, 0, mode="clip")
            squash(new)
            z = s @ uz
            z += xz.take(byte, 0, mode="clip")
            squash(z)
            z += 1
            z *= 0.5
            s -= new
            s *= z
            s += new
            states[t, :k] = s
        w = self.p["w"][:h] if d == "f" else self.p["w"][h:]
        return w.T @ states.reshape(-1, h).T

    def labels(self, segments: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sums of the language probabilities of positions first to last of each segment: segments x languages.

        Segments lie side by side in order of falling length.
        """
        out = np.zeros((len(segments), len(self.langs) + 1))
        order = np.argsort([-len(s) for s in segments], kind="stable")
        for lo in range(0, len(order), LANES):
            part = order[lo : lo + LANES]
            size = np.array([len(segments[i]) for i in part])
            steps = np.arange(size[0])
            active = len(part) - np.searchsorted(size[::-1], steps, "right")
            x = np.zeros((len(part), size[0]), np.uint8)
            x[steps < size[:, None]] = np.concatenate([segments[i] for i in part])
            x = np.ascontiguousarray(x.T)
            y = self.sweep(x, active, "f")
            y += self.sweep(x, active, "b")
            y += self.p["o"][:, None]
            y -= y.max(0)
            np.exp(y, out=y)
            own = (steps[:, None] >= first[part]) & (steps[:, None] < last[part])
            y *= own.reshape(-1) / y.sum(0)
            out[part] = y.reshape(-1, *own.shape).sum(1, dtype=np.float64).T
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text: texts x languages; zero for texts without any byte."""
        out, count = np.zeros((len(texts), len(self.langs) + 1)), np.zeros(len(texts))
        segments, rows = [], []

        def read() -> None:
            owner, first, last = np.array(rows).T
            np.add.at(out, owner, self.labels(segments, first, last))
            segments.clear(), rows.clear()

        for k, t in enumerate(texts):
            codes = np.frombuffer(b" ".join(t.split()), np.uint8)
            count[k] = len(codes)
            for lo in range(0, len(codes), SEGMENT):
                begin, end = max(0, lo - CONTEXT), min(len(codes), lo + SEGMENT)
                segments.append(codes[begin : end + CONTEXT])
                rows.append((k, lo - begin, end - begin))
            if len(segments) >= 8 * LANES:
                read()
        if segments:
            read()
        return out[:, :-1] / np.maximum(count, 1)[:, None]


def noise(windows: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n windows in no language: a third shuffled bytes of the given ones, a third random signs of an alphabet, a third of other scripts."""
    out = rng.permuted(windows[rng.integers(0, len(windows), n)], axis=1)
    kinds = [b"0123456789abcdef", b"abcdefghijklmnopqrstuvwxyz", b"0123456789 .,-", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"qwertyuiopasdfghjklzxcvbnm ;,"]
    for i in range(n // 3):
        signs = np.frombuffer(kinds[i % len(kinds)], np.uint8)
        out[i] = rng.choice(signs, WINDOW)
    for i in range(n // 3, 2 * n // 3):
        # letters of two or three bytes from a narrow range, as other scripts have them
        first = int(rng.integers(0x370, 0xD000))
        signs = rng.integers(first, first + 40, WINDOW)
        out[i] = np.frombuffer("".join(chr(c) if rng.random() > 0.15 else " " for c in signs).encode()[:WINDOW], np.uint8)
    return out


def train(windows: np.ndarray, label: np.ndarray, names: list[str], per_class: int = 3000, epochs: int = 2, batch: int = 128, rate: float = 0.02, seed: int = 7) -> ByteGRU:
    """Adam over windows (n x WINDOW bytes), per_class of each language and of noise, drawn with repeats where there are fewer.

    Half of the windows go over into another one at a random byte, so that states learn to let go of what they have read.
    """
    rng, model = np.random.default_rng(seed), ByteGRU(names, seed=seed)
    windows, label = np.concatenate([windows, noise(windows, per_class, rng)]), np.append(label, [len(names)] * per_class)
    rows = np.concatenate([rng.choice(np.flatnonzero(label == c), per_class, np.count_nonzero(label == c) < per_class) for c in range(len(names) + 1)])
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(p) for k, p in model.p.items()}
    step, steps = 0, max(1, epochs * -(-len(rows) // batch))
    for _ in range(epochs):
        rng.shuffle(rows)
        for lo in range(0, len(rows), batch):
            pick, other = rows[lo : lo + batch], rng.choice(rows, len(rows[lo : lo + batch]))
            behind = np.arange(WINDOW) >= np.where(rng.random(len(pick)) < 0.5, rng.integers(1, WINDOW, len(pick)), WINDOW)[:, None]
            x, y = (np.where(behind, b, a) for a, b in ((windows[pick], windows[other]), (label[pick, None], label[other, None])))
            step += 1
            for k, d in model.gradients(x, y).items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                model.p[k] -= (rate * (1 - step / (steps + 1)) * fix * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32)
    return model


def draw(text: bytes, seed: int) -> list[bytes]:
    """PER_TEXT windows of WINDOW bytes at random places of the whole text; a shorter text is repeated up to that size."""
    text = b" ".join(text.split())
    if len(text) < WINDOW:
        return [((text + b" ") * WINDOW)[:WINDOW]] if text else []
    at = np.random.default_rng(seed).integers(0, len(text) - WINDOW + 1, PER_TEXT)
    return [text[a : a + WINDOW] for a in at]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 3000) -> ByteGRU | None:
    """A model from at most max_docs labelled rows, taken in the order of the id's hash.

    The bound is on rows, for learning only: PER_TEXT windows come from random places of each whole text, cut by the
    executors. None where no row has a text and a label.
    """
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("windows", pa.binary())])

    def cut(it):
        for b in it:
            found = [b"".join(draw(t, h)) for h, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield record(schema, b.column(0), b.column(1), found)

    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    made = bounded_sample(rows, max_docs, "id", lambda df: df.select("h", "lang", "text").mapInArrow(cut, "h long, lang string, windows binary"))
    chosen = [r for r in made.collect() if r.windows]
    if not chosen:
        return None
    names = sorted({r.lang for r in chosen})
    label = np.concatenate([[names.index(r.lang)] * (len(r.windows) // WINDOW) for r in chosen])
    return train(np.frombuffer(b"".join(r.windows for r in chosen), np.uint8).reshape(-1, WINDOW), label, names)


def identify(docs: DataFrame, model: ByteGRU | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score) and the columns in carry for each row of docs. score is the named language's mean probability.

    Texts go to the workers and back once: a text column in carry is the one that is read. They are read ROWS at a time.
    """
    names = [*(model.langs if model else []), "und"]
    shared = [c == text_col and docs.schema[c].dataType.simpleString() == "string" for c in carry]

    def judged(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, text, others = b.column(0), b.column(1), iter(b.columns[2:])
        texts = text.to_pylist()
        best, score = np.full(len(ids), len(names) - 1), np.zeros(len(ids))
        real = [i for i, t in enumerate(texts) if model and t and LETTER.search(t.decode("utf-8", "replace"))]
        if real:
            pooled = model.pooled([texts[i] for i in real])
            best[real], score[real] = pooled.argmax(1), pooled.max(1)
        same = text.view(pa.large_string() if pa.types.is_large_binary(text.type) else pa.string())
        made = [ids, pa.array([names[i] for i in best], pa.string()), pa.array(score, pa.float64()), *(same if s else next(others) for s in shared)]
        return pa.RecordBatch.from_arrays(made, ["id", "lang_pred", "score", *(f"carried_{k}" for k in range(len(carry)))])

    def run(it):
        for b in it:
            for lo in range(0, b.num_rows, ROWS):
                yield judged(b.slice(lo, ROWS))

    more = [F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry) if not shared[k]]
    kinds = "".join(f", carried_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    return as_bytes(docs, id_col, text_col, more).mapInArrow(run, "id long, lang_pred string, score double" + kinds).withColumnsRenamed({f"carried_{k}": c for k, c in enumerate(carry)})
