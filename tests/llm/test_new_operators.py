"""Conversation repair, whitening and byte-level BPE against brute force, on small tables and on the odd cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from proofmill.llm import bytebpe, dialogue, queries, warc, whitening

from .conftest import LONG, ROWS, SF

# --- 11: conversation repair ---

FOLLOWS = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def brute(rows):
    """Every field of the result for rows (turn, role, text) in order: all edits tried, with up to four inserts in a row."""
    seen, fault = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    sys.setrecursionlimit(20_000)

    @lru_cache(None)
    def best(i, state, inserted):
        ways, role = [], FOLLOWS[state]
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 4:
            cost, audit, left = best(i, role[0], inserted + 1)
            ways.append((cost + 2, "I" + audit, ((role, ""), *left)))
        if i < len(rows):
            cost, audit, left = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit, left))
            if fault[i] not in ("blank", "duplicate"):
                more, (_, own, text) = fault[i] == "truncated", rows[i]
                if own[:1] == role[0] or (own[:1] == "s" and not state):
                    cost, audit, left = best(i + 1, own[0], 0)
                    ways.append((cost + more, "K" + audit, ((own, text), *left)))
                cost, audit, left = best(i + 1, role[0], 0)
                ways.append((cost + more + 2, "R" + audit, ((role, text), *left)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, left = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    kinds = [fault.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *kinds, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()), left


def damaged(rows):
    space = lambda v: " " if v is None else v
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else space(role), "" if kind == 1 else re.sub("[.!?]", "", space(text)) if kind == 2 else space(text)
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    mark = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()[:16]
    return {c: sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), mark(r))) for c, found in out.items()}


def test_op11_equals_brute_force(spark):
    table = spark.read.parquet(SF.replace("0.001", "0.01") + "/conversations.parquet")
    rows = damaged([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    found = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, SF.replace("0.001", "0.01")).collect()}
    assert found == {c: brute(x)[0] for c, x in rows.items()}
    assert len({audit for *_, audit, _ in found.values()}) > 10


SCHEMA = "conv_id long, turn long, role string, text string, id int, kind string, audit string, mark string, gone boolean"
TALKS = {
    1: [(0, "system", "Be kind."), (1, "user", "Hi."), (2, "assistant", "Hello.")],
    2: [(None, None, None), (None, "user", "What?"), (3, None, "cut off"), (3, None, "cut off"), (9, "assistant", "So.")],
    3: [(i, "user" if i % 2 else "assistant", LONG + ".") for i in range(3)],
    4: [(0, "assistant", "One."), (0, "assistant", "Two."), (0, "assistant", "Three")],
    5: [(0, "", "Nameless."), (1, "unknown", "Also so."), (2, "tool", " "), (3, "a", "\x85"), (4, "user", ".\x85")],
    6: [(7, "system", "A."), (8, "system", "B."), (9, "system", "A.")],
    None: [(None, "user", "No name."), (1, "assistant", " \t\n")],
    8: [(-(2**62), "user", "Far."), (2**62, "assistant", "Further.")],
}


def talks(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "k", "a", "m", None) for c, t, r, x in rows], SCHEMA)


def test_repair_of_odd_conversations(spark):
    rows = talks(spark, [(c, *r) for c, found in TALKS.items() for r in found])
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    blanks = lambda r: (r[0], " " if r[1] is None else r[1], " " if r[2] is None else r[2])
    want = {c: brute(sorted(map(blanks, found), key=order)) for c, found in TALKS.items()}
    audits = dialogue.audits(rows)
    assert {r.conv_id: tuple(r)[1:] for r in dialogue.digests(rows, audits).collect()} == {c: w[0] for c, w in want.items()}
    left = defaultdict(list)
    for r in sorted(dialogue.repaired(rows, audits).collect(), key=lambda r: r.step):
        assert r.step == len(left[r.conv_id]) and (r.edit == "I") <= (r.turn is None and r.text == "")
        left[r.conv_id].append((r.role, r.text))
    assert {c: tuple(left[c]) for c in TALKS} == {c: w[1] for c, w in want.items()}
    assert "".join(f"{r[:1]}" for r, _ in left[1]) == "sua"


def test_repair_of_random_conversations(spark):
    """Every mix of roles and faults in up to nine rows; conversations cross batches and partitions."""
    rng = random.Random(3)
    made = {c: [(rng.choice([None, 0, 1, 5, 6]), rng.choice(["system", "user", "assistant", "x"]), rng.choice(["", "a.", "b", "c!", " "])) for _ in range(rng.randint(0, 9))] for c in range(300)}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    rows = talks(spark, [(c, *r) for c, found in made.items() for r in found])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r.conv_id: tuple(r)[1:] for r in dialogue.digests(rows, dialogue.audits(rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {c: brute(sorted(rows, key=order))[0] for c, rows in made.items() if rows}


def test_damage_keeps_conversations_that_lose_all_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = dialogue.damage(talks(spark, [(gone, 0, "user", "Hi.")]).select("conv_id", "turn", "role", "text"))
    (row,) = dialogue.digests(rows, dialogue.audits(rows)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    none = rows.where("false")
    assert dialogue.digests(none, dialogue.audits(none)).count() == 0 == dialogue.repaired(none, dialogue.audits(none)).count()


def test_damage_of_null_rows(spark):
    rows = [(None, None, None, None), (3, None, "user", None), (None, 4, None, "x.")]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    hurt = dialogue.damage(made)
    found = {r.conv_id: tuple(r)[1:] for r in dialogue.digests(hurt, dialogue.audits(hurt)).collect()}
    assert found == {c: brute(x)[0] for c, x in damaged(rows).items()}


def test_edits_of_a_long_conversation_take_linear_time():
    codes = bytes([2 + i % 2 for i in range(100_000)]) + bytes([dialogue.GOES | 2]) * 50_000
    cost = dialogue.distances(codes)
    assert cost[0] == 150_000 and "".join(dialogue.steps(codes, cost)) == "K" * 100_000 + "D" * 50_000


# --- 12: whitening ---


def test_eigen_equals_numpy():
    rng = np.random.default_rng(2)
    for a in (np.eye(5), np.zeros((4, 4)), np.diag([3.0, 1.0, 2.0]), np.ones((6, 6)), np.zeros((1, 1)), *(rng.normal(size=(d, 2 * d)) for d in (2, 3, 17, 90))):
        a = a if a.shape[0] == a.shape[1] else a @ a.T
        values, vectors = whitening.eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).max()))
        assert np.allclose(vectors @ vectors.T, np.eye(len(a)), atol=1e-12)
        assert np.allclose(a @ vectors.T, vectors.T * values, atol=1e-11 * max(1, np.abs(a).max()))


def expected(rows):
    """Per length of vectors: n, sums, whitened values by row, deviations and shares, by numpy over the whole matrix."""
    groups = defaultdict(list)
    for i, e in rows:
        if e is not None and all(c is not None and np.isfinite(c) for c in e):
            groups[len(e)].append((i, [int(np.floor(64 * float(c))) + 1_000_000 for c in e]))
    out = []
    for dim, found in groups.items():
        if not dim:
            continue
        x = np.array([v for _, v in found], object)
        fit = np.unique(x.astype(np.int64), axis=0).astype(object)
        n, s = len(fit), fit.sum(0)
        away = (fit - 1_000_000).astype(float) - np.array([float(v - n * 1_000_000) / n for v in s])
        cov = away.T @ away / n
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
        for i, v in found:
            deviation = sum((n * a - b) ** 2 for a, b in zip(v, s))
            y = (np.array([a - 1_000_000 for a in v], float) - np.array([float(b - n * 1_000_000) / n for b in s])) @ vectors
            out += [(i, k + 1, n, deviation, y[k], values[k], np.trace(cov)) for k in range(len(values))]
    return out


def assert_whitened(found, want):
    """Both sorted by id and component; each component may be turned the other way in all its rows."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], abs(r[3] or 0))
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    signs = {}
    for (*_, component, n, deviation, white, share, error), (*_, y, value, trace) in zip(found, want):
        if value <= 1e-12 * max(trace, 1e-300):
            assert white is None and share == 0
            continue
        assert abs(share - value / trace) <= 1e-9 and error <= 1e-6
        y /= np.sqrt(value)
        if abs(y) > 1e-6:
            assert signs.setdefault((trace, component), np.sign(white * y)) == np.sign(white * y)
        assert abs(abs(white) - abs(y)) <= 1e-6 * max(1, abs(y))


def test_op12_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert_whitened(queries.op12_embedding_whitening(spark, SF).collect(), expected(rows))


def test_whitening_of_odd_vectors(spark):
    """Nulls, entries that aren't finite, empty and repeated vectors, several lengths, few vectors, huge entries, repeated ids."""
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, -inf]), (None, [0.5, 0.25]), (7, [0.5, 0.25]), (7, [0.5, 0.25]), (8, [-0.5, 1.0]), (9, [9.0, -3.0])]
    rows += [(10, [3.0] * 5), (11, [1.0]), (12, [-1e9]), (13, [1e9])]
    rows += [(100 + i, [float(v) for v in rng.normal(size=20)]) for i in range(12)]
    table = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<double>, id int, x int")
    kept = whitening.integers(table.repartition(5))
    found = whitening.whitened(kept, whitening.fit(kept)).collect()
    assert_whitened([(*r[:3], int(r.deviation), *r[4:]) for r in found], expected(rows))
    assert {r.id for r in found} == {None, 7, 8, 9, 10, 11, 12, 13, *range(100, 112)}
    none = whitening.integers(table.where("false"))
    assert whitening.whitened(none, whitening.fit(none)).count() == 0


def test_whitening_holds_entries_within_bounds(spark):
    """Beyond 2^47 entries are held; deviations that leave 64 bits are exact in the operator and null in the query's column."""
    table = spark.createDataFrame([(1, [1e38]), (2, [-1e38]), (3, [0.0])], "vec_id long, embedding array<float>")
    kept = whitening.integers(table)
    found = {r.id: r for r in whitening.whitened(kept, whitening.fit(kept)).collect()}
    assert int(found[1].deviation) == int(found[2].deviation) == (3 * 2**53) ** 2 and found[3].deviation == 0
    (e,) = {r.explained for r in found.values()}
    assert e == 1 and abs(found[1].whitened + found[2].whitened) < 1e-9


def test_states_of_many_partitions_merge_to_the_whole(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-90, 90, (700, 6)) + 1_000_000
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(300)
    (row,) = whitening.merged(whitening.states(rows)).collect()
    y = x - 1_000_000
    assert row.n == 700 and [int(i) for i in row.sums] == y.sum(0).tolist()
    assert np.allclose(np.frombuffer(row.mean), y.mean(0), atol=1e-12)
    assert np.allclose(np.frombuffer(row.m2).reshape(6, 6) / 700, np.cov(y.T, bias=True), rtol=1e-12)


# --- 13: byte-level BPE ---


def library(name):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_byte_bpe_equals_the_library(name):
    import public_tokenizers as P

    encoder, plain, rng = bytebpe.Encoder(P.path(name)), library(name), random.Random(1)
    parts = ["a", " ", "  ", "\n", "é", "日", "ſ", "'s", "'LL", "1", "²", "!", "\x1c", "\x85", " ", "the", "ing", "՘", "\U0003d000", "A", "’", "😀", "\r\n", "\t", "<|endoftext|>"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    cases += ["".join(rng.choice("abcdehinorst") for _ in range(rng.randint(0, 400))) for _ in range(300)]
    cases += ["a" * 50_000, " " * 5000, "-" * 3333, "\n" * 777, "ab" * 5000, "", " ", "é" * 9999]
    assert [x.tolist() for x in encoder.encode([c.encode() for c in cases])] == [plain.encode_ordinary(c) for c in cases]


def test_pattern_cuts_as_the_library_does_at_every_code_point():
    """A letter joins a letter before it, and so on: a vocabulary with a token for each tells what a code point is."""
    import public_tokenizers as P
    import regex
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    for lead in b"a1!":
        for i in range(256):
            ranks[bytes([lead, i])] = len(ranks)
    plain, later = tiktoken.Encoding("kinds", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), re.compile(f"[{bytebpe.LATER}]")
    points = [c for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{chr(c)}\n1{chr(c)}\n!{chr(c)}\n" for c in points)
    cut = regex.compile(P.PATTERN).findall(later.sub(bytebpe.OTHER, text))
    sizes = [len(p) for p in cut]
    starts = np.cumsum([0, *sizes[:-1]])
    assert len(text) == 9 * len(points)
    joined = np.zeros(len(text), bool)
    joined[starts] = True  # a piece begins here
    mine = ~joined[1::3].reshape(-1, 3)
    ids = plain.encode_ordinary_batch([text[i : i + 90_000] for i in range(0, len(text), 90_000)], num_threads=2)
    lengths = np.array([len(plain.decode_single_token_bytes(t)) for t in range(plain.n_vocab)])
    flat = np.concatenate([np.array(x) for x in ids])
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(lengths[flat])
    first = np.isin(data[ends[flat >= 256] - 2], list(b"a1!"))  # tokens of a lead and the byte after it
    at = np.zeros(len(data), bool)
    at[ends[flat >= 256][first] - 2] = True
    leads = np.flatnonzero(np.isin(data, list(b"a1!")))
    assert len(leads) == 3 * len(points)
    assert (at[leads].reshape(-1, 3) == mine).all()


def test_op13_equals_the_library(spark):
    plain = library("byte_bpe_50k.tiktoken")
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array(plain.encode_ordinary(r.text or ""), "<u4")
        want.add((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert set(map(tuple, queries.op13_byte_bpe(spark, SF).collect())) == want


def test_byte_bpe_of_odd_rows(odd, none):
    plain = library("byte_bpe_50k.tiktoken")
    found = bytebpe.decode(bytebpe.encode(odd)).collect()
    texts = sorted(((i, t or "") for i, t in ROWS), key=str)
    assert sorted(((r.id, bytes(r.text).decode()) for r in found), key=str) == texts
    assert all(np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(bytes(r.text).decode()) and r.n_tokens == len(r.ids) // 4 for r in found)
    assert bytebpe.decode(bytebpe.encode(none)).count() == 0


def test_caches_that_empty_themselves_change_nothing(monkeypatch):
    monkeypatch.setattr(bytebpe, "MAX_CHUNKS", 50)
    monkeypatch.setattr(bytebpe, "MAX_PIECES", 100)
    monkeypatch.setattr(bytebpe, "MAX_PAIRS", 20)
    encoder, plain = bytebpe.Encoder(), library("byte_bpe_50k.tiktoken")
    for text in (LONG, "quick brown  foxes\njump", LONG[::-1], ""):
        assert encoder.encode([text.encode()])[0].tolist() == plain.encode_ordinary(text)


def test_vocabularies_that_merges_cannot_reach_are_refused(tmp_path):
    lines = [*((bytes([i]), i) for i in range(256)), (b"abc", 256)]
    (path := tmp_path / "x.tiktoken").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in lines))
    with pytest.raises(ValueError):
        bytebpe.Vocabulary(str(path))


# --- 5: record ids ---


def test_repeated_pages_have_records_of_their_own(spark, tmp_path):
    """Repeated page_id and url, revisits that name their response, very long html, nulls, clashing columns, no rows."""
    long = "<p>" + "word " * 2_000_000
    rows = [(1, "u", "<a>"), (1, "u", "<a>"), (1, "u", "<b>"), (1, "v", "<a>"), (2, "u", "<a>"), (3, None, None), (None, "u", "<a>"), (4, "w", long), (5, "w", long)]
    pages = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, file string, sha int").coalesce(1)
    folder, manifest = warc.write(pages)
    heads, ids = [], []
    for r in spark.read.format("binaryFile").load(folder).collect():
        data = bytes(r.content)
        index = warc.record_index(data)
        for head, _ in warc.records(data):
            heads.append(head)
            (again,) = warc.parse(warc.read_record(data, head["WARC-Record-ID"][1:-1]))
            assert again[0] == head
        ids += list(index)
    assert len(heads) == len(ids) == len(rows) == sum(r.records for r in manifest.collect())
    named = {h["WARC-Record-ID"]: h for h in heads}
    for h in heads:
        if h["WARC-Type"] == "revisit":
            assert named[h["WARC-Refers-To"]]["X-Page-ID"] == h["X-Refers-To-Page-ID"] and named[h["WARC-Refers-To"]]["WARC-Type"] == "response"
    found = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read(folder, manifest).collect()), key=str)
    want = [(1, "response", None)] * 4 + [(2, "revisit", 1), (3, "response", None), (None, "response", None), (4, "response", None), (5, "revisit", 4)]
    assert found == sorted(want, key=str)
    assert warc.read(*warc.write(pages.where("false"))).count() == 0
