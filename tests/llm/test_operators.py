"""Each operator against a brute-force version, on a small table and on the odd cases."""

from __future__ import annotations

import base64
import cProfile
import hashlib
import pstats
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from proofmill.llm import decontam, fmindex, graph, langid, licenses, packing, pivots, queries, rangecoder, simhash, substring, tokenfile, tokens, toxicity, warc

from proofmill.llm.common import Words, bounded_sample, split_join

from .conftest import LONG, ROWS, SF


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    return Tokenizer.from_file(p.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


# --- 1: token files ---


def test_encoder_equals_tokenizer(tokenizer):
    cases = ["İstanbul İ. x", "<|endoftext|> A<|startoftext|>B don't Can'T it's. 12,5 ﬁ Σας ΟΔΟΣ.", "a. b, c! d*** 's ...", "", None, "éa ́x", "x\x1cy\x85z w", "a" * 3000, "WORD word Word"]
    found = tokens.Encoder().encode([None if t is None else t.encode() for t in cases])
    for t, x in zip(cases, found):
        assert list(x) == list(ids_of(tokenizer, t))


def test_encoder_reads_whole_texts_where_words_do_not_stand_alone():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    path = p.path("byte_bpe_50k.json")
    encoder, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    cases = ["Two  words, TWO words.", " é\n", "", "x" * 500]
    assert not encoder.by_word and tokens.Encoder().by_word
    assert [x.tolist() for x in encoder.encode([t.encode() for t in cases], end=50256)] == [plain.encode(t, add_special_tokens=False).ids + [50256] for t in cases]


@pytest.mark.parametrize("shape", [(1, 64), (3, 300), (40, 700)])
def test_range_coder_round_trip(shape):
    rng = np.random.default_rng(shape[1])
    ids = rng.zipf(1.3, shape) % 49408
    ids[0] = 7
    order0 = rangecoder.Order0.of(ids)
    codes = rangecoder.encode(ids, order0)
    assert (rangecoder.decode(codes, shape[1], order0) == ids).all()
    assert len(codes[0]) < shape[1] / 2


def test_extreme_ids_round_trip():
    ids = np.array([[0, (1 << 32) - 1] * 500, [65535] * 1000, [7, 7, 0, 65535] * 250])
    order0 = rangecoder.Order0.of(ids)
    assert (rangecoder.decode(rangecoder.encode(ids, order0), 1000, order0) == ids).all()


def test_a_step_of_the_coder_takes_few_calls():
    """A step's digits go out for all lanes at once; a search for the lanes that have one, and picking them, cost most."""
    ids = np.random.default_rng(5).integers(0, 900, (40, 500)).astype(np.uint32)
    order0, profile = rangecoder.Order0.of(ids), cProfile.Profile()
    codes = profile.runcall(rangecoder.encode, ids, order0)
    assert not [f for f in pstats.Stats(profile).stats if "nonzero" in f[2]]
    assert zlib.crc32(b"".join(codes)) == 689101239 and (rangecoder.decode(codes, 500, order0) == ids).all()


def test_files_coded_together_are_as_one_by_one():
    rng = np.random.default_rng(8)
    rows = [rng.zipf(1.2, (k, 300)) % m for k, m in ((5, 900), (40, 70_000), (1, 3))]
    parts = [(x, rangecoder.Order0.of(x)) for x in rows]
    codes = rangecoder.encode_files(parts)
    assert codes == [rangecoder.encode(*p) for p in parts]
    shorter = rows[0][:, :50], rangecoder.Order0.of(rows[0][:, :50])
    files = [(rangecoder.encode(*shorter), 50, shorter[1])] + [(c, 300, o) for c, (_, o) in zip(codes, parts)]
    assert all((x == y).all() for x, y in zip(rangecoder.decode_files(files), [shorter[0], *rows]))


def test_a_little_over_a_file_is_one_file():
    """Few ids over the size of a file were a file of few blocks, whose steps cost as much as those of a full one."""
    ids = [np.full(3, 7, np.uint32)] * 40
    assert tokenfile.halves([3] * 40, 100) == [slice(None)] and tokenfile.halves([500], 100) == [slice(None)]
    assert tokenfile.halves([3] * 60, 100) == [slice(0, 30), slice(30, None)] and tokenfile.halves([1, 500], 100) == [slice(0, 1), slice(1, None)]
    made = tokenfile.pack_files([([*range(c.start or 0, c.stop or 40)], ids[c]) for c in tokenfile.halves([3] * 40, 50)])
    found = [tokenfile.unpack_file(x) for x in made]
    assert [i for f, _ in found for i in f] == [*range(40)] and all(list(x) == [7] * 3 for _, f in found for x in f)


def test_words_are_kept_for_the_next_task(monkeypatch, tokenizer):
    """A worker's encoder serves all its tasks; of too many words, those that come once are forgotten."""
    assert tokens.encoder_of(None) is tokens.encoder_of(None)
    monkeypatch.setattr(tokens, "MAX_WORDS", 4)
    encoder, first, then = tokens.Encoder(), b"one two, two, three once Ever four five", b" ever  two, six <|endoftext|> Seven."
    for text in (first, then, first + then, b"", then):
        assert [x.tolist() for x in encoder.encode([text, None])] == [list(ids_of(tokenizer, text.decode())), [2]]
    encoder.clear()
    encoder.encode([b"again once", b"again more and more others"])
    encoder.forget()
    assert list(encoder.words.number) == [b"again", b"more"] and encoder.of_words.size.sum() == len(encoder.of_words.flat)


def test_new_words_are_read_from_the_end():
    class Numbers(dict):
        def __iter__(self):
            raise AssertionError("all words are read")

    words = Words()
    words.numbers([b"a", b"b", b"a"])
    assert words.new() == [b"a", b"b"]
    words.number = Numbers({b"a": 0, b"b": 1, b"c": 2, b"d": 3})
    assert words.new() == [b"c", b"d"] and words.new() == []


def test_range_coder_beats_the_order_0_entropy(spark, tokenizer):
    """Files take fewer bits than the entropy of their ids and than Zstandard at its usual level over 16-bit integers."""
    import zstandard

    rows = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").orderBy("doc_id").collect()
    ids = tokens.Encoder().encode([r.text.encode() for r in rows])
    flat = np.concatenate(ids)
    size = len(tokenfile.pack_file(list(range(len(ids))), ids))
    n = np.unique(flat, return_counts=True)[1]
    assert 8 * size / len(flat) < -(n / len(flat) * np.log2(n / len(flat))).sum()
    assert size < len(zstandard.compress(flat.astype("<u2").tobytes()))


def test_token_file_finds_damage():
    data = bytearray(tokenfile.pack_file([1, None], [np.arange(500, dtype=np.uint32), np.array([2], np.uint32)]))
    ids, found = tokenfile.unpack_file(bytes(data))
    assert ids == [1, None] and list(found[0]) == list(range(500)) and list(found[1]) == [2]
    data[40] ^= 255
    with pytest.raises(ValueError):
        tokenfile.unpack_file(bytes(data))


def test_op1_equals_brute_force(spark, tokenizer):
    rows, start = {}, 0
    for i, t in texts(spark):
        x = ids_of(tokenizer, t)
        rows[i] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_files(spark, SF).collect()}
    assert found == rows


def test_token_files_of_odd_rows(odd, none):
    found = tokenfile.read(*tokenfile.write(odd)).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in ROWS)
    assert {r.n_tokens for r in found if r.doc_id in (2, 3, 4)} == {1}
    assert sorted(r.start for r in found)[0] == 0
    assert tokenfile.read(*tokenfile.write(none)).count() == 0


# --- 4: packing ---


def test_pack_group_places_every_id_once():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        lengths = rng.integers(1, 9000, n).tolist()
        seqs = packing.pack_group(lengths)
        covered = [np.zeros(x, int) for x in lengths]
        padding = 0
        for s in seqs:
            used = sum(p[2] for p in s)
            assert 0 < used <= 4096
            padding += 0 if used & (used - 1) == 0 else 4096 - used
            for d, a, k in s:
                covered[d][a : a + k] += 1
        assert all((c == 1).all() for c in covered) and padding == 0


def test_tournament_finds_first_fit():
    rng = np.random.default_rng(1)
    tree, room = packing.Tournament(64, 100), [100] * 64
    for size in rng.integers(1, 60, 60).tolist():
        want = next(i for i, r in enumerate(room) if r >= size)
        assert tree.first(size) == want
        tree.take(want, size)
        room[want] -= size


def test_op4_equals_brute_force(spark, tokenizer):
    rows = queries.op4_packing(spark, SF).collect()
    ids = {i: ids_of(tokenizer, t) for i, t in texts(spark)}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    at: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in ROWS}
    assert packing.pack(none).count() == 0


# --- 5: WARC ---


def test_op5_equals_brute_force(spark):
    pages = spark.createDataFrame([(3, "u", "same"), (1, None, "same"), (2, "v\r\nx", None), (4, "w", ""), (5, "y", "other\r\n\r\nbody"), (None, "z", "same"), (1, "u", "same")], "page_id long, url string, html string")
    rows = warc.read(*warc.write(pages)).collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in rows)
    assert kinds == Counter({(1, "response", None): 2, (3, "revisit", 1): 1, (2, "response", None): 1, (4, "revisit", 2): 1, (5, "response", None): 1, (None, "response", None): 1})
    for r in rows:
        body = {1: b"same", 3: b"same", None: b"same", 2: b"", 4: b"", 5: b"other\r\n\r\nbody"}[r.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()


def test_bundle_is_seekable():
    bundle, kept = warc.Bundle(200), {}
    for i in range(50):
        name, data = warc.warc_record(i, f"http://x/{i}", b"p" * i, None)
        bundle.add(name, data)
        kept[name] = data
    data = bundle.bytes()
    import zstandard

    assert len(warc.seek_table(data)) > 5
    assert all(warc.read_record(data, n) == d for n, d in kept.items())
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(kept.values())


# --- 6: substring deduplication ---


def brute_windows(rows, width):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w, new = (t or "").encode().split(), []
        gone = [False] * len(w)
        for x in range(len(w) - width + 1):
            k = tuple(w[x : x + width])
            if k in seen:
                gone[x : x + width] = [True] * width
            else:
                new.append(k)
        seen |= dict.fromkeys(new)
        kept = b" ".join(a for a, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_op6_equals_brute_force(spark):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_substring_dedup(spark, SF).collect()}
    assert found == brute_windows(texts(spark), 50)


def test_substrings_of_few_words(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(list("abc"), int(n)))) for i, n in enumerate(rng.integers(0, 400, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2000, 40, 0):  # whatever number of sequences makes an anchor crowded
        found = {r.id: (r.n_words, r.n_removed, r.words_sha256) for r in substring.deduplicate(docs, hot=hot).collect()}
        assert found == brute_windows(rows, 50)


def test_windows_after_a_word_of_its_own():
    seqs = [np.arange(1, 114), np.arange(1, 114)]
    seqs[1][[49, 112]] = 200, 201
    index = fmindex.FMIndex(seqs, np.array([0, 1], np.int32), 64)
    hits = fmindex.repeated_windows(index, np.concatenate(seqs), np.array([0, 113]), np.array([113, 113]), np.array([0, 1]), 50)
    assert hits == [(1, 50, 62)]


def test_fm_index_finds_smallest_document():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(1, 4, n) for n in (30, 50, 80, 5)]
    index = fmindex.FMIndex(seqs, np.array([5, 3, 9, 1]), 16)
    flat = np.concatenate(seqs)
    base = np.cumsum([0] + [len(s) for s in seqs])
    for i, s in enumerate(seqs):
        for end in range(len(s)):
            for doc in (2, 6, 10):
                reached = index.extend(flat, base[i : i + 1], np.array([end]), np.array([max(0, end - 11)]), np.array([doc]))[0]
                want = end + 1
                while want > max(0, end - 11) and any(d < doc and any((x[k : k + end - want + 2] == s[want - 1 : end + 1]).all() for k in range(len(x) - (end - want + 2) + 1)) for x, d in zip(seqs, (5, 3, 9, 1))):
                    want -= 1
                assert reached == want


def test_substrings_of_odd_rows(odd, none):
    rows = {(r.id, r.n_words): r for r in substring.deduplicate(odd, carry=("source", "fp")).collect()}
    assert rows[6, 20_000].n_removed == 20_000 and rows[5, 20_000].n_removed == 0
    assert rows[2, 0].kept is None and rows[None, 2].kept == "null id"
    assert substring.deduplicate(none).count() == 0


# --- 7: decontamination ---


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_op7_equals_brute_force_and_join_path(spark):
    rng = np.random.default_rng(3)
    item = [f"w{i}" for i in range(30)]
    near = item[:10] + ["changed"] + item[11:]
    more = item[:12] + ["added", "here"] + item[12:]
    other = rng.choice([f"v{i}" for i in range(50)], 300).tolist()
    cases = {1: other[:50] + item + other[50:80], 2: other[:20] + near + other[:9], 3: more, 4: other, 5: item[:24], 6: item[:15] + other + item[15:], 7: ["na"] * 40, 8: item[:4]}
    docs = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in cases.items()] + [(9, None), (10, ""), (None, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(["na"] * 20)), (3, "too short"), (4, None)], "item_id long, text string")
    want = {}
    for i, w in cases.items():
        for k, t in ((1, item), (2, ["na"] * 20)):
            size, b = min(len(t), len(w)), shingles(t)
            for s in range(len(w) - size + 1):
                a = shingles(w[s : s + size])
                j = sum((a & b).values()) / max(1, sum((a | b).values()))
                if j >= 0.8 and j > want.get((i, k), (0, 0))[0]:
                    want[i, k] = (j, s)
    found = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontam.matches(docs, bench).collect()}
    assert found == want
    assert decontam.matches(docs.where("false"), bench).count() == 0
    assert decontam.matches(docs, bench.where("false")).count() == 0


def test_op7_finds_items_with_parts_swapped(spark):
    a, b, other = ([f"{x}{i}" for i in range(50)] for x in "abo")
    docs = spark.createDataFrame([(1, " ".join(other + b + a + other)), (2, " ".join(other + a + b)), (3, " ".join(b + other + a))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(a + b))], "item_id long, text string")
    found = {r.doc_id: (r.similarity, r.start) for r in decontam.matches(docs, bench).collect()}
    assert found == {1: (92 / 100, 50), 2: (1.0, 50)}


def test_op7_with_many_items_and_odd_rows(spark, odd):
    """10,000 items of two sizes: each planted one is found, in rows that repeat and in long texts too; clashing columns don't matter."""
    rng = np.random.default_rng(20)
    items = [[f"i{k}x{j}" for j in range(30 + k % 2)] for k in range(10_000)]
    bench = spark.createDataFrame([(k, " ".join(w), "x", 0) for k, w in enumerate(items)], "item_id long, text string, doc_id string, n int")
    some = rng.choice(10_000, 30, False)
    rows = [(int(k) + 100, " ".join([f"a{j}" for j in range(5000 if k % 7 == 0 else 20)] + items[k] + ["z"] * 9), 1, "q") for k in some]
    docs = spark.createDataFrame(rows + rows[:3] + [(1, None, 1, "q"), (None, rows[0][1], 1, "q")], "doc_id long, text string, size int, fp string")
    found = Counter((r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect())
    assert found == Counter((int(k) + 100, int(k)) for k in some)
    assert decontam.matches(odd, bench).count() == 0


def test_op7_probes_meet_within_the_radius(spark):
    rng = np.random.default_rng(21)
    pairs = []
    for k in range(40):
        a = int(rng.integers(-(1 << 63), (1 << 63) - 1))
        b = a
        for bit in rng.choice(64, 19 if k < 30 else 12, False):
            b ^= (1 << int(bit)) if bit < 63 else -(1 << 63)
        pairs.append((k, a, b))
    df = spark.createDataFrame(pairs, "k long, a long, b long")
    met = df.select("k", decontam.probes(F.col("a"), decontam.ASKED).alias("x")).join(df.select("k", decontam.probes(F.col("b"), decontam.LISTED).alias("x")), ["k", "x"])
    assert met.select("k").distinct().count() == 40


def test_op7_equals_its_sql(spark):
    import duckdb

    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(duckdb.sql(queries.ORACLE_SQL["op7_decontamination"]).fetchall())
    assert sorted(map(tuple, queries.op7_decontamination(spark, SF).collect())) == want


def test_op7_plan_has_no_python(spark):
    plan = queries.op7_decontamination(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- 9: SimHash ---


def brute_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    n = np.zeros(64, int)
    for x in s:
        n += [xxhash.xxh64_intdigest(x, 42) >> b & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * n[b] > len(s)) if s else 0


def test_op9_equals_brute_force(spark, odd, none):
    rows = [(i, t) for i, t in texts(spark)]
    prints = {i: brute_print(t) for i, t in rows}
    found = {r.doc_id: r for r in queries.op9_simhash_near_dedup(spark, SF).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == brute_components({i: [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3] for i in prints})
    strange = {(r.id, r.component) for r in simhash.near_duplicates(odd).collect()}
    assert {(2, 2), (3, 2), (4, 2), (6, 5), (7, 1)} <= strange
    assert simhash.near_duplicates(none).count() == 0


def brute_components(links):
    top = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            low = min([top[i]] + [top[j] for j in js])
            if low != top[i]:
                top[i] = low
                changed = True
    return top


def test_bit_sliced_comparison_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(12))]))
    at, mask = simhash.within(np.repeat(fps, -(-len(fps) // 64)), np.tile(np.arange(-(-len(fps) // 64)), len(fps)), simhash.planes(fps))
    got = {(a // (-(-len(fps) // 64)), 64 * (a % (-(-len(fps) // 64))) + b) for a, m in zip(at.tolist(), mask.tolist()) for b in range(64) if m >> b & 1}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert {x for x in got if x[1] < len(fps)} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (200, 200)]
    found = graph.components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()
    groups: dict = {}
    for r in found:
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(min, groups.values())) == [0, 100, 200] and sorted(map(len, groups.values())) == [1, 20, 41]


# --- 2: embeddings ---


def test_op2_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    rows = [base + s * rng.standard_normal(base.shape) for s in (0, 0.01, 0.05, 0.08)]
    v = np.concatenate([*rows, base[:5]])
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [1.0, 2.0]), (905, []), (None, base[0].tolist())]
    found = {r.id: r for r in pivots.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = n @ n.T >= 0.95
    want = near.sum(1) - 1
    got = np.array([found[i].n_links for i in range(len(v))])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()
    assert all(found[i].n_links == 0 and found[i].component == i for i in range(900, 906))
    assert [found[i].component for i in range(160, 165)] == list(range(5))


def test_lists_are_dealt_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.standard_normal((1, 8)) + 0.01 * rng.standard_normal((60, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(pivots, "BLOCK", 7)
    assert {(r.n_links, r.component) for r in pivots.near_duplicates(rows).collect()} == {(59, 0)}
    assert pivots.near_duplicates(rows.where("false")).count() == 0


def test_recall_just_above_the_threshold(spark):
    """20,000 vectors; each of 4,000 has a partner at a cosine of 0.95 to 0.97, in clusters and alone."""
    rng = np.random.default_rng(15)
    centre = rng.standard_normal((200, 48))
    base = centre[rng.integers(0, 200, 16_000)] + 1.2 * rng.standard_normal((16_000, 48))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(base)
    c = rng.uniform(0.9501, 0.97, (4000, 1))
    side = rng.standard_normal((4000, 48))
    side = unit(side - (side * base[:4000]).sum(1, keepdims=True) * base[:4000])
    v = np.concatenate([base, c * base[:4000] + np.sqrt(1 - c * c) * side])
    near = [np.flatnonzero(row >= 0.95) for k in range(0, len(v), 2000) for row in v[k : k + 2000] @ v.T]
    want = np.array([len(x) - 1 for x in near])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = np.zeros(len(v))
    for r in pivots.near_duplicates(df).collect():
        got[r.id] = r.n_links
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() and want.sum() >= 8000


def test_vectors_of_several_lengths_and_ids_that_repeat(spark):
    rng = np.random.default_rng(16)
    long, short = rng.standard_normal((200, 12)), rng.standard_normal((5, 3))
    data = [(i, x.tolist(), i) for i, x in enumerate(long)] + [(300 + i, x.tolist(), i) for i, x in enumerate([*short, *short * 2])] + [(500, [1.0] * 20, 0), (501, [1.0] * 20, 0), (501, [-1.0, 1.0], 0), (500, [-1.0, 1.0], 0)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>, n long")
    found = {}
    for r in pivots.near_duplicates(rows).collect():
        found.setdefault(r.id, []).append((r.n_links, r.component))
    for i in range(5):
        assert found[300 + i] == [(1, 300 + i)] and found[305 + i] == [(1, 300 + i)]
    assert found[500] == found[501] == [(1, 500), (1, 500)]


def test_permutations_are_ordered():
    rng = np.random.default_rng(17)
    v, p = pivots.normal(rng.standard_normal((50, 6))), pivots.normal(rng.standard_normal((30, 6)))
    found = pivots.permutations(v, p)
    assert (found == np.argsort(-(v @ p.T), axis=1, kind="stable")[:, : pivots.NEAREST]).all()
    brute = [[len(set(a) & set(b)) for b in found] for a in found[:10]]
    assert (pivots.shared_counts(found[:10], found) == brute).all()


# --- 3, 8, 10: trained classifiers ---


def test_op3_finds_planted_lines(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licenses.fit(docs)
    planted = {1: "Released under the MIT License.", 2: "plain words\nLicensed under the Apache License, Version 2.0.\nmore", 3: "Licensed under CC BY-NC 4.0.", 4: "This work is licensed under the GNU General Public License, version 3.", 5: " ".join(["filler"] * 300) + " This project is licensed under the terms of the MIT license. " + " ".join(["filler"] * 300), 6: "He was released under strict conditions from the general public hospital."}
    rows = licenses.scan(spark.createDataFrame(list(planted.items()), "doc_id long, text string"), model).collect()
    assert {(r.id, r.line, r.family) for r in rows} == {(1, 0, "MIT"), (2, 1, "Apache"), (3, 0, "CC-BY-NC"), (4, 0, "GPL"), (5, 0, "MIT")}
    assert licenses.scan(odd, model).count() == 0 and licenses.scan(none, licenses.fit(none)).count() == 0


def test_op3_finds_reserved_rights(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = {1: "All rights reserved.", 2: "plain words\nCopyright (c) 2021 by Foo Inc. All rights reserved.\nmore", 3: "Copyright 1999 Jane Roe. All rights reserved.", 4: "All rights of way are reserved for visitors.", 5: "We have all rights to the garden and reserved seats."}
    lines = {i for i, t in texts(spark) for x in (t or "").split("\n") if x == "All rights reserved."}
    model = licenses.fit(docs)
    rows = licenses.scan(spark.createDataFrame(list(planted.items()), "doc_id long, text string"), model).collect()
    assert {(r.id, r.line, r.family) for r in rows} == {(1, 0, "Proprietary"), (2, 1, "Proprietary"), (3, 0, "Proprietary")}
    assert lines and lines <= {r.id for r in licenses.scan(docs, model).where("family = 'Proprietary'").collect()}


def test_op3_finds_wrapped_notices_and_two_in_a_line(spark):
    model = licenses.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    gpl = "# This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU General Public\n# License as published by the Free Software Foundation."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    two = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    planted = {1: f"some words\n\n{gpl}\n", 2: bsd, 3: two, 4: "Released under the\n\nMIT License.", 5: "the words of the day\n" * 40 + "Released under\nthe MIT License.\n" + "the words of the day\n" * 40}
    rows = licenses.scan(spark.createDataFrame(list(planted.items()), "doc_id long, text string"), model).collect()
    assert sorted((r.id, r.line, r.family) for r in rows) == [(1, 2, "GPL"), (2, 0, "BSD"), (3, 0, "Apache"), (3, 0, "MIT"), (5, 40, "MIT")]


def test_op3_tells_grants_from_mentions(spark):
    model = licenses.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    planted = {
        1: 'This file is not licensed under the Apache License, Version 2.0.', 2: "We do not use the MIT License in any of our projects.", 3: "// SPDX-License-Identifier: Apache-2.0", 4: "# SPDX-License-Identifier: MIT\nsome code",
        5: "This project is not licensed under the terms of the MIT license.", 6: "It was never released under the MIT License. Licensed under the Apache License, Version 2.0.",
        7: "Do not remove these lines, which belong to every file.\n\nLicensed under the Apache License, Version 2.0.", 8: "word " * 30_000 + "Released under the MIT License.",
    }
    rows = licenses.scan(spark.createDataFrame([*planted.items(), (None, "Released under the ISC License.")], "doc_id long, text string"), model).collect()
    found = {(r.id, r.family) for r in rows}
    assert found == {(3, "Apache"), (4, "MIT"), (6, "Apache"), (7, "Apache"), (8, "MIT"), (None, "ISC")}


def test_license_places_miss_no_window():
    rng = np.random.default_rng(12)
    places = licenses.Places()
    pool = [w for ts in licenses.TEMPLATES.values() for t in ts for w in licenses.tokens(t.encode())]
    for _ in range(40):
        words = [w for k in rng.integers(0, len(pool), 12).tolist() for w in (pool[k : k + 14] if k % 2 else [b"other"])]
        para = np.sort(rng.integers(0, 3, len(words)))
        got = set(places(np.array([licenses.bucket(w) for w in words], np.uint64), para))
        for (family, *_, sizes), t in zip(places.templates, [t for ts in licenses.KNOWN.values() for t in ts]):
            enough = lambda a, b: len(licenses.grams(words[a:b]) & t) >= licenses.CONTAINED * len(t)
            for size in sizes:
                for a in range(len(words)):
                    b = min(a + size, int(np.searchsorted(para, para[a], "right")))
                    assert not enough(a, b) or any(f == family and a <= x < b and enough(x, y) for f, x, y in got)


def test_license_classifier_on_held_out_variants():
    rows, names = licenses.material([(x, x) for x in (b"plain words of any kind stand here", b"nothing to see in this line at all")], variants=30, seed=11)
    model = licenses.Classifier()
    feats = [licenses.features(np.array([licenses.bucket(w) for w in r], np.uint64)) for r in rows]
    label = np.array([model.classes.index(n) for n in names])
    half = len(rows) // 2
    model.fit(feats[:half], label[:half])
    right = [model.logits(f).argmax() == y for f, y in zip(feats[half:], label[half:])]
    assert np.mean(right) > 0.9


def test_op10_names_held_out_languages(spark, odd, none):
    rows = queries.op10_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == 200 and np.mean(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    windows = np.frombuffer(b"".join(langid.draw(b"the cat and the dog", 1) + langid.draw("der Hund und die Katze".encode(), 1)), np.uint8).reshape(-1, langid.WINDOW)
    model = langid.train(windows, np.array([1, 0]), ["de", "en"], per_class=200, epochs=1)
    found = Counter((r.id, r.lang_pred) for r in langid.identify(odd, model, carry=("fp",)).select("lang_pred", "id").collect())
    assert sum(found.values()) == len(ROWS)
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


@pytest.fixture(scope="module")
def language_model(spark):
    return langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_states_cross_white_space(language_model):
    model = language_model
    one, two = (model.positions(np.frombuffer(t, np.uint8)[None])[0] for t in (b"schlich und the", b"the and the the"))
    assert np.abs(one[-3] - two[-3]).max() > 1e-4  # the same word after other words
    assert np.abs(one[0] - two[0]).max() > 1e-4


def test_segments_equal_a_run_over_the_whole_text(spark, language_model):
    model = language_model
    some = [t.encode() for _, t in texts(spark)[:40]] + [b"", b"a", LONG.encode()[:5000]]
    found = model.pooled(some)
    for t, p in zip(some, found):
        whole = b" ".join(t.split())
        if whole:
            brute = np.exp(model.positions(np.frombuffer(whole, np.uint8)[None])[0])[:, :-1].mean(0)
            assert np.abs(brute - p).max() < 0.01
        else:
            assert not p.any()


def test_noise_scores_low(spark, language_model):
    rng = np.random.default_rng(1)
    junk = [bytes(rng.choice(np.frombuffer(b"0123456789abcdef", np.uint8), 300)), "Это предложение на другом языке и с другими буквами".encode(), b"zxq wvk qqj xkz " * 20]
    assert (language_model.pooled(junk).max(1) < 0.1).all()
    clean = [t.encode() for _, t in texts(spark)]
    assert np.mean(language_model.pooled(clean).max(1) < 0.1) < 0.02


def test_windows_are_drawn_from_the_whole_text():
    text = b" ".join(b"%06d" % i for i in range(1000))
    at = [text.index(w) for k in range(50) for w in langid.draw(text, k)]
    assert min(at) < 500 and max(at) > len(text) - 500


def test_gru_gradients_match_differences():
    model = langid.ByteGRU(["a", "b"], hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = np.array([[97, 98, 99], [100, 97, 97]], np.uint8), np.array([[0, 1, 0], [1, 1, 0]])
    loss = lambda: -np.mean([model.positions(x)[i, t, y[i, t]] for i in range(2) for t in range(3)])
    grad = model.gradients(x, y)
    for k, at in (("xf", (97, 2)), ("uf", (1, 4)), ("ub", (2, 7)), ("bb", (5,)), ("w", (3, 1)), ("o", (0,))):
        old = model.p[k][at]
        model.p[k][at] = old + 1e-3
        up = loss()
        model.p[k][at] = old - 1e-3
        down = loss()
        model.p[k][at] = old
        assert abs((up - down) / 2e-3 - grad[k][at]) < 1e-3


def test_op8_learns_marked_words(spark, odd, none):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    text = lambda bad: " ".join([*rng.choice(words, 40), *(["nasty!", "Vile"] if bad else []), *rng.choice(words, 40)])
    data = [(i, text(i % 4 == 0), "en") for i in range(800)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, None)
    found = {r.id: r.score >= toxicity.AT for r in toxicity.score(docs, model, None).collect()}
    assert np.mean([found[i] == (i % 4 == 0) for i in range(500, 800)]) > 0.95
    assert toxicity.score(odd, model, None).count() == len(ROWS)
    assert toxicity.score(none, toxicity.fit(none, labels, None), None).count() == 0


def test_convolution_equals_brute_force():
    rng = np.random.default_rng(4)
    model = toxicity.TextCNN()
    some = [rng.integers(1, 500, n).astype(np.int32) for n in (0, 1, 2, 3, 40, 0, 7)]
    flat, start = toxicity.side_by_side(some)
    found = model.logits(model.project(flat), start)
    for t, y in zip(some, found):
        e = np.concatenate([np.zeros((3, toxicity.DIM)), model.e[t], np.zeros((3, toxicity.DIM))])
        best = [max(float((e[p : p + n] * w[:, :, f]).sum()) for p in range(len(e) - n + 1)) for n, w in zip(toxicity.WIDTHS, model.w) for f in range(toxicity.FILTERS)]
        assert abs(model.logit(np.array(best)) - y) < 1e-3


def test_op8_reads_words_far_behind_the_start(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    text = lambda bad: " ".join([*rng.choice(words, 6000), *(["nasty!"] if bad else []), *rng.choice(words, 20)])
    docs = spark.createDataFrame([(i, text(i % 2 == 0)) for i in range(160)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, None)
    found = {r.id: r.score >= toxicity.AT for r in toxicity.score(docs, model, None).collect()}
    assert np.mean([found[i] == (i % 2 == 0) for i in range(120, 160)]) > 0.9


def test_bounded_sample_with_ids_that_repeat(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("id"), F.col("id").alias("x"))
    for n in (10, 500):
        assert bounded_sample(rows, n, "id").count() == n


def test_split_join_equals_join(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    table = rows.where("k % 2 = 1").groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("y"))
    for how in ("inner", "left"):
        found = sorted(map(tuple, split_join(rows, table, ["k"], how).select("k", "x", "y").collect()), key=str)
        assert found == sorted(map(tuple, rows.join(table, "k", how).select("k", "x", "y").collect()), key=str)


def test_smallest_over_ranges_of_all_widths():
    rng = np.random.default_rng(12)
    seqs = [rng.integers(1, 50, 37) for _ in range(40)]
    index = fmindex.FMIndex(seqs, rng.permutation(40).astype(np.int32), 8)
    low = rng.integers(0, index.n, 3000)
    high = np.minimum(low + rng.integers(1, 900, 3000), index.n)
    assert index.smallest(low, high).tolist() == [index.owner[a:b].min() for a, b in zip(low, high)]


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 3)
    fps = sorted({int(base[k % 3]) ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 5)), False)) for k in range(300)})
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    sets = []
    for crowd in (2, 4096):
        top = {f: f for f in fps}
        find = lambda x: x if top[x] == x else find(top[x])
        for r in simhash.fingerprint_links(distinct, crowd=crowd).collect():
            top[find(r.a)] = find(r.b)
        sets.append(frozenset(frozenset(g for g in fps if find(g) == find(f)) for f in fps))
    top = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                top[find(a)] = find(b)
    assert sets[0] == sets[1] == frozenset(frozenset(g for g in fps if find(g) == find(f)) for f in fps)
