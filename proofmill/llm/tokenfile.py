"""Token files: whole texts as token ids in binary files, coded by the range coder of rangecoder.py.

A file is the magic PMT2, blocks, an id table, a document table and a footer. A block is its number of ids, the length of
its code, the crc32 of its ids (little-endian unsigned 32-bit) and the code; blocks have equal lengths and are coded
independently, each from the state that the id table gives: Zstandard over the file's distinct ids, as differences, and the
steps of their counts. The document table, Zstandard over doc_id and count columns, keeps document borders. The footer has the tables' place and
crc32. Documents follow each other in ascending id order within a file and from one file of the manifest to the next.

Null texts are documents of the end id alone. A null doc_id sorts first; rows that share an id follow each other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files, rangecoder
from .bytebpe import ranges
from .common import new_path, record, stored
from .tokens import encoder_of

MAGIC, END = b"PMT2", b"2TMP"
BLOCK, FOOTER = struct.Struct("<III"), struct.Struct("<QIIIIIQ4s")
#: Bytes of texts that are encoded together.
AT_ONCE = 4 << 20
FILE_TOKENS, LANES, SHORTEST, LONGEST = 4_000_000, 1024, 2048, 8192


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    return pack_files([(doc_ids, ids)])[0]


def pack_files(some: list[tuple[list[int | None], list[np.ndarray]]]) -> list[bytes]:
    """Files of the documents of each pair (document ids, token ids), with blocks of one length, coded together."""
    flats = [np.concatenate(ids) for _, ids in some]
    length = max(min(len(x), LONGEST, max(SHORTEST, -(-len(x) // LANES))) for x in flats)
    parts = []
    for flat in flats:
        order0 = rangecoder.Order0.of(flat)
        padded = np.full(-(-len(flat) // length) * length, order0.ids[0], np.uint32)
        padded[: len(flat)] = flat
        parts.append((padded.reshape(-1, length), order0))
    return [file_of(doc_ids, ids, flat, codes, *part) for (doc_ids, ids), flat, codes, part in zip(some, flats, rangecoder.encode_files(parts), parts)]


def file_of(doc_ids: list[int | None], ids: list[np.ndarray], flat: np.ndarray, codes: list[bytes], padded: np.ndarray, order0: rangecoder.Order0) -> bytes:
    blocks, length = padded.shape
    out = [MAGIC]
    for k, code in enumerate(codes):
        part = flat[k * length : (k + 1) * length]
        out += [BLOCK.pack(len(part), len(code), crc(part)), code]
    known = np.array([i is not None for i in doc_ids])
    columns = (np.array([i or 0 for i in doc_ids], "<i8"), np.array([len(x) for x in ids], "<u4"), known.astype(np.uint8))
    table = zstandard.compress(struct.pack("<Q", len(doc_ids)) + b"".join(c.tobytes() for c in columns))
    ids_table = zstandard.compress(np.diff(order0.ids, prepend=np.uint32(0)).astype("<u4").tobytes() + order0.steps.tobytes(), 9)
    at = sum(map(len, out))
    return b"".join([*out, ids_table, table, FOOTER.pack(at, len(ids_table), len(table), zlib.crc32(ids_table + table), length, blocks, len(flat), END)])


def halves(sizes: list[int], file_tokens: int) -> list[slice]:
    """The documents of one file or, if their ids are too many, of two of much the same size."""
    upto = np.cumsum(sizes)
    cut = min(int(np.searchsorted(upto, upto[-1] / 2)) + 1, len(sizes) - 1)
    return [slice(0, cut), slice(cut, None)] if cut and upto[-1] > file_tokens * 5 // 4 else [slice(None)]


def unpack_file(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Document ids and their token ids; raises ValueError where a checksum differs."""
    return next(unpack_files([opened(data)]))


def opened(data: bytes) -> tuple[tuple[list[bytes], int, rangecoder.Order0], list[tuple[int, int, int]], bytes, int]:
    """What the coder needs, the heads of the blocks, the document table and the number of ids."""
    at, first, size, check, length, blocks, total, end = FOOTER.unpack(data[-FOOTER.size :])
    table = data[at + first : at + first + size]
    if data[:4] != MAGIC or end != END or zlib.crc32(data[at : at + first] + table) != check:
        raise ValueError("not a token file, or a damaged one")
    codes, heads, place = [], [], len(MAGIC)
    for _ in range(blocks):
        heads.append(BLOCK.unpack_from(data, place))
        place += BLOCK.size
        codes.append(data[place : place + heads[-1][1]])
        place += heads[-1][1]
    known = zstandard.decompress(data[at : at + first])
    n = len(known) // 5
    order0 = rangecoder.Order0(np.cumsum(np.frombuffer(known, "<u4", n), dtype=np.uint32), np.frombuffer(known, np.uint8, n, 4 * n))
    return (codes, length, order0), heads, zstandard.decompress(table), total


def unpack_files(some: list[tuple]) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """What unpack_file() gives for each of several opened files."""
    for rows, (_, heads, raw, total) in zip(rangecoder.decode_files([x[0] for x in some]), some):
        for k, (n, _, c) in enumerate(heads):
            if crc(rows[k, :n]) != c:
                raise ValueError(f"block {k} is damaged")
        (n,) = struct.unpack_from("<Q", raw)
        doc_ids, counts = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n)
        known = np.frombuffer(raw, np.uint8, n, 8 + 12 * n)
        yield [int(i) if k else None for i, k in zip(doc_ids, known)], np.split(rows.ravel()[:total], np.cumsum(counts.astype(np.int64))[:-1]) if n else []


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, file_tokens: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Writes docs in ascending id order. Returns the folder and the manifest: file, first (ids before it), tokens, documents.

    Files of failed or repeated attempts aren't in the manifest. It has one row per file.
    """
    folder = new_path(docs.sparkSession, "tokens")
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("tokens", pa.int64()), ("documents", pa.int64())])

    def run(it):
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        doc_ids, ids, held, seq = [], [], 0, 0

        def flush():
            """Two files at a time where there are ids for them: a step of the coder costs little more for both than for one."""
            nonlocal doc_ids, ids, held, seq
            cuts = halves([len(x) for x in ids], file_tokens)
            for k, (cut, data) in enumerate(zip(cuts, pack_files([(doc_ids[c], ids[c]) for c in cuts]))):
                yield record(schema, [part], [seq + k], [files.write(folder, "tokens", data)], [sum(map(len, ids[cut]))], [len(ids[cut])])
            doc_ids, ids, held, seq = [], [], 0, seq + len(cuts)

        for b in it:
            for lo, hi in ranges(pc.binary_length(b.column(1)).to_pylist(), AT_ONCE):
                for i, t in zip(b.column(0).slice(lo, hi - lo).to_pylist(), encoder.encode(b.column(1).slice(lo, hi - lo))):
                    doc_ids.append(i)
                    ids.append(t)
                    held += len(t)
                    if held >= 2 * file_tokens:
                        yield from flush()
        if ids:
            yield from flush()

    text = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    made = stored(rows.mapInArrow(run, "part long, seq long, file string, tokens long, documents long"), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return folder, stored(made.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("file", "first", "tokens", "documents"), "manifest")


def read(folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if wanted, ids) of each document in the files of the manifest."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)
    spark = manifest.sparkSession
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if manifest.isEmpty():  # no file, no folder
        return spark.createDataFrame([], columns)
    found = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("file"), "content")

    def run(it):
        def rows(some):
            for first, (doc_ids, ids) in zip([f for f, _ in some], unpack_files([x for _, x in some])):
                size = np.array([len(x) for x in ids])
                start = first + np.cumsum(size) - size
                for lo in range(0, len(ids), 1000):
                    part = ids[lo : lo + 1000]
                    yield record(schema, doc_ids[lo : lo + 1000], start[lo : lo + 1000], size[lo : lo + 1000], [crc(x) for x in part], *[[x.astype("<u4").tobytes() for x in part]] * with_ids)

        encoder_of.cache_clear()  # its words would take the room of the files
        some = []
        for b in it:
            for first, content in zip(b.column(0).to_pylist(), b.column(1)):
                some.append((first, opened(content.as_py())))
                if sum(len(x[1]) for _, x in some) > LANES:  # two files of usual size
                    yield from rows(some)
                    some = []
        if some:
            yield from rows(some)

    joined = manifest.select("file", "first").join(found, "file").select("first", "content")
    return joined.mapInArrow(run, columns)
