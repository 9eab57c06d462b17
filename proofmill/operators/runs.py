"""Formatting runs of leaves: lookups, predicates, spans with absolute offsets, and runs after edits.

A run is a struct with text, start and end in its leaf, and formats; see sources.office.RUN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAGS = ("bold", "italic", "underline", "strikethrough")


def or_plain(runs: Column, text: Column, kind: str) -> Column:
    """The leaf's runs, or one plain run over its whole text where it has none. kind: the type of a run."""
    names = [part.split(":")[0] for part in kind.removeprefix("struct<").removesuffix(">").split(",")]
    known = {"text": text, "start": F.lit(0), "end": F.length(text)} | {f: F.lit(False) for f in FLAGS}
    plain = F.struct(*(known.get(n, F.lit(None)).alias(n) for n in names)).cast(kind)
    return F.when(F.coalesce(F.size(runs), F.lit(0)) > 0, runs).otherwise(F.array(plain))


def at_offset(runs: Column, place: Column) -> Column:
    """The run that covers a place of the leaf, or null."""
    return F.get(F.filter(runs, lambda r: (r["start"] <= place) & (place < r["end"])), 0)


def is_highlighted(run: Column) -> Column:
    return F.coalesce(~F.lower(run["highlight"]).isin("", "none"), F.lit(False))


def is_linked(run: Column) -> Column:
    return F.coalesce(run["hyperlink"] != "", F.lit(False))


def is_formatted(run: Column) -> Column:
    """Bold, italic, underlined, struck through, highlighted or linked."""
    out = is_highlighted(run) | is_linked(run)
    for f in FLAGS:
        out = out | F.coalesce(run[f], F.lit(False))
    return out


def spans(el: DataFrame, of) -> DataFrame:
    """(doc_id, idx, start_offset, end_offset, text, run) of the runs for which of holds, offsets in the whole document."""
    rows = el.where(F.col("runs").isNotNull()).select("doc_id", "idx", "start_offset", F.explode(F.filter("runs", of)).alias("run"))
    at = lambda c: (F.col("start_offset") + F.col(f"run.{c}")).cast("long")
    return rows.select("doc_id", "idx", at("start").alias("start_offset"), at("end").alias("end_offset"), "run.text", "run")


def highlighted_spans(el: DataFrame) -> DataFrame:
    return spans(el, is_highlighted)


def linked_spans(el: DataFrame) -> DataFrame:
    return spans(el, is_linked).withColumn("url", F.col("run.hyperlink"))


def after_fixes(leaves: DataFrame) -> DataFrame:
    """(doc_id, idx, runs) of leaves (doc_id, idx, runs, fixes) after their sorted, disjoint fixes (struct<s, e, fix>).

    Runs before a fix stay, runs behind it shift, others are cut; a fix takes the formats of the run with which it overlaps
    most, the first of equals, and an insertion those of the run around it. A leaf of which nothing is left has no row.
    Leaves stay where they are: nothing is shuffled, and a batch of them is cut at once (cut_runs).
    """
    rows = leaves.select("doc_id", "idx", "runs", "fixes")
    kind = T.StructType(rows.schema.fields[:3])

    def run(batches):
        for batch in batches:
            yield cut_runs(batch)

    return rows.mapInArrow(run, kind)


def cut_runs(batch):
    """after_fixes of a record batch. Leaves stand one behind the other on one line; the borders of runs and fixes cut it."""
    import numpy as np
    import pyarrow as pa

    def flat(name):
        lists = batch.column(batch.schema.get_field_index(name))
        n = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        return lists.flatten(), np.repeat(np.arange(len(n)), n)

    numbers = lambda part, c: np.asarray(part.field(c), dtype=np.int64)
    runs, of = flat("runs")
    fixes, leaf = flat("fixes")
    names = [f.name for f in runs.type]
    start, end, s, e = numbers(runs, "start"), numbers(runs, "end"), numbers(fixes, "s"), numbers(fixes, "e")
    size = np.zeros(batch.num_rows, np.int64)
    for at, to in ((of, end), (leaf, e)):
        np.maximum.at(size, at, to)
    base = np.concatenate([[0], np.cumsum(size + 1)])
    start, end, s, e = start + base[of], end + base[of], s + base[leaf], e + base[leaf]
    words, texts = fixes.field("fix").to_pylist(), runs.field("text").to_pylist()
    total = np.concatenate([[0], np.cumsum(np.array([len(w) for w in words], np.int64) - (e - s))])
    first = np.searchsorted(leaf, np.arange(batch.num_rows))
    grown = lambda at, own: total[np.searchsorted(e, at, "right")] - total[first[own]]
    full = np.flatnonzero(end > start)
    full = full[np.argsort(start[full], kind="stable")]
    wide, points = np.flatnonzero(e > s), np.flatnonzero(e == s)

    def around(at, rows, begin, stop):
        """The last of rows that begins at a place or before and reaches beyond it, or -1."""
        if not len(rows):
            return np.full(len(at), -1)
        i = np.searchsorted(begin[rows], at, "right") - 1
        found = rows[np.maximum(i, 0)]
        return np.where((i >= 0) & (stop[found] > at), found, -1)

    borders = np.unique(np.concatenate([start[full], end[full], s, e]))
    at, to = borders[:-1], borders[1:]
    run, fix = around(at, full, start, end), around(at, wide, s, e)
    kept, fixed = np.flatnonzero((run >= 0) & (fix < 0)), np.flatnonzero((run >= 0) & (fix >= 0))
    # of each fix the run with the largest share
    order = fixed[np.lexsort((run[fixed], at[fixed] - to[fixed], fix[fixed]))]
    best = order[np.unique(fix[order], return_index=True)[1]] if len(order) else order
    bare = np.flatnonzero(end == start)
    over = around(start[bare], wide, s, e)
    bare = bare[(over < 0) | (s[np.maximum(over, 0)] >= start[bare])]
    held = around(s[points], full, start, end)
    points, held = points[(held >= 0) & (start[held] < s[points])], held[(held >= 0) & (start[held] < s[points])]
    put, main = np.concatenate([fix[best], points]), np.concatenate([run[best], held])
    kept_at, kept_to, kept_run = at[kept], to[kept], run[kept]
    text = [texts[r][a:b] for r, a, b in zip(kept_run.tolist(), (kept_at - start[kept_run]).tolist(), (kept_to - start[kept_run]).tolist())]
    text += [""] * len(bare) + [words[f] for f in put.tolist()]
    who = np.concatenate([kept_run, bare, main])
    # a fix stands where it began, moved by the fixes before it
    place = np.concatenate([kept_at + grown(kept_at, of[kept_run]), start[bare] + grown(start[bare], of[bare]), s[put] + total[put] - total[first[leaf[put]]]])
    length = np.array([len(t) for t in text], np.int64)
    stays = np.concatenate([np.ones(len(kept) + len(bare), bool), length[len(kept) + len(bare) :] > 0])
    order = np.lexsort((who, length, place, of[who]))
    order = order[stays[order]]
    who, place, length = who[order], (place - base[of[who]])[order], length[order]
    made = {"text": pa.array([text[i] for i in order.tolist()], pa.string()), "start": pa.array(place, pa.int32()), "end": pa.array(place + length, pa.int32())}
    taken = pa.array(who)
    parts = [made[n] if n in made else runs.field(n).take(taken) for n in names]
    owner = of[who]
    some = np.unique(owner)
    ends = np.concatenate([np.searchsorted(owner, some), [len(owner)]])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names))
    rows = pa.array(some)
    return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), lists], ["doc_id", "idx", "runs"])
