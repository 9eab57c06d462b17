"""Applying fixes: validation, conflict resolution, splicing, runs, and new offsets. Everything is per document or leaf."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slice_text
from ..sources.corpus import with_offsets
from .findings import has_fix


def candidates(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("auto_applicable") & has_fix())


def validated(findings: DataFrame, el: DataFrame) -> DataFrame:
    """Candidates with valid: whether the leaf's text at the span is what the finding saw."""
    leaf = el.select("doc_id", "idx", F.col("text").alias("leaf"), F.col("start_offset").alias("leaf_start"))
    rows = candidates(findings).join(leaf, ["doc_id", "idx"], "left")
    return rows.withColumn("valid", F.coalesce(slice_text(F.col("leaf"), (F.col("start_offset") - F.col("leaf_start")).cast("int"), (F.col("end_offset") - F.col("leaf_start")).cast("int")) == F.col("original_text"), F.lit(False)))


#: So many fixes are taken at a time.
STEP = 4096


def resolved(checked: DataFrame, step: int = STEP) -> DataFrame:
    """Each candidate with its status: skipped (invalid), applied, or downgraded with the applied one it overlaps.

    In a document, fixes are taken in the order of start and ordinal unless they overlap one taken before. Insertions block
    nothing; they go where the last fix taken before them reaches beyond their place. A sweep: the fixes are shuffled and sorted
    once and stream through a task, which remembers the last one taken and nothing else.
    """
    rows = checked.drop("leaf")
    kind = T.StructType([*rows.schema.fields, T.StructField("status", T.StringType()), T.StructField("conflicts_with", T.StringType())])

    def sweep(batches):
        import pyarrow as pa

        doc = end = start = key = None
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                status, by = [], []
                for d, valid, s, e, k in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "valid", "start_offset", "end_offset", "finding_key"))):
                    if d != doc:
                        doc, start, end, key = d, None, None, None
                    if not valid or e < s:
                        status.append("skipped")
                        by.append(None)
                    elif end is not None and (s < end if e > s else start < s < end):
                        status.append("downgraded")
                        by.append(key)
                    else:
                        status.append("applied")
                        by.append(None)
                        if e > s:
                            start, end, key = s, e, k
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(status, pa.string()), pa.array(by, pa.string())], [*batch.schema.names, "status", "conflicts_with"])

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "start_offset", "ordinal").mapInArrow(sweep, kind)


#: So many leaves are taken at a time.
LEAVES = 512


def resolved_in_leaves(leaves: DataFrame, fixes: Callable, step: int = LEAVES) -> DataFrame:
    """(doc_id, start_offset, held) of fixes that are cut out of the leaves themselves; held: where the applied one begins that it overlaps.

    leaves: doc_id, start_offset and what fixes needs. fixes(batch) gives three arrays: a fix's leaf in the batch, start and end
    in that leaf, in this order and not empty. Fixes inside different leaves can't overlap, so each leaf is settled where it is:
    nothing is joined, shuffled or sorted. resolved takes fixes from tables, checks their texts and has insertions.
    """
    kind = T.StructType([leaves.schema["doc_id"], T.StructField("start_offset", T.LongType()), T.StructField("held", T.LongType())])

    def settle(batches):
        import numpy as np
        import pyarrow as pa

        def holders(starts, ends):
            """Of fixes in the order of start, none of them empty: the place of the one taken before that each overlaps, -1 for those taken.

            Behind one that is taken the next is the first that begins at its end or later; only those taken are walked.
            """
            behind, at, i = np.searchsorted(starts, ends).tolist(), [], 0
            while i < len(behind):
                at.append(i)
                i = behind[i]
            last = np.zeros(len(behind), np.int64)
            last[at] = at
            last = np.maximum.accumulate(last)
            last[at] = -1
            return last

        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                leaf, s, e = fixes(batch)
                if not len(leaf):
                    continue
                # the leaves of a batch one after the other, each as wide as its fixes reach
                first = np.flatnonzero(np.diff(leaf, prepend=-1))
                wide = np.zeros(batch.num_rows + 1, np.int64)
                wide[leaf[first] + 1] = np.maximum.reduceat(e, first)
                base = np.cumsum(wide)[leaf]
                by = holders(base + s, base + e)
                start = batch.column("start_offset").to_numpy()[leaf] + s
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(leaf)), pa.array(start, pa.int64()), pa.array(start[by], pa.int64(), mask=by < 0)], kind.names)

    return leaves.mapInArrow(settle, kind)


def splice(text: Column, fixes: Column) -> Column:
    """Text with sorted, disjoint fixes (struct<s, e, fix>) in place: gaps and fixes one after the other."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(x["e"].alias("at"), F.concat(acc["out"], slice_text(text, acc["at"], x["s"]), x["fix"]).alias("out"))
    return F.aggregate(fixes, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def applied(el: DataFrame, judged: DataFrame) -> DataFrame:
    """The elements with applied fixes, new offsets and, where they have any, runs that follow; other leaves stay as they are."""
    local = judged.where("status = 'applied'").select("doc_id", "idx", F.struct((F.col("start_offset") - F.col("leaf_start")).cast("int").alias("s"), (F.col("end_offset") - F.col("leaf_start")).cast("int").alias("e"), F.col("proposed_text").alias("fix")).alias("x"))
    fixes = local.groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list("x")).alias("fixes"))
    rows = el.join(fixes, ["doc_id", "idx"], "left").withColumn("text", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("fixes"))))
    if "runs" in el.columns:
        from .runs import after_fixes

        new = after_fixes(rows.where("fixes IS NOT NULL AND runs IS NOT NULL").select("doc_id", "idx", "runs", "fixes"))
        rows = rows.join(new.withColumnRenamed("runs", "new"), ["doc_id", "idx"], "left")
        empty = F.when(F.col("runs").isNotNull(), F.slice("runs", 1, 0))
        rows = rows.withColumn("runs", F.when(F.col("fixes").isNull(), F.col("runs")).otherwise(F.coalesce("new", empty))).drop("new")
    return with_offsets(rows.drop("fixes")).select(*el.columns)


def adjust_runs(runs: Column, s: Column, e: Column, fix: Column) -> Column:
    """Formatting runs (struct with text, start, end and formats) after one fix at [s, e).

    Runs before it stay, runs behind it shift, others are trimmed or split; the fix takes the formats of the run with
    which it overlaps most, the first of equals.
    """
    grow = F.length(fix) - (e - s)
    put = lambda r, text, start: r.withField("text", text).withField("start", start).withField("end", start + F.length(text))
    touch = lambda r: (r["start"] < e) & (r["end"] > s)
    share = lambda r: F.least(r["end"], e) - F.greatest(r["start"], s)
    most = F.array_max(F.transform(F.filter(runs, touch), share))
    main = F.get(F.filter(runs, lambda r: touch(r) & (share(r) == most)), 0)
    left = F.transform(F.filter(runs, lambda r: touch(r) & (r["start"] < s)), lambda r: put(r, F.substring(r["text"], F.lit(1), s - r["start"]), r["start"]))
    right = F.transform(F.filter(runs, lambda r: touch(r) & (r["end"] > e)), lambda r: put(r, F.substring(r["text"], e - r["start"] + 1, F.length(r["text"])), s + F.length(fix)))
    middle = F.when(main.isNotNull() & (F.length(fix) > 0), F.array(put(main, fix, s))).otherwise(F.filter(runs, lambda r: F.lit(False)))
    before = F.filter(runs, lambda r: r["end"] <= s)
    behind = F.transform(F.filter(runs, lambda r: r["start"] >= e), lambda r: put(r, r["text"], r["start"] + grow))
    return F.concat(before, left, middle, right, behind)


def blank_rows(el: DataFrame) -> DataFrame:
    """Elements before which a blank row is due: neither it nor the one before is empty, and they aren't both cells."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    rows = el.withColumn("pt", F.lag("text").over(w)).withColumn("pk", F.lag("elem_type").over(w))
    return rows.where("pt IS NOT NULL AND trim(text) <> '' AND trim(pt) <> '' AND NOT (elem_type = 'table_cell' AND pk = 'table_cell')").select("doc_id", "idx")
