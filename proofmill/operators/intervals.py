"""Which of many intervals stay: by priority in rounds, or in the order of their starts by pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def claimed(hits: DataFrame, rank: str, *group: str) -> DataFrame:
    """The hits that stay when, in each group, lower ranks claim their places first and overlapped hits go.

    hits have start, end and rank; of one rank the earlier ones come first. In each round a hit stays if no open hit near it has
    a lower rank and none of its own that is open overlaps it from the left, and takes the open hits it overlaps with it. The
    first hit of the lowest open rank always stays; if hits of one rank don't overlap, rounds end after as many as a group has
    ranks. Mostly there are two. All are windows over one sorting of the hits; none looks
    further than the longest hit reaches, and no group is gathered in a row.
    """
    hits = stored(hits, "hits")  # read in a round and before it; finding them costs more than storing them
    longest = hits.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    order = Window.partitionBy(*group).orderBy("start")
    near, past = order.rangeBetween(-longest, longest), Window.unboundedPreceding
    back = Window.partitionBy(*group).orderBy("start", rank).rowsBetween(past, 0)
    ahead = Window.partitionBy(*group).orderBy(F.desc("start"), F.desc(rank)).rowsBetween(past, 0)
    own = Window.partitionBy(*group, rank).orderBy("start", "end").rowsBetween(past, -1)
    spot = F.when(F.col("stays"), F.struct("start", "end"))
    parts, columns = [], hits.columns
    rows = hits.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))
    while True:
        clear = F.coalesce(F.max("end").over(own) <= F.col("start"), F.lit(True))
        rows = rows.withColumn("stays", clear & (F.col(rank) <= F.min(rank).over(near)))
        # those that stay are disjoint: the last that begins before a hit and the first behind its start tell all
        rows = rows.withColumn("left", F.last(spot, ignorenulls=True).over(back)).withColumn("right", F.last(spot, ignorenulls=True).over(ahead))
        gone = F.coalesce(F.col("left.end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("right.start") < F.col("end"), F.lit(False))
        rows = stored(rows.where(F.col("stays") | ~gone).select(*columns, "stays"), "claims")
        parts.append(rows.where("stays"))
        rows = rows.where("NOT stays").select(*columns)
        if rows.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*columns)


def next_free(spans: DataFrame, *group: str) -> DataFrame:
    """Adds next to spans (start, end, no): the no of the first one of the group that begins at its end or later.

    no counts a group's spans in the order of their starts. Ends and starts go through one descending order.
    """
    order = Window.partitionBy(*group).orderBy(F.desc("at"), "is_end", F.desc("no")).rowsBetween(Window.unboundedPreceding, 0)
    begins = spans.select(*group, F.col("start").alias("at"), F.lit(False).alias("is_end"), "no")
    ends = spans.select(*group, F.col("end").alias("at"), F.lit(True).alias("is_end"), "no", F.struct(*spans.columns).alias("span"))
    rows = ends.unionByName(begins, allowMissingColumns=True).withColumn("next", F.last(F.when(~F.col("is_end"), F.col("no")), ignorenulls=True).over(order))
    return rows.where("is_end").select("span.*", "next")


def first_come(spans: DataFrame, *group: str) -> DataFrame:
    """(group, no) of the spans that stay when each, in the order of no, stays unless it overlaps one that stayed.

    spans: start < end and no, from 1 without a gap in each group. The first stays, and after a span that stays the next one is
    the first to begin behind it: a chain, whose members are found by doubling the pointers, so that a chain of any length
    takes as many joins as its length has binary digits.
    """
    step = stored(next_free(spans, *group).select(*group, "no", "next").where("next IS NOT NULL"), "pointers")
    found = stored(spans.where("no = 1").select(*group, "no"), "chain")
    while not step.isEmpty():
        more = found.join(step, [*group, "no"]).select(*group, F.col("next").alias("no"))
        found = stored(found.unionByName(more).distinct(), "chain")
        onward = step.select(*group, F.col("no").alias("next"), F.col("next").alias("far"))
        step = stored(step.join(onward, [*group, "next"]).select(*group, "no", F.col("far").alias("next")), "pointers")
    return found
