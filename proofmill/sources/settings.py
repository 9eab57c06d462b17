"""Nested settings as tables of paths: JSON to paths by VARIANT, merges of many owners' settings, values by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored


def paths(df: DataFrame, owner: str, json: str) -> DataFrame:
    """(owner, path, value): the leaves of each row's JSON object; path is the array of its keys, value its own JSON.

    Arrays and empty objects are leaves. Objects are opened level by level, all rows at once, so there are as many passes as
    the deepest has levels. Rows that aren't JSON objects have no path.
    """
    open_ = df.select(owner, F.array().cast("array<string>").alias("path"), F.col(json).cast("string").alias("value"))
    parts = []
    while True:
        rows = open_.withColumn("v", F.try_parse_json("value")).where(F.col("v").isNotNull())
        if not parts:
            rows = rows.where(F.schema_of_variant("v").startswith("OBJECT"))
        one = df.sparkSession.tvf.variant_explode(F.col("v").outer())
        each = explode(rows, one, owner)
        each = stored(each, "paths")
        more = F.col("kind").startswith("OBJECT<") & (F.col("kind") != "OBJECT<>")
        parts.append(each.where(~more).drop("kind"))
        open_ = each.where(more).drop("kind")
        if open_.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explode(rows: DataFrame, one, owner: str) -> DataFrame:
    rows = rows.withColumnRenamed("value", "text")
    joined = rows.lateralJoin(one)
    return joined.select(owner, F.concat("path", F.array("key")).alias("path"), F.to_json("value").alias("value"), F.schema_of_variant("value").alias("kind"))


def prefixes(path: Column) -> Column:
    """The proper prefixes of a path, the empty one left out."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(path) - 1, F.lit(1))), lambda n: F.when(F.size(path) > 1, F.slice(path, 1, n)))


def merged(base: DataFrame, over: DataFrame, owner: str) -> DataFrame:
    """(owner, path, value) of base with over put on it, both as paths() gives them.

    Objects are merged key by key; anything else of over takes the place of what base has there, a null too: a value of over
    hides the paths of base below it, and an object of over the value of base that stands where it begins.
    """
    over = over.withColumn("rank", F.lit(1))
    rows = base.withColumn("rank", F.lit(0)).unionByName(over)
    top = rows.groupBy(owner, "path").agg(F.max(F.struct("rank", "value")).alias("x"))
    top = top.select(owner, "path", "x.rank", "x.value")
    same = lambda a, b: F.col(f"{a}.{owner}").eqNullSafe(F.col(f"{b}.{owner}"))
    opened = over.select(owner, F.explode(prefixes(F.col("path"))).alias("begin")).where("begin IS NOT NULL").distinct()
    kept = top.alias("t").join(opened.alias("o"), same("t", "o") & (F.col("t.path") == F.col("o.begin")) & (F.col("t.rank") == 0), "left_anti")
    below = base.select(owner, "path", F.explode(prefixes(F.col("path"))).alias("begin")).where("begin IS NOT NULL")
    hidden = below.alias("b").join(over.alias("o"), same("b", "o") & (F.col("b.begin") == F.col("o.path")), "left_semi").select(owner, "path").distinct()
    kept = kept.alias("t").join(hidden.alias("h"), same("t", "h") & (F.col("t.path") == F.col("h.path")) & (F.col("t.rank") == 0), "left_anti")
    return kept.select(owner, "path", "value")


def value_at(found: DataFrame, dotted: str) -> DataFrame:
    """The rows of paths() at a path, written with dots between its keys."""
    return found.where(F.array_join("path", ".") == dotted)
