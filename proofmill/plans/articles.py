"""Test articles: documents as articles, with signals put in by plain replacement, in Spark and as oracle SQL.

The synthetic documents have none of the words that the rules look for, so frequent words stand in for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import corpus

SIGNALS = (
    (" that ", " players can "), (" with ", " $500 USD "), (" this ", " colour "), (" from ", " €30 "), (" for ", " 25 EUR "), (" by ", "  "), (" was ", " was , "),
    ("ation ", "ation,ok "), (" in ", " e.g. "), (" are ", " moon harbor "), (" an ", " 150% welcome "), (" a ", " you "), (" it ", " however "),
)
HARD, SOFT = ["scum", "worthless", "stupid", "idiot"], ["trash", "clown", "loser"]


def injected(text):
    for a, b in SIGNALS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores (one small file, say) dealt over all of them; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))
    # a generator's column is computed once; the optimizer copies a plain one to wherever it is used
    made = F.explode(F.array(injected(F.col("text")))).alias("text")
    return corpus.from_text(docs.where("text is not null").select("doc_id", "source", "lang", made))


def sql_text() -> str:
    out = "text"
    for a, b in SIGNALS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


#: el: the elements table in DuckDB.
EL = f"""
WITH ln AS (SELECT doc_id, source AS brand, lang AS article_type, string_split({sql_text()}, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
lv AS (SELECT doc_id, brand, article_type, a[i] AS text, i - 1 AS idx FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM ln)),
el AS (SELECT doc_id, brand, article_type, CAST(idx AS BIGINT) AS idx, text,
  CASE WHEN contains(text, ' | ') THEN 'list_item' WHEN text <> '' AND len(string_split(text, ' ')) <= 3 THEN 'heading' ELSE 'paragraph' END AS elem_type,
  CASE WHEN NOT contains(text, ' | ') AND text <> '' AND len(string_split(text, ' ')) <= 3 THEN CASE WHEN idx = 0 THEN 1 ELSE 2 + length(text) % 3 END END AS level,
  CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM lv)
"""


def spans_sql(name: str, pattern: str, where: str = "true") -> str:
    """A table of matches: the columns of el, s and e in the leaf, and m."""
    p = pattern.replace("'", "''")
    return f"""{name}_0 AS (SELECT *, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM el WHERE {where} AND regexp_matches(text, '{p}')),
{name}_1 AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {name}_0),
{name} AS (SELECT * EXCLUDE (ms, gs, i), ms[i] AS m, CAST(coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM {name}_1)"""
