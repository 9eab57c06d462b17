from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"

#: The cases that every operator must bear: nulls, empty and long texts, ties, repeated rows, clashing names.
LONG = " ".join(f"word{i % 977}" for i in range(20_000))
ROWS = [(1, "Alpha beta gamma delta."), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, LONG), (7, "Alpha beta gamma delta."), (7, "Alpha beta gamma delta."), (None, "null id"), (8, "12 34 !!"), (9, "Ünïcode ſ İ 日本語 <|endoftext|> x")]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if t else None, None, 0, "x", 1) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, fp int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
