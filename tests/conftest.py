from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def article(spark):
    """Makes an elements table from (type, level, text) leaves of one document."""
    from proofmill.sources.corpus import with_offsets

    def make(*leaves):
        rows = [(1, "b", "t", i, k, n, t) for i, (k, n, t) in enumerate((x if isinstance(x, tuple) else ("paragraph", None, x)) for x in leaves)]
        return with_offsets(spark.createDataFrame(rows, "doc_id long, brand string, article_type string, idx long, elem_type string, level int, text string"))

    return make
