"""Editorial standards: defaults overridden by brand files, and the lexicons made from them."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import lexicons as L


def deep_merge(base: dict, over: dict) -> dict:
    """Nested dictionaries merge; lists and scalars of over replace those of base."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def get(standards: dict, path: str, default: Any = None) -> Any:
    for part in path.split("."):
        if not isinstance(standards, dict) or part not in standards:
            return default
        standards = standards[part]
    return standards


class Standards:
    """Brand standards from a folder of YAML files, cached until reload()."""

    def __init__(self, folder: str) -> None:
        self.folder, self.cache = Path(folder), {}

    def read(self, name: str) -> dict:
        import yaml

        path = self.folder / f"{name}.yaml"
        return (yaml.safe_load(path.read_text()) or {}) if path.exists() else {}

    def brands(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.yaml") if not p.stem.startswith("_"))

    def has(self, brand: str) -> bool:
        return brand in self.brands()

    def load(self, brand: str | None = None) -> dict:
        """Defaults with the brand's values over them; an unknown brand has the defaults."""
        if brand not in self.cache:
            self.cache[brand] = deep_merge(self.read("_defaults"), self.read(brand) if brand else {})
        return self.cache[brand]

    def reload(self) -> None:
        self.cache.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        """(brand, path, value): every setting of every brand, one row each."""
        rows = [(b, path, str(v)) for b in self.brands() for path, v in flat(self.load(b))]
        return spark.createDataFrame(rows, "brand string, path string, value string")


def flat(tree: dict, prefix: str = ""):
    for k, v in tree.items():
        if isinstance(v, dict):
            yield from flat(v, f"{prefix}{k}.")
        else:
            yield f"{prefix}{k}", v


def stop_words(spark: SparkSession, hard: list[str], soft: list[str]) -> DataFrame:
    """(tier, term, weight, pattern). Phrases match as they are; words with their simple inflections."""
    rows = [(tier, w.lower(), weight, stop_pattern(w)) for tier, words, weight in (("hard", word_list(hard, "hard"), 1.0), ("soft", word_list(soft, "soft"), 0.3)) for w in words]
    return spark.createDataFrame(rows, "tier string, term string, weight double, pattern string")


def word_list(value: object, name: str) -> list[str]:
    """The words of a configured list. Anything but a list is left out with a warning, and so are entries that aren't text."""
    import warnings

    if value is None:
        return []
    if not isinstance(value, (list, tuple)):
        warnings.warn(f"{name} is no list but {type(value).__name__}; it is ignored", stacklevel=2)
        return []
    return [w for w in value if isinstance(w, str) and w.strip()]


def stop_pattern(word: str) -> str:
    import re

    w = re.escape(word.lower()).replace(r"\ ", " ").replace(r"\-", "-")
    if " " in word or "-" in word:
        return rf"(?i)\b{w}\b"
    if word.lower().endswith("e"):
        return rf"(?i)\b(?:{w}(?:s|ly)?|{w[:-1]}(?:ing|ed))\b"
    return rf"(?i)\b{w}(?:s|ing|ed|ly)?\b"


def stop_forms(word: str) -> list[str]:
    """The forms of a stop word that stop_pattern finds."""
    w = word.lower()
    if " " in w or "-" in w:
        return [w]
    return [w, w + "s", w + "ly", w[:-1] + "ing", w[:-1] + "ed"] if w.endswith("e") else [w, *(w + end for end in ("s", "ing", "ed", "ly"))]


def spelling(spark: SparkSession) -> DataFrame:
    """(region, wrong, right)."""
    return spark.createDataFrame(L.swaps(), "region string, wrong string, right string")


def operators(spark: SparkSession, path: str) -> DataFrame:
    """Known operator names, one a line; comments go, of equal keys the first line stays."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.read.text(path).select(F.trim("value").alias("name"), F.monotonically_increasing_id().alias("i")).where("name <> '' AND NOT startswith(name, '#')")
    rows = rows.withColumn("norm", F.regexp_replace(F.lower("name"), "[ -]", ""))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("norm").orderBy("i"))).where("n = 1").select("name", "norm")


def split_brand(name: str) -> list[str]:
    """Parts of a brand at changes of case, between letters and digits, and at spaces and hyphens; else at a usual word."""
    import re

    parts = [p for p in re.split(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])|[ -]+", name) if p]
    low = name.lower()
    if len(parts) == 1 and len(name) > 3:
        for p in L.BRAND_PARTS:
            if low != p and low.endswith(p):
                return [name[: -len(p)], name[-len(p) :]]
            if low != p and low.startswith(p):
                return [name[: len(p)], name[len(p) :]]
    return parts


def brand_pattern(name: str) -> str:
    import re

    parts = split_brand(name)
    if len(parts) < 2:
        return rf"(?i)\b{re.escape(name)}\b"
    start = r"(?<![a-zA-Z0-9])" if parts[0][0].isdigit() else r"\b"
    return "(?i)" + start + r"[\s\-]*".join(map(re.escape, parts)) + r"\b"


def operator_pattern(name: str) -> str:
    import re

    e = re.escape(name)
    return rf"(?i)(?<![a-zA-Z0-9]){e}(?![a-zA-Z0-9])" if name[0].isdigit() else rf"(?i)\b{e}\b"
