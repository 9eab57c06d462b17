"""Lookups against the editorial standards, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Countries by spelling region, and words out of style (fixed values)
REGIONS = {"british": ["UK", "IN", "LK", "PK", "SG", "MM", "HK", "KE", "NG"], "american": ["US", "PH", "TW", "KR", "JP"], "canadian": ["CA"], "australian": ["AU"], "new_zealand": ["NZ"]}
PROHIBITED = ["e.g.", "i.e.", "etc.", "sucks", "jerk"]


def stop_tier(word: Column, hard: list[str], soft: list[str]) -> Column:
    """hard, soft or null, whatever the case."""
    w = F.lower(word)
    return F.when(w.isin([x.lower() for x in hard]), "hard").when(w.isin([x.lower() for x in soft]), "soft")


def stop_weight(word: Column, hard: list[str], soft: list[str]) -> Column:
    tier = stop_tier(word, hard, soft)
    return F.when(tier == "hard", 1.0).when(tier == "soft", 0.3).otherwise(0.0)


def prohibited(text: Column, words: list[str] | None = None) -> Column:
    low, out = F.lower(text), F.lit(False)
    for w in PROHIBITED if words is None else words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def spelling_region(country: Column, regions: dict[str, list[str]] | None = None) -> Column:
    """The spelling region of a country code; British where it is unknown."""
    code, out = F.upper(country), None
    for name, codes in (regions or REGIONS).items():
        out = F.when(code.isin(codes), name) if out is None else out.when(code.isin(codes), name)
    return out.otherwise("british")


def normal_brand(name: Column, mappings: dict[str, str]) -> Column:
    if not mappings:
        return name
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in mappings.items() for x in kv)), name), name)


def setting(raw: Column, path: str, default: str | None = None) -> Column:
    """A setting of standards kept as JSON, by its dotted path."""
    return F.coalesce(F.get_json_object(raw, f"$.{path}"), F.lit(default).cast("string"))
