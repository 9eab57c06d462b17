"""A QA run over articles: checks, edits, comments, summary. Elements, each check's findings and edits are tables of the run.

A check that fails, in planning or in execution, is reported; the others go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import briefs_checks, checks, edits, findings, reports  # noqa: F401  they register their checks
from ..sources.tables import stored

CHECKS = checks.CHECKS


def run_checks(el: DataFrame, settings: dict[str, dict], names: list[str] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Findings of the named checks (all that have settings, by default) and the errors of those that fail."""
    parts, errors = [], {}
    for name in names or list(settings):
        try:
            parts.append(stored(CHECKS[name](el, **settings.get(name, {})), f"findings-{name}"))
        except Exception as e:  # one check must not stop the others
            errors[name] = f"{type(e).__name__}: {e}"
    return (findings.union(parts) if parts else None), errors


def qa(el: DataFrame, settings: dict[str, dict]) -> dict[str, DataFrame]:
    """The tables of a run: findings, edits (with status), corrected elements, comments and summary."""
    el = stored(el, "elements")
    found, _ = run_checks(el, settings)
    found = stored(found, "findings")
    judged = stored(edits.resolved(edits.validated(found, el)), "edits")
    return {"findings": found, "edits": judged, "elements": edits.applied(el, judged), "comments": reports.comments(el, found, judged), "summary": reports.run_summary(found, judged)}
