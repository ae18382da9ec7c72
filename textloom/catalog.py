"""All registered queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from importlib import import_module

from textloom.queries import ORACLES, QUERIES

FAMILIES = ("text", "lines", "extract", "compare", "tables", "status", "links", "trees", "jobs", "plans", "patches", "markup", "folds", "structures", "rewriting", "transform")
FLAGSHIP = "drift_status"

for _family in FAMILIES:
    import_module(f"textloom.queries.{_family}")

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
