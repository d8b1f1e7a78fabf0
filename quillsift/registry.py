"""The queries of the sanitizing engine and their DuckDB SQL, by name."""

from __future__ import annotations

from .plans import keyed, made  # noqa: F401  they add theirs
from .plans.queries import ORACLES, QUERIES

FLAGSHIP = "clean_summary"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
