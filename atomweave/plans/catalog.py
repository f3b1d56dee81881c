"""Every query of the engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import dedup_queries, pass_queries, pipelines, search_queries, state_queries, store_queries, text_queries  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES  # noqa: F401
