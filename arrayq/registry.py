"""All array queries and their oracles."""

from __future__ import annotations

from .queries import coding, grid, signal, streams
from .runtime import query

QUERIES: dict = {k: query(f) for k, f in (signal.QUERIES | grid.QUERIES | coding.QUERIES | streams.QUERIES).items()}
SQL: dict = signal.SQL | grid.SQL | coding.SQL | streams.SQL
