"""A-type data checks: a query whose non-empty result fails the job.

Only ``limit(k)`` rows ever reach the driver, so a check costs one
short-circuiting scan, not a collect of the violations.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Row


class DataCheckError(RuntimeError):
    """Raised when an A-type check finds a violating row."""

    def __init__(self, message: str, rows: list[Row] | None = None):
        super().__init__(message)
        self.rows = rows or []


def assert_empty(df: DataFrame, message: str | Callable[[list[Row]], str], sample: int = 5) -> None:
    rows = df.limit(sample).collect()
    if rows:
        raise DataCheckError(message(rows) if callable(message) else message, rows)


def assert_at_most(df: DataFrame, n: int, message: str) -> None:
    """Fails when ``df`` has more than ``n`` rows; reads at most n+1."""
    if df.limit(n + 1).count() > n:
        raise DataCheckError(message)
