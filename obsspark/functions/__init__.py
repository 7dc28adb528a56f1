"""Column-expression building blocks (no data movement, no UDFs)."""

from obsspark.functions.timeparse import (
    first_token, iso_from_ms, line_time_ms, parse_line_columns)
from obsspark.functions.text import (
    exclude_any, glob_like, glob_to_like, include_any, is_journal_noise)

__all__ = [
    "first_token", "iso_from_ms", "line_time_ms", "parse_line_columns",
    "exclude_any", "glob_like", "glob_to_like", "include_any", "is_journal_noise",
]
