"""Text predicates: include/exclude patterns (P3, P4), journal noise
(P10) and '*' globs for access scopes (J8)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the journal reader's "no entries" marker line.
JOURNAL_NO_ENTRIES_PATTERN = r"^--\s*No entries\s*--$"

# Whitespace removed by trimming (ASCII space, tab, LF, VT, FF, CR);
# Spark's plain trim() only removes spaces.
WHITESPACE = " \t\n\x0b\x0c\r"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_trim(c) -> Column:
    """Trim ASCII whitespace from both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def _any_contains(raw: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [raw.contains(F.lit(p)) for p in patterns])


def include_any(raw, patterns: Sequence[str]) -> Column:
    """True when no include patterns are given, else when the raw line
    contains at least one of them (case-sensitive substring)."""
    if not patterns:
        return F.lit(True)
    return _any_contains(_col(raw), patterns)


def exclude_any(raw, patterns: Sequence[str]) -> Column:
    """True when the raw line contains any exclude pattern (drop it)."""
    if not patterns:
        return F.lit(False)
    return _any_contains(_col(raw), patterns)


def is_journal_noise(raw) -> Column:
    """Blank lines and the "-- No entries --" marker of the journal reader."""
    t = ws_trim(raw)
    return (t == F.lit("")) | t.rlike(JOURNAL_NO_ENTRIES_PATTERN)


def glob_to_like(pattern) -> Column:
    """Translate a '*' glob into a LIKE pattern with '!' as escape."""
    p = _col(pattern)
    for ch in ("!", "%", "_"):
        p = F.replace(p, F.lit(ch), F.lit("!" + ch))
    return F.replace(p, F.lit("*"), F.lit("%"))


def glob_like(value, pattern) -> Column:
    """Anchored '*' glob match of ``value`` against a pattern column.

    Exact equality always matches; '*' matches any run of characters
    (including none); every other character is literal.
    """
    return F.like(_col(value), glob_to_like(pattern), F.lit("!"))
