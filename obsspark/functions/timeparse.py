"""Line timestamp parsing (P1, P2) and ISO formatting.

All of these are plain Catalyst expressions, so they run inside
whole-stage codegen and work unchanged on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shape of a line timestamp token.
# YYYY-MM-DDTHH:MM:SS, optional fraction introduced by '.' or ',',
# optional 'Z' or a numeric offset +HH:MM / +HHMM / -HH:MM / -HHMM.
LINE_TS_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:?\d{2})?$"

# Fixed value: the ISO-8601 rendering used for record timestamps.
ISO_MS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_time_ms(token) -> Column:
    """Epoch milliseconds of a timestamp token, NULL when invalid.

    The shape is checked by regex; calendar validity (month length, leap
    years, hour <= 23, minute/second <= 59) is enforced by Spark's
    timestamp parser, which yields NULL through ``try_to_timestamp``.
    A comma fraction is read as a dot fraction; digits beyond the ninth
    are ignored (milliseconds are kept).  Offset-less tokens are
    read in the session time zone (UTC by convention).
    """
    tok = _col(token)
    # Spark parses at most 9 fraction digits; only milliseconds matter.
    norm = F.regexp_replace(F.translate(tok, ",", "."), r"(\.\d{9})\d+", "$1")
    return F.when(tok.rlike(LINE_TS_PATTERN), F.unix_millis(F.try_to_timestamp(norm)))


def first_token(raw) -> Column:
    """Text before the first space, only when that space is not at index 0."""
    r = _col(raw)
    return F.when(F.instr(r, " ") > 1, F.substring_index(r, " ", 1))


def parse_line_columns(raw, timestamps: bool = True) -> tuple[Column, Column, Column]:
    """(ts, line, sort_ms) for a raw line (P1 + P2).

    ``ts`` is the leading token iff it is a valid timestamp; then ``line``
    is the rest after the first space, else the whole raw line.
    With ``timestamps=False`` the line is never split.
    """
    r = _col(raw)
    if not timestamps:
        return F.lit(None).cast("string"), r, F.lit(None).cast("bigint")
    tok = first_token(r)
    ms = line_time_ms(tok)
    ts = F.when(ms.isNotNull(), tok)
    line = F.when(ms.isNotNull(), F.substr(r, F.instr(r, " ") + 1)).otherwise(r)
    return ts, line, ms


def iso_from_ms(ms) -> Column:
    """ISO-8601 text with millisecond precision from epoch ms.

    Rendered in the session zone, which ``ensure_session_defaults`` pins
    to UTC so the trailing 'Z' is truthful.
    """
    return F.date_format(F.timestamp_millis(_col(ms)), ISO_MS_FORMAT)
