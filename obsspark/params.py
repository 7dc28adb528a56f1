"""Operator arguments and their argument contract.

These are plain Python checks on *arguments* (driver side, no data).
Defaults are the reference's configured ceilings; callers may raise
the hard maxima.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from typing import Sequence

# Default limits.
MAX_TOTAL_LOG_LINES = 50_000
MAX_WINDOW_SECONDS = 3_600
DEFAULT_SINCE_SECONDS = 600
DEFAULT_TAIL_LINES = 2_000
MAX_PODS = 20
MAX_METRICS_PODS = 20
METRICS_TIMEOUT_MS = 2_000
MAX_METRICS_BODY_BYTES = 10 * 1024 * 1024
MAX_PATTERNS = 50
MAX_PATTERN_CHARS = 200

_ISO_Z = re.compile(r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?Z$")


# The error texts of this module are fixed values, shown to callers as they are.
class ArgumentError(ValueError):
    """An operator argument violates the contract."""


def check_cap(name: str, value: int, hard_max: int, minimum: int = 1) -> int:
    """``minimum <= value <= hard_max``."""
    if not isinstance(value, int) or isinstance(value, bool):
        raise ArgumentError(f"Invalid number: {name}")
    if value < minimum:
        raise ArgumentError(f"{name} must be >= {minimum}")
    if value > hard_max:
        raise ArgumentError(f"{name} exceeds hard limit ({value} > {hard_max})")
    return value


def check_patterns(name: str, patterns: Sequence[str] | None) -> tuple[str, ...]:
    """R2: trimmed, empties dropped, at most 50 items of at most 200 chars."""
    if patterns is None:
        return ()
    out = []
    for i, p in enumerate(patterns):
        if not isinstance(p, str):
            raise ArgumentError(f"Invalid string: {name}[{i}]")
        s = p.strip()
        if s:
            out.append(s)
    if len(out) > MAX_PATTERNS:
        raise ArgumentError(f"{name} too large (max {MAX_PATTERNS})")
    for p in out:
        if len(p) > MAX_PATTERN_CHARS:
            raise ArgumentError(f"{name} item too long (max {MAX_PATTERN_CHARS})")
    return tuple(out)


def parse_iso_z(name: str, value: str) -> int:
    """Strict ISO-8601 UTC ('...Z') instant -> epoch nanoseconds."""
    if not isinstance(value, str):
        raise ArgumentError(f"Invalid string: {name}")
    s = value.strip()
    if not s.endswith("Z"):
        raise ArgumentError(f"{name} must be ISO8601 UTC (end with 'Z')")
    m = _ISO_Z.match(s)
    if not m:
        raise ArgumentError(f"Invalid datetime: {name}")
    y, mo, d, h, mi, sec = (int(x) for x in m.groups()[:6])
    if not (1 <= mo <= 12) or not (1 <= d <= calendar.monthrange(y, mo)[1]) or h > 23 or mi > 59 or sec > 59:
        raise ArgumentError(f"Invalid datetime: {name}")
    whole = calendar.timegm((y, mo, d, h, mi, sec, 0, 0, 0))
    frac = int((m.group(7) or "").ljust(9, "0") or "0")
    return whole * 1_000_000_000 + frac


@dataclass(frozen=True)
class TimeWindow:
    """Relative (``since_seconds``) xor absolute (``start``/``end``)."""

    since_seconds: int | None = None
    start: str | None = None
    end: str | None = None
    max_seconds: int = MAX_WINDOW_SECONDS

    def __post_init__(self):
        has_abs = self.start is not None or self.end is not None
        if self.since_seconds is not None and has_abs:
            raise ArgumentError("timeWindow cannot use sinceSeconds together with start/end")
        if self.since_seconds is None and not has_abs:
            raise ArgumentError("timeWindow must include sinceSeconds or start/end")
        if has_abs:
            if self.start is None or self.end is None:
                raise ArgumentError("timeWindow.start and timeWindow.end are required together")
            s = parse_iso_z("timeWindow.start", self.start)
            e = parse_iso_z("timeWindow.end", self.end)
            if e < s:
                raise ArgumentError("timeWindow.end must be >= timeWindow.start")
            width = (e - s + 999_999_999) // 1_000_000_000
            if width > self.max_seconds:
                raise ArgumentError(
                    f"timeWindow range exceeds sinceSecondsMax ({width} > {self.max_seconds})")
        else:
            check_cap("timeWindow.sinceSeconds", self.since_seconds, self.max_seconds, 1)

    @property
    def is_absolute(self) -> bool:
        return self.start is not None

    def bounds_ms(self, now_ms: int) -> tuple[int, int]:
        """Inclusive [start, end] in epoch ms, fixed once per run."""
        if self.is_absolute:
            return (parse_iso_z("start", self.start) // 1_000_000,
                    parse_iso_z("end", self.end) // 1_000_000)
        return now_ms - self.since_seconds * 1000, now_ms


@dataclass(frozen=True)
class ServiceLogParams:
    """Arguments of the service log collection (B1)."""

    now_ms: int
    tail_lines: int = DEFAULT_TAIL_LINES
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    window: TimeWindow | None = None
    max_total_log_lines: int = MAX_TOTAL_LOG_LINES
    hard_max_total_log_lines: int = MAX_TOTAL_LOG_LINES

    def __post_init__(self):
        check_cap("maxTotalLogLines", self.max_total_log_lines, self.hard_max_total_log_lines, 1)
        # R5 (services): tail may be 0 and is bounded by the hard cap.
        check_cap("include.logs.tailLines", self.tail_lines, self.hard_max_total_log_lines, 0)
        object.__setattr__(self, "include", check_patterns("include.logs.includePatterns", self.include))
        object.__setattr__(self, "exclude", check_patterns("include.logs.excludePatterns", self.exclude))

    def window_ms(self) -> tuple[int | None, int | None]:
        if self.window is None:
            return None, None
        return self.window.bounds_ms(self.now_ms)


@dataclass(frozen=True)
class ContainerLogParams:
    """Arguments of the container log collection (B2) and events."""

    now_ms: int
    tail_lines: int = DEFAULT_TAIL_LINES
    timestamps: bool = True
    previous: bool = False
    exclude: tuple[str, ...] = ()
    window: TimeWindow = field(default_factory=lambda: TimeWindow(since_seconds=DEFAULT_SINCE_SECONDS))
    max_total_log_lines: int = MAX_TOTAL_LOG_LINES
    hard_max_total_log_lines: int = MAX_TOTAL_LOG_LINES

    def __post_init__(self):
        check_cap("maxTotalLogLines", self.max_total_log_lines, self.hard_max_total_log_lines, 1)
        # R5 (k8s): tail bounded by the *effective* line cap; 0 allowed.
        check_cap("include.logs.tailLines", self.tail_lines, self.max_total_log_lines, 0)
        object.__setattr__(self, "exclude", check_patterns("include.logs.excludePatterns", self.exclude))
        if self.window.is_absolute and not self.timestamps:
            # An absolute window needs line timestamps.
            object.__setattr__(self, "timestamps", True)

    def window_ms(self) -> tuple[int, int]:
        return self.window.bounds_ms(self.now_ms)
