"""Argument contract."""

import pytest

from obsspark.params import (ArgumentError, ContainerLogParams, ServiceLogParams, TimeWindow, check_patterns,
                             parse_iso_z)


def test_caps():
    with pytest.raises(ArgumentError):
        ServiceLogParams(now_ms=0, max_total_log_lines=0)
    with pytest.raises(ArgumentError):
        ServiceLogParams(now_ms=0, max_total_log_lines=50_001)
    assert ServiceLogParams(now_ms=0, max_total_log_lines=60_000, hard_max_total_log_lines=60_000)
    assert ServiceLogParams(now_ms=0, tail_lines=0).tail_lines == 0
    with pytest.raises(ArgumentError):
        ContainerLogParams(now_ms=0, tail_lines=600, max_total_log_lines=500)


def test_patterns():
    assert check_patterns("p", [" a ", "", "  ", "b"]) == ("a", "b")
    with pytest.raises(ArgumentError):
        check_patterns("p", ["x"] * 51)
    with pytest.raises(ArgumentError):
        check_patterns("p", ["x" * 201])


def test_window_rules():
    with pytest.raises(ArgumentError):
        TimeWindow(since_seconds=10, start="2024-01-01T00:00:00Z", end="2024-01-01T00:00:01Z")
    with pytest.raises(ArgumentError):
        TimeWindow(start="2024-01-01T00:00:00Z")
    with pytest.raises(ArgumentError):
        TimeWindow(start="2024-01-01T00:00:00+00:00", end="2024-01-01T00:00:01Z")
    with pytest.raises(ArgumentError):
        TimeWindow(start="2024-02-30T00:00:00Z", end="2024-03-01T00:00:00Z")
    with pytest.raises(ArgumentError):
        TimeWindow(start="2024-01-01T00:00:01Z", end="2024-01-01T00:00:00Z")
    # width rounds up to whole seconds: 3600.000000001 s > 3600
    with pytest.raises(ArgumentError):
        TimeWindow(start="2024-01-01T00:00:00Z", end="2024-01-01T01:00:00.000000001Z")
    w = TimeWindow(start="2024-01-01T00:00:00Z", end="2024-01-01T01:00:00Z")
    assert w.bounds_ms(0) == (1704067200000, 1704070800000)
    assert TimeWindow(since_seconds=600).bounds_ms(1_000_000) == (400_000, 1_000_000)
    with pytest.raises(ArgumentError):
        TimeWindow(since_seconds=0)


def test_iso_ns():
    assert parse_iso_z("t", "2024-01-01T00:00:00.123456789Z") == 1704067200123456789


def test_absolute_window_forces_timestamps():
    p = ContainerLogParams(now_ms=0, timestamps=False,
                           window=TimeWindow(start="2024-01-01T00:00:00Z", end="2024-01-01T00:10:00Z"))
    assert p.timestamps is True


def test_scale_settings():
    from obsspark.session import scale_settings
    s = scale_settings(100 * 2**40, 8000)
    assert int(s["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_settings(10 << 20, 8)["spark.sql.shuffle.partitions"]) == 16
