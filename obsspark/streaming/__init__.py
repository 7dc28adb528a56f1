"""Structured Streaming forms of the stateless line operators."""

from obsspark.streaming.lines import parsed_line_stream, write_line_stream

__all__ = ["parsed_line_stream", "write_line_stream"]
