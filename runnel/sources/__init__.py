"""Sources and sinks."""

from .readers import array_source, counter, countdown, hello, raw_file, table, user_source
from .sinks import RateSink, lines, noop, rate_report, rate_reports, write_lines, write_raw

__all__ = [
    "RateSink", "array_source", "countdown", "counter", "hello", "lines", "noop", "rate_report", "rate_reports", "raw_file", "table",
    "user_source", "write_lines", "write_raw",
]
