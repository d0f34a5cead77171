"""Live graphs on Structured Streaming."""

from .live import LiveFir, deliver, file_stream, keyed_running, rate_stream, run_available, windowed_counts

__all__ = ["LiveFir", "deliver", "file_stream", "keyed_running", "rate_stream", "run_available", "windowed_counts"]
