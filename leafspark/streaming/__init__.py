"""Streaming ingestion: new files are converted as they arrive."""

from .ingest import convert_stream, read_stream

__all__ = ["convert_stream", "read_stream"]
