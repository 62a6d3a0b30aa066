"""Readers: bytes of one format to the document model, on the standard library alone."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_MODULES = {
    "csv": "csv_table", "docx": "docx", "pptx": "pptx", "xlsx": "excel", "odt": "odf", "ods": "odf", "odp": "odf",
    "epub": "epub", "rtf": "rtf", "doc": "word97", "ppt": "powerpoint97",
}


def reader(name: str) -> Callable[[bytes], dict]:
    """The function that reads format ``name`` into a document."""
    return import_module(f".{_MODULES[name]}", __name__).read
