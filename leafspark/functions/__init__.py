"""Column functions, and registration of everything for SQL."""

from .columns import base64_text, container_format, detect, format_from_extension, format_from_path, join_pages, plain_lines, signature_format
from .register import register

__all__ = [
    "base64_text", "container_format", "detect", "format_from_extension", "format_from_path", "join_pages", "plain_lines", "register", "signature_format",
]
