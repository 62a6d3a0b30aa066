"""Document analytics on Spark: office and publishing documents in, DataFrames out."""

from .errors import ConvertError
from .formats import FORMATS, format_from_bytes, format_from_extension, format_from_path

__all__ = ["FORMATS", "ConvertError", "format_from_bytes", "format_from_extension", "format_from_path"]
