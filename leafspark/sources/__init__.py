"""Where documents come from and where results go."""

from .paths import read_files, read_paths
from .sinks import asset_files, write_assets

__all__ = ["asset_files", "read_files", "read_paths", "write_assets"]
