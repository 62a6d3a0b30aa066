"""CSV: one document is one table with a header row."""

from __future__ import annotations

import csv
import io

from .. import model


def decoded(data: bytes) -> str:
    """UTF-8 or UTF-16 with a mark, else UTF-8, else Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def read(data: bytes) -> dict:
    """Rows shorter than the longest are padded; blank lines are skipped; values stay as written."""
    csv.field_size_limit(1 << 30)
    rows = [r for r in csv.reader(io.StringIO(decoded(data), newline="")) if r]
    width = max(map(len, rows), default=0)
    grid = [[model.text_cell(v) for v in r + [""] * (width - len(r))] for r in rows]
    return model.document([model.table(grid, header_rows=1)] if grid else [])
