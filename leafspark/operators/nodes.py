"""The document model flattened into tables: one row per block, inline, list item, cell, note or asset.

Node ids count from 0 within a document, in document order, and are unique over blocks and inlines. ``path`` is
a sortable address: the ordinals from the root, each padded to six digits.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import convert
from ..errors import ERROR, guarded
from ..model import plain
from .conversion import mapped


def _schema(text: str) -> T.StructType:
    kinds = {"i": T.IntegerType(), "l": T.LongType(), "s": T.StringType(), "b": T.BooleanType(), "y": T.BinaryType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


TABLES = {
    "blocks": _schema("node_id:i parent_id:i container:s ordinal:i depth:i path:s kind:s level:i anchor:s lang:s text:s list_marker:s list_start:l table_kind:s header_rows:i"),
    "inlines": _schema("node_id:i block_id:i parent_id:i ordinal:i depth:i path:s kind:s text:s bold:b italic:b strike:b code:b target_kind:s target_value:s alt:s source_kind:s source_url:s source_asset_id:i anchor:s note_id:s checked:b"),
    "list_items": _schema("list_id:i ordinal:i marker_label:s"),
    "cells": _schema("table_id:i row:i col:i slot_kind:s col_span:i row_span:i origin_row:i origin_col:i is_header:b text:s"),
    "notes": _schema("note_id:s kind:s"),
    "assets": _schema("asset_id:i media_type:s origin_part:s data:y n_bytes:l"),
}


def block_text(block: dict) -> str:
    """The plain text of a block and all below it, lines joined by a line break."""
    if "content" in block:
        return plain(block["content"])
    if "text" in block:
        return block["text"]
    inner = block.get("blocks", [])
    if "list" in block:
        inner = [b for i in block["list"]["items"] for b in i["blocks"]]
    if "table" in block:
        inner = [b for row in block["table"]["grid"] for s in row if s["kind"] == "origin" for b in s["cell"]["blocks"]]
    return "\n".join(block_text(b) for b in inner)


class _Walk:
    def __init__(self, table: str) -> None:
        self.table, self.rows, self.n = table, [], 0

    def add(self, table: str, *row) -> None:
        if table == self.table:
            self.rows.append(row)

    def new(self) -> int:
        self.n += 1
        return self.n - 1

    def blocks(self, items: list, parent, container: str, depth: int, path: str) -> None:
        for k, b in enumerate(items):
            own, at = self.new(), f"{path}{k:06d}"
            lst, tab = b.get("list", {}), b.get("table", {})
            text = plain(b["content"]) if "content" in b else b.get("text")
            self.add(
                "blocks", own, parent, container, k, depth, at, b["kind"], b.get("level"), b.get("anchor"), b.get("lang"), text,
                lst.get("marker"), lst.get("start"), tab.get("kind"), tab.get("header_rows"),
            )
            self.inlines(b.get("content", []), own, None, 0, at + ".")
            self.blocks(b.get("blocks", []), own, "block_quote", depth + 1, at + ".")
            for i, item in enumerate(lst.get("items", [])):
                self.add("list_items", own, i, item.get("marker_label"))
                self.blocks(item["blocks"], own, "list_item", depth + 1, f"{at}.{i:06d}.")
            for r, row in enumerate(tab.get("grid", [])):
                for c, slot in enumerate(row):
                    cell, head = slot.get("cell", {}), r < tab["header_rows"]
                    text = "\n".join(map(block_text, cell["blocks"])) if cell else None
                    self.add(
                        "cells", own, r, c, slot["kind"], cell.get("col_span"), cell.get("row_span"), slot.get("origin_row"),
                        slot.get("origin_col"), head, text,
                    )
                    self.blocks(cell.get("blocks", []), own, "cell", depth + 1, f"{at}.{r:06d}.{c:06d}.")

    def inlines(self, items: list, block: int, parent, depth: int, path: str) -> None:
        for k, i in enumerate(items):
            own, at = self.new(), f"{path}{k:06d}"
            style, target, source = i.get("style", {}), i.get("target", {}), i.get("source", {})
            self.add(
                "inlines", own, block, parent, k, depth, at, i["kind"], i.get("text"), *[style.get(s) for s in ("bold", "italic", "strike", "code")],
                target.get("kind"), target.get("value"), i.get("alt"), source.get("kind"), source.get("url"), source.get("asset_id"),
                i.get("anchor"), i.get("note_id"), i.get("checked"),
            )
            self.inlines(i.get("content", []), block, own, depth + 1, at + ".")

    def document(self, doc: dict) -> list[tuple]:
        self.blocks(doc["blocks"], None, "body", 0, "")
        for k, n in enumerate(doc["notes"]):
            self.add("notes", n["id"], n["kind"])
            self.blocks(n["blocks"], None, "note", 0, f"n{k:06d}.")
        if self.table == "assets":
            for a in doc["assets"]:
                data = base64.b64decode(a["data"])
                self.add("assets", a["id"], a["media_type"], a["origin_part"], data, len(data))
        return self.rows


def rows_of(doc: dict, table: str) -> Iterator[tuple]:
    """The rows of one table of one document."""
    yield from _Walk(table).document(doc)


def node_table(
    df: DataFrame, table: str, content: str = "content", format: str | None = None, format_col: str | None = None, path_col: str | None = None,
    errors: bool = False,
) -> DataFrame:
    """The rows of ``table`` for every document that converts, behind the document's other columns.

    With ``errors`` there is a last column ``error``, and a document that fails has one row with nothing else in it;
    without, it has no row, and its error is in :func:`leafspark.operators.documents`.
    """
    fields = [*TABLES[table].fields, *([T.StructField("error", ERROR)] if errors else [])]
    width = len(TABLES[table].fields)

    def make(data: bytes, name: str | None, wrong):
        found, error = (None, wrong) if wrong else guarded(lambda *a: _Walk(table).document(convert.to_document(*a)), data, name)
        if errors and error:
            return [(*[None] * width, error)]
        return [(*row[:width], None) if errors else row[:width] for row in found or ()]

    return mapped(df, content, format, format_col, path_col, fields, make)
