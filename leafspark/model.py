"""The document model as plain dictionaries, and its canonical JSON.

A document has blocks, notes and assets. Blocks and inlines are tagged by ``kind``; optional fields that do
not apply are absent, never null. Fields stand in one fixed order, so the JSON is canonical.
"""

from __future__ import annotations

import base64
import json

from .errors import malformed

# The closed vocabularies.
BLOCK_KINDS = ("heading", "paragraph", "list", "table", "block_quote", "code_block", "rule", "math")
INLINE_KINDS = ("text", "link", "image", "anchor", "note_ref", "line_break", "math", "checkbox")
LINK_KINDS = ("external", "relative", "anchor")
IMAGE_KINDS = ("external", "asset", "unavailable")
MARKERS = ("bullet", "decimal", "lower_alpha", "upper_alpha", "lower_roman", "upper_roman")


def _present(**fields) -> dict:
    return {k: v for k, v in fields.items() if v is not None}


def document(blocks=(), notes=(), assets=()) -> dict:
    return {"blocks": list(blocks), "notes": list(notes), "assets": list(assets)}


def heading(level: int, content: list, anchor: str | None = None) -> dict:
    return _present(kind="heading", level=max(1, min(6, level)), anchor=anchor, content=content)


def paragraph(content: list) -> dict:
    return {"kind": "paragraph", "content": content}


def list_block(marker: str, items: list, start: int = 1) -> dict:
    return {"kind": "list", "list": {"marker": marker, "start": start, "items": items}}


def list_item(blocks: list, label: str | None = None) -> dict:
    return _present(blocks=blocks, marker_label=label)


def table(grid: list, header_rows: int = 0, kind: str = "data") -> dict:
    return {"kind": "table", "table": {"grid": grid, "header_rows": header_rows, "kind": kind}}


def quote(blocks: list) -> dict:
    return {"kind": "block_quote", "blocks": blocks}


def code(text: str, lang: str | None = None) -> dict:
    return _present(kind="code_block", lang=lang, text=text)


def rule() -> dict:
    return {"kind": "rule"}


def math(text: str) -> dict:
    return {"kind": "math", "text": text}


def text(value: str, bold=False, italic=False, strike=False, code=False) -> dict:
    style = {"bold": bool(bold), "italic": bool(italic), "strike": bool(strike), "code": bool(code)}
    return {"kind": "text", "text": value, "style": style}


def link(content: list, kind: str, value: str) -> dict:
    return {"kind": "link", "content": content, "target": {"kind": kind, "value": value}}


def image(alt: str, kind: str, url: str | None = None, asset_id: int | None = None) -> dict:
    return {"kind": "image", "alt": alt, "source": _present(kind=kind, url=url, asset_id=asset_id)}


def anchor(name: str) -> dict:
    return {"kind": "anchor", "anchor": name}


def note_ref(note_id: str) -> dict:
    return {"kind": "note_ref", "note_id": note_id}


def line_break() -> dict:
    return {"kind": "line_break"}


def checkbox(checked: bool) -> dict:
    return {"kind": "checkbox", "checked": checked}


def origin(blocks: list, col_span: int = 1, row_span: int = 1) -> dict:
    return {"kind": "origin", "cell": {"blocks": blocks, "col_span": col_span, "row_span": row_span}}


def covered(row: int, col: int) -> dict:
    return {"kind": "covered", "origin_row": row, "origin_col": col}


def note(note_id: str, kind: str, blocks: list) -> dict:
    return {"id": note_id, "kind": kind, "blocks": blocks}


def asset(asset_id: int, media_type: str, origin_part: str, data: bytes) -> dict:
    return {"id": asset_id, "media_type": media_type, "origin_part": origin_part, "data": base64.b64encode(data).decode()}


def link_to(href: str) -> tuple[str, str]:
    """(kind, value) of a link target."""
    if href.startswith("#"):
        return "anchor", href[1:]
    scheme = href.partition(":")[0]
    return ("external" if ":" in href and scheme.isalnum() and len(scheme) > 1 else "relative"), href


def text_cell(value: str, **spans) -> dict:
    return origin([paragraph([text(value)])] if value else [], **spans)


def grid_of(rows: list[list[tuple[list, int, int]]]) -> list:
    """A dense grid from rows of (blocks, col_span, row_span), covered slots pointing at their origin."""
    placed: dict[tuple[int, int], dict] = {}
    width = 0
    for r, row in enumerate(rows):
        c = 0
        for blocks, col_span, row_span in row:
            while (r, c) in placed:
                c += 1
            row_span = min(row_span, len(rows) - r)
            for i in range(row_span):
                for j in range(col_span):
                    placed[r + i, c + j] = covered(r, c)
            placed[r, c] = origin(blocks, col_span, row_span)
            c += col_span
            width = max(width, c)
    width = max([width, *(c + 1 for _, c in placed)]) if placed else 0
    return [[placed.get((r, c)) or origin([]) for c in range(width)] for r in range(len(rows))]


def plain(inlines: list) -> str:
    """The text of inlines, links included, in order."""
    return "".join(i.get("text", "") + plain(i.get("content", [])) if i["kind"] != "image" else "" for i in inlines)


def merged(inlines: list) -> list:
    """Neighbouring text runs of one style joined, empty ones dropped."""
    out: list = []
    for i in inlines:
        if i["kind"] == "text":
            if not i["text"]:
                continue
            if out and out[-1]["kind"] == "text" and out[-1]["style"] == i["style"]:
                out[-1] = out[-1] | {"text": out[-1]["text"] + i["text"]}
                continue
        out.append(i)
    return out


def to_json(doc: dict) -> str:
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


def from_json(value: str) -> dict:
    """The document of its JSON; a ``malformed`` error if it is none."""
    return _decoded(value, "document", lambda d: isinstance(d, dict) and all(isinstance(d.get(k), list) for k in ("blocks", "notes", "assets")))


def pages_to_json(pages: list[tuple[int, str]]) -> str:
    return to_json([{"number": n, "markdown": t} for n, t in pages])


def pages_from_json(value: str) -> list[tuple[int, str]]:
    """(number, Markdown) of the JSON of pages; a ``malformed`` error if it is none."""
    shape = lambda p: isinstance(p, list) and all(isinstance(x, dict) and {"number", "markdown"} <= x.keys() for x in p)
    return [(int(x["number"]), str(x["markdown"])) for x in _decoded(value, "pages", shape)]


def _decoded(value: str, what: str, fits):
    try:
        found = json.loads(value)
    except (ValueError, RecursionError) as e:
        raise malformed(f"{what} json: {e}") from None
    if not fits(found):
        raise malformed(f"{what} json: unexpected shape")
    return found
