"""One document's conversion: bytes or a path to Markdown, pages, or the document model."""

from __future__ import annotations

from . import model, render
from .errors import ConvertError, guarded, unsupported
from .formats import format_from_bytes, format_from_path
from .readers import reader

_SPELLED = {"xlsx": "Excel"}


def resolve(data: bytes, name: str | None) -> str:
    """The named format, else the detected one."""
    found = name or format_from_bytes(data)
    if not found:
        raise unsupported("unrecognized file content: name the format explicitly")
    return found


def to_document(data: bytes, name: str | None = None) -> dict:
    found = resolve(data, name)
    if found == "pdf":
        raise unsupported("a PDF has no document model: convert it to Markdown instead")
    return reader(found)(data)


def to_pages(data: bytes, name: str | None = None) -> list[tuple[int, str]]:
    """(number from 1, Markdown) of every page of a PDF, blank ones included."""
    found = resolve(data, name)
    if found != "pdf":
        raise unsupported(f"per-page conversion supports PDF only, not {_SPELLED.get(found, found.capitalize())}")
    from .readers import pdf

    return list(enumerate(pdf.pages(data), 1))


def to_markdown(data: bytes, name: str | None = None) -> str:
    if resolve(data, name) == "pdf":
        return "\n".join(text for _, text in to_pages(data, "pdf") if text)
    return render.markdown(to_document(data, name))


def read_path(path: str) -> bytes:
    """The file's content; whatever keeps it from being read is an ``io`` error."""
    try:
        with open(path.split("\0")[0].removeprefix("file://").removeprefix("file:"), "rb") as f:
            return f.read()
    except (OSError, ValueError) as e:
        raise ConvertError("io", str(e)) from None


def path_format(data: bytes, path: str | None) -> str | None:
    """Detected from content, with the extension as fallback."""
    return format_from_bytes(data) or format_from_path(path)


def path_to_markdown(path: str) -> str:
    data = read_path(path)
    return to_markdown(data, path_format(data, path))


def plain_text(inlines: list) -> str:
    return model.plain(inlines)


__all__ = ["ConvertError", "guarded", "path_to_markdown", "plain_text", "read_path", "to_document", "to_markdown", "to_pages"]
