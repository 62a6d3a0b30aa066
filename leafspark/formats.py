"""The formats: names, extensions, and recognition from content."""

from __future__ import annotations

import io
import zipfile

# Format names in declaration order.
FORMATS = ("doc", "docx", "odt", "pdf", "ppt", "pptx", "rtf", "epub", "xlsx", "ods", "odp", "csv")

# Extensions beside the format names themselves.
VARIANTS = {
    "docm": "docx",
    "pps": "ppt",
    "pot": "ppt",
    "pptm": "pptx",
    "ppsx": "pptx",
    "ppsm": "pptx",
    "xls": "xlsx",
    "xlsm": "xlsx",
    "xlsb": "xlsx",
}
EXTENSIONS = {name: name for name in FORMATS} | VARIANTS

_MIMETYPES = {
    "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "application/vnd.oasis.opendocument.presentation": "odp",
    "application/epub+zip": "epub",
}

#: Main parts that tell OOXML packages apart, where content types do not.
_PARTS = (("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx"), ("xl/workbook.bin", "xlsx"))

PDF_HEAD, RTF_HEAD, OLE_HEAD, ZIP_HEAD = b"%PDF-", b"{\\rtf", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"PK\x03\x04"


def join_formats() -> str:
    return ", ".join(FORMATS)


def check_format(name: str | None) -> str | None:
    """The name, or None for none; a name that does not exist is a plain ValueError."""
    if not name:
        return None
    if name not in FORMATS:
        raise ValueError(f'unknown format "{name}"; expected one of {join_formats()}')
    return name


def format_from_extension(extension: str | None) -> str | None:
    """With or without dots before it, in any case; the text ends at a NUL."""
    return EXTENSIONS.get((extension or "").split("\0")[0].lstrip(".").lower())


def format_from_path(path: str | None) -> str | None:
    name = (path or "").split("\0")[0].rstrip("/").rsplit("/", 1)[-1]
    stem, dot, extension = name.rpartition(".")
    return format_from_extension(extension) if dot and stem else None


def format_from_bytes(data: bytes | None) -> str | None:
    """By signature: PDF, RTF, OLE streams, ZIP packages. CSV and unknown content give None."""
    data = data or b""
    if PDF_HEAD in data[:1024]:
        return "pdf"
    if data.lstrip(b" \t\r\n")[:5] == RTF_HEAD:
        return "rtf"
    try:
        if data[:8] == OLE_HEAD:
            return _ole_format(data)
        if data[:4] == ZIP_HEAD:
            return _zip_format(data)
    except Exception:
        return None
    return None


def _ole_format(data: bytes) -> str | None:
    from .readers.cfb import CompoundFile

    names = {n.lower() for n in CompoundFile(data).names()}
    for stream, name in (("worddocument", "doc"), ("powerpoint document", "ppt"), ("workbook", "xlsx"), ("book", "xlsx")):
        if stream in names:
            return name
    return None


def _zip_format(data: bytes) -> str | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        if "mimetype" in names:
            with z.open("mimetype") as f:
                mimetype = f.read(200).decode("ascii", "replace").strip()
            for known, name in _MIMETYPES.items():
                if mimetype.startswith(known):
                    return name
        if "[Content_Types].xml" in names:
            with z.open("[Content_Types].xml") as f:
                types = f.read(1 << 20)
            for mark, name in ((b"wordprocessingml", "docx"), (b"presentationml", "pptx"), (b"spreadsheetml", "xlsx"), (b"ms-excel", "xlsx"), (b"ms-word", "docx"), (b"ms-powerpoint", "pptx")):
                if mark + b"" in types and (b".main+xml" in types or b"main" in types):
                    return name
        return next((name for part, name in _PARTS if part in names), None)
