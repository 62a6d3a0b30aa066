"""PowerPoint 97-2003 presentations (MS-PPT): the text of every slide."""

from __future__ import annotations

import struct

from .. import model
from ..errors import ConvertError, malformed
from .cfb import CompoundFile

_LIST, _PERSIST, _HEADER, _CHARS, _BYTES = 0x0FF0, 0x03F3, 0x0F9F, 0x0FA0, 0x0FA8
_TITLES, _NOTES = (0, 6), 2


def records(data: bytes, at: int = 0, end: int | None = None):
    """(version, instance, type, start, end) of the records of one level."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        head, kind, size = struct.unpack_from("<HHI", data, at)
        stop = at + 8 + size
        if stop > end:
            return
        yield head & 15, head >> 4, kind, at + 8, stop
        at = stop


def _texts(data: bytes, at: int, end: int, out: list, kind: int = 4) -> int:
    for version, _, record, start, stop in records(data, at, end):
        if record == _PERSIST:
            out.append(("slide", ""))
        elif record == _HEADER and stop - start >= 4:
            kind = struct.unpack_from("<I", data, start)[0]
        elif record == _CHARS:
            out.append((kind, data[start:stop].decode("utf-16-le", "replace")))
        elif record == _BYTES:
            out.append((kind, data[start:stop].decode("latin-1")))
        elif version == 15:
            kind = _texts(data, start, stop, out, kind)
    return kind


def read(data: bytes) -> dict:
    file = CompoundFile(data)
    stream, user = file.stream("PowerPoint Document"), file.stream("Current User") or b""
    if len(user) >= 16 and struct.unpack_from("<I", user, 12)[0] == 0xF3D1C4DF:
        raise ConvertError("encrypted", "the presentation is password protected")
    if stream is None:
        raise malformed("no PowerPoint document stream")
    found: list = []
    for version, _, _, start, stop in records(stream):
        if version != 15:
            continue
        for _, instance, kind, a, b in records(stream, start, stop):
            if kind == _LIST and instance == 0:
                _texts(stream, a, b, found)
    if not any(kind != "slide" and t.strip() for kind, t in found):
        _texts(stream, 0, len(stream), found)
    blocks: list = []
    for kind, text in found:
        lines = [x for x in text.replace("\x0b", "\n").split("\r") if x.strip()]
        if kind == "slide" or kind == _NOTES or not lines:
            continue
        if kind in _TITLES:
            blocks.append(model.heading(2, [model.text(" ".join(" ".join(lines).split()))]))
        elif kind in (1, 5, 7, 8) and len(lines) > 0:
            blocks.append(model.list_block("bullet", [model.list_item([model.paragraph([model.text(x.strip())])]) for x in lines]))
        else:
            blocks += [model.paragraph([model.text(x.strip())]) for x in lines]
    return model.document(blocks)
