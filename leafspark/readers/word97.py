"""Word 97-2003 documents (MS-DOC): text by the piece table, paragraph styles by the formatted pages."""

from __future__ import annotations

import struct
from bisect import bisect_right

from .. import model
from ..errors import ConvertError, malformed
from .cfb import CompoundFile

_IN_TABLE, _ROW_END = 0x2416, 0x2417
_SIZES = {0: 1, 1: 1, 2: 2, 3: 4, 4: 2, 5: 2, 7: 3}


class _Reader:
    def __init__(self, data: bytes) -> None:
        streams = CompoundFile(data)
        self.main = streams.stream("WordDocument")
        if self.main is None or len(self.main) < 0x1AA or struct.unpack_from("<H", self.main)[0] != 0xA5EC:
            raise malformed("no Word document stream")
        flags = struct.unpack_from("<H", self.main, 10)[0]
        if flags & 0x100:
            raise ConvertError("encrypted", "the document is password protected")
        self.table = streams.stream("1Table" if flags & 0x200 else "0Table")
        if self.table is None:
            raise malformed("no table stream")
        self.ccp = struct.unpack_from("<i", self.main, 0x4C)[0]
        self.pieces = self._pieces(*struct.unpack_from("<II", self.main, 0x1A2))
        self.runs = self._paragraphs(*struct.unpack_from("<II", self.main, 0x102))

    def _pieces(self, at: int, size: int) -> list[tuple[int, int, int, bool]]:
        """(first character, end, file offset, one byte a character)."""
        clx, end = at, at + size
        while clx < end and self.table[clx] == 1:
            clx += 3 + struct.unpack_from("<H", self.table, clx + 1)[0]
        if clx >= end or self.table[clx] != 2:
            raise malformed("no piece table")
        n = (struct.unpack_from("<I", self.table, clx + 1)[0] - 4) // 12
        cps = struct.unpack_from(f"<{n + 1}I", self.table, clx + 5)
        out = []
        for k in range(n):
            place = struct.unpack_from("<I", self.table, clx + 5 + 4 * (n + 1) + 8 * k + 2)[0]
            narrow = bool(place & 0x40000000)
            place &= 0x3FFFFFFF
            out.append((cps[k], cps[k + 1], place // 2 if narrow else place, narrow))
        return out

    def _paragraphs(self, at: int, size: int) -> list[tuple[int, int, bool, bool]]:
        """(file offset of the start, style, in a table, ends a row) by the formatted disk pages."""
        n = max(0, (size - 4) // 8)
        out = []
        for k in range(n):
            page = struct.unpack_from("<I", self.table, at + 4 * (n + 1) + 4 * k)[0] & 0x3FFFFF
            block = self.main[page * 512 : page * 512 + 512]
            if len(block) < 512:
                continue
            count = block[511]
            for i in range(count):
                start = struct.unpack_from("<I", block, 4 * i)[0]
                word = block[4 * (count + 1) + 13 * i] * 2
                style, inside, ends = 0, False, False
                if word:
                    size_ = block[word] * 2 - 1 if block[word] else block[word + 1] * 2
                    body = word + (1 if block[word] else 2)
                    style = struct.unpack_from("<H", block, body)[0]
                    at_, stop = body + 2, min(511, body + size_)
                    while at_ + 2 <= stop:
                        op = struct.unpack_from("<H", block, at_)[0]
                        kind = op >> 13
                        width = _SIZES.get(kind, 0) if kind != 6 else 1 + block[min(at_ + 2, 511)]
                        if op in (_IN_TABLE, _ROW_END) and at_ + 2 < stop:
                            inside |= op == _IN_TABLE and block[at_ + 2] != 0
                            ends |= op == _ROW_END and block[at_ + 2] != 0
                        at_ += 2 + width
                out.append((start, style, inside, ends))
        return sorted(out)

    def text(self) -> tuple[str, list[int]]:
        """The main text and the file offset of each character."""
        out, offsets = [], []
        for first, end, place, narrow in self.pieces:
            end = min(end, self.ccp)
            n = end - first
            if n <= 0:
                continue
            part = self.main[place : place + n * (1 if narrow else 2)].decode("cp1252" if narrow else "utf-16-le", "replace")
            out.append(part)
            offsets += [place + i * (1 if narrow else 2) for i in range(len(part))]
        return "".join(out), offsets

    def document(self) -> dict:
        text, offsets = self.text()
        starts = [r[0] for r in self.runs]
        blocks: list = []
        rows: list = []
        cells: list = []
        cell: list = []
        at = 0
        for k, c in enumerate(text):
            if c not in "\r\x07\x0c" and k != len(text) - 1:
                continue
            own = text[at:k] if c in "\r\x07\x0c" else text[at : k + 1]
            spot = bisect_right(starts, offsets[k]) - 1 if starts else -1
            _, style, inside, ends = self.runs[spot] if spot >= 0 else (0, 0, False, False)
            content = [model.text(t)] if (t := _visible(own)) else []
            if c == "\x07":
                if ends or (not own and cells and not cell):
                    rows.append([(b, 1, 1) for b in cells])
                    cells = []
                else:
                    cells.append(cell + ([model.paragraph(content)] if content else []))
                cell = []
            elif inside and c == "\r":
                cell += [model.paragraph(content)] if content else []
            else:
                if rows:
                    blocks.append(model.table(model.grid_of(rows), 1))
                    rows = []
                if content:
                    blocks.append(model.heading(style, content) if 1 <= style <= 9 else model.paragraph(content))
            at = k + 1
        if cells:
            rows.append([(b, 1, 1) for b in cells])
        if rows:
            blocks.append(model.table(model.grid_of(rows), 1))
        return model.document(blocks)


def _visible(text: str) -> str:
    """Without field codes and other marks; results of fields stay."""
    out, hidden = [], []
    for c in text:
        if c == "\x13":
            hidden.append(True)
        elif c == "\x14":
            if hidden:
                hidden[-1] = False
        elif c == "\x15":
            if hidden:
                hidden.pop()
        elif not any(hidden):
            out.append({"\x0b": "\n", "\x1e": "-", "\xa0": " "}.get(c, c if c >= " " or c == "\t" else ""))
    return "".join(out).strip()


def read(data: bytes) -> dict:
    return _Reader(data).document()
