"""Excel workbooks: XLSX (XML), XLSB (binary parts) and XLS (BIFF8). Every sheet is a heading and a table."""

from __future__ import annotations

import re
import struct
from datetime import datetime, timedelta

from .. import model
from ..errors import ConvertError, malformed
from .cfb import CompoundFile
from .package import Package, attribute, child, local, over

MAX_CELLS = 5_000_000

# Built-in number formats that show dates, times or percentages.
_DATES = {14: "date", 15: "date", 16: "date", 17: "date", 18: "time", 19: "time", 20: "time", 21: "time", 22: "datetime", 45: "time", 46: "time", 47: "time"}
_PERCENT = {9: 0, 10: 2}


def format_kind(number: int, code: str | None) -> tuple[str, int]:
    """(kind, decimals) of a number format."""
    if code is None:
        return ("percent", _PERCENT[number]) if number in _PERCENT else (_DATES.get(number, "general"), 0)
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code).split(";")[0].lower()
    if "%" in bare:
        return "percent", len(m[1]) if (m := re.search(r"\.([0#?]+)", bare)) else 0
    day, clock = bool(re.search(r"[dy]|m(?!.*[hs])", bare)), bool(re.search(r"[hs]", bare))
    return ("datetime" if day and clock else "date" if day else "time" if clock else "general"), 0


def shown(x: float, kind: tuple[str, int], since_1904: bool = False) -> str:
    """A number as text."""
    name, decimals = kind
    if name == "percent":
        return f"{x * 100:.{decimals}f}%"
    if name in ("date", "datetime", "time") and 0 <= x < 2958466:
        if name == "time" and x < 1:
            seconds = round(x * 86400)
            return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
        start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30) if x >= 60 else datetime(1899, 12, 31)
        when = start + timedelta(seconds=round(x * 86400))
        return when.strftime("%Y-%m-%d" if name == "date" else "%Y-%m-%d %H:%M:%S")
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    return repr(float(f"{x:.15g}"))


def sheet_blocks(name: str, cells: dict[tuple[int, int], str], merges: list[tuple[int, int, int, int]]) -> list:
    """A heading with the sheet's name and its used range as a table."""
    heading = model.heading(2, [model.text(name)])
    used = {k for k, v in cells.items() if v != ""}
    if not used:
        return [heading]
    top, left = min(r for r, _ in used), min(c for _, c in used)
    bottom, right = max(r for r, _ in used), max(c for _, c in used)
    if (bottom - top + 1) * (right - left + 1) > MAX_CELLS:
        raise over("max_cells")
    grid = [[model.text_cell(cells.get((r, c), "")) for c in range(left, right + 1)] for r in range(top, bottom + 1)]
    for r1, c1, r2, c2 in merges:
        r1, c1, r2, c2 = max(r1, top), max(c1, left), min(r2, bottom), min(c2, right)
        if r1 > r2 or c1 > c2:
            continue
        for r in range(r1, r2 + 1):
            for c in range(c1, c2 + 1):
                grid[r - top][c - left] = model.covered(r1 - top, c1 - left)
        grid[r1 - top][c1 - left] = model.text_cell(cells.get((r1, c1), ""), col_span=c2 - c1 + 1, row_span=r2 - r1 + 1)
    return [heading, model.table(grid, 1)]


def _place(ref: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?(\d{1,7})", ref)
    if not m:
        raise malformed(f"bad cell reference {ref[:20]}")
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def _texts(e) -> str:
    """Text of a string item, without phonetic runs."""
    return "".join((c.text or "") if local(c) == "t" else _texts(c) if local(c) == "r" else "" for c in e)


def _xlsx(p: Package, main: str) -> dict:
    root, relations = p.xml(main), p.relations(main)
    near = {kind: target for kind, target, _ in relations.values()}
    shared = [_texts(si) for si in p.xml(near["sharedStrings"])] if near.get("sharedStrings") in p else []
    kinds = [("general", 0)]
    if near.get("styles") in p:
        styles = p.xml(near["styles"])
        formats = child(styles, "numFmts")
        codes = {int(f.get("numFmtId", "0")): f.get("formatCode", "") for f in (formats if formats is not None else ())}
        xfs = child(styles, "cellXfs")
        kinds = [format_kind(int(x.get("numFmtId", "0")), codes.get(int(x.get("numFmtId", "0")))) for x in (xfs if xfs is not None else ())] or kinds
    props = child(root, "workbookPr")
    since_1904 = props is not None and props.get("date1904", "0") in ("1", "true")
    blocks: list = []
    sheets = child(root, "sheets")
    for s in sheets if sheets is not None else ():
        rel = relations.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""))
        if rel is None or rel[0] != "worksheet":
            continue
        cells: dict = {}
        merges: list = []
        row = -1
        sheet = p.xml(rel[1])
        data = child(sheet, "sheetData")
        for r in data if data is not None else ():
            row, col = int(r.get("r", row + 2)) - 1, -1
            for c in r:
                row, col = _place(c.get("r")) if c.get("r") else (row, col + 1)
                v, inline = child(c, "v"), child(c, "is")
                raw, kind = (v.text or "") if v is not None else "", c.get("t", "n")
                if kind == "s":
                    text = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
                elif kind == "inlineStr":
                    text = _texts(inline) if inline is not None else ""
                elif kind == "b":
                    text = "TRUE" if raw == "1" else "FALSE" if raw else ""
                elif kind == "n" and raw:
                    at = int(c.get("s", "0"))
                    text = shown(float(raw), kinds[at] if at < len(kinds) else ("general", 0), since_1904)
                else:
                    text = raw
                cells[row, col] = text
        for m in sheet.iter():
            if local(m) == "mergeCell" and ":" in m.get("ref", ""):
                a, b = m.get("ref").split(":")
                merges.append((*_place(a), *_place(b)))
        blocks += sheet_blocks(attribute(s, "name", ""), cells, merges)
    return model.document(blocks)


def _records(data: bytes):
    """(type, payload) of the records of a binary part."""
    at = 0
    while at < len(data):
        kind, at = data[at], at + 1
        if kind & 0x80 and at < len(data):
            kind, at = (kind & 0x7F) | (data[at] & 0x7F) << 7, at + 1
        size = shift = 0
        while at < len(data) and shift < 28:
            byte, at = data[at], at + 1
            size |= (byte & 0x7F) << shift
            shift += 7
            if not byte & 0x80:
                break
        yield kind, data[at : at + size]
        at += size


def _wide(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", data, at)[0]
    if n == 0xFFFFFFFF:
        return "", at + 4
    return data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def _rk(v: int) -> float:
    x = float(v >> 2 if v < 1 << 31 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & ~3) << 32))[0]
    return x / 100 if v & 1 else x


_ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A", 43: "#GETTING_DATA"}


def _xlsb(p: Package, main: str) -> dict:
    relations = p.relations(main)
    near = {kind: target for kind, target, _ in relations.values()}
    shared = [_wide(d, 1)[0] for k, d in _records(p.read(near["sharedStrings"])) if k == 19] if near.get("sharedStrings") in p else []
    codes, kinds, inside = {}, [], False
    if near.get("styles") in p:
        for k, d in _records(p.read(near["styles"])):
            if k == 44:
                codes[struct.unpack_from("<H", d)[0]] = _wide(d, 2)[0]
            elif k in (617, 618):
                inside = k == 617
            elif k == 47 and inside:
                number = struct.unpack_from("<H", d, 2)[0]
                kinds.append(format_kind(number, codes.get(number)))
    blocks: list = []
    for kind, d in _records(p.read(main)):
        if kind != 156:
            continue
        rel_id, at = _wide(d, 8)
        name, _ = _wide(d, at)
        rel = relations.get(rel_id)
        if rel is None or rel[0] != "worksheet":
            continue
        cells, merges, row = {}, [], 0
        for k, c in _records(p.read(rel[1])):
            if k == 0:
                row = struct.unpack_from("<I", c)[0]
            elif 1 <= k <= 11 and len(c) >= 8:
                col, style = struct.unpack_from("<II", c)
                how = kinds[style & 0xFFFFFF] if style & 0xFFFFFF < len(kinds) else ("general", 0)
                if k == 2:
                    cells[row, col] = shown(_rk(struct.unpack_from("<I", c, 8)[0]), how)
                elif k in (5, 9):
                    cells[row, col] = shown(struct.unpack_from("<d", c, 8)[0], how)
                elif k in (3, 11):
                    cells[row, col] = _ERRORS.get(c[8], "#ERR")
                elif k in (4, 10):
                    cells[row, col] = "TRUE" if c[8] else "FALSE"
                elif k in (6, 8):
                    cells[row, col] = _wide(c, 8)[0]
                elif k == 7:
                    spot = struct.unpack_from("<I", c, 8)[0]
                    cells[row, col] = shared[spot] if spot < len(shared) else ""
            elif k == 176:
                r1, r2, c1, c2 = struct.unpack_from("<4I", c)
                merges.append((r1, c1, r2, c2))
        blocks += sheet_blocks(name, cells, merges)
    return model.document(blocks)


class _Strings:
    """Strings of a BIFF8 record and its continuations, whose character width may change at each."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.part < len(self.parts):
            got = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n:
                self.part, self.at = self.part + 1, 0
        return out

    def text(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        wide, out = flags & 1, ""
        while n and self.part < len(self.parts):
            here = self.parts[self.part]
            fit = min(n, (len(here) - self.at) // (2 if wide else 1))
            raw = here[self.at : self.at + fit * (2 if wide else 1)]
            out += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            self.at, n = self.at + len(raw), n - fit
            if n:
                self.part, self.at = self.part + 1, 1
                if self.part < len(self.parts) and self.parts[self.part]:
                    wide = self.parts[self.part][0] & 1
        self.take(4 * runs + extra)
        return out


def _short(data: bytes, at: int, wide_count: bool = False) -> str:
    n, flags = struct.unpack_from("<HB" if wide_count else "<BB", data, at)
    at += 3 if wide_count else 2
    return data[at : at + n * (2 if flags & 1 else 1)].decode("utf-16-le" if flags & 1 else "latin-1", "replace")


def _xls(data: bytes) -> dict:
    file = CompoundFile(data)
    if "encryptedpackage" in {n.lower() for n in file.names()}:
        raise ConvertError("encrypted", "the workbook is password protected")
    stream = file.stream("Workbook") or file.stream("Book")
    if stream is None:
        raise malformed("no workbook stream")
    records, at, starts = [], 0, {}
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        starts[at] = len(records)
        records.append((kind, stream[at + 4 : at + 4 + size]))
        at += 4 + size
    sheets, shared, codes, kinds, since_1904 = [], [], {}, [], False
    for k, (kind, d) in enumerate(records):
        if kind == 0x2F:
            raise ConvertError("encrypted", "the workbook is password protected")
        if kind == 0x85:
            sheets.append((struct.unpack_from("<I", d)[0], d[5], _short(d, 6)))
        elif kind == 0xFC:
            parts, more = [d[8:]], k + 1
            while more < len(records) and records[more][0] == 0x3C:
                parts.append(records[more][1])
                more += 1
            strings = _Strings(parts)
            for _ in range(struct.unpack_from("<I", d, 4)[0]):
                if strings.part >= len(parts) or (strings.part == len(parts) - 1 and strings.at + 3 > len(parts[-1])):
                    break
                shared.append(strings.text())
        elif kind == 0x41E:
            codes[struct.unpack_from("<H", d)[0]] = _short(d, 2, wide_count=True)
        elif kind == 0xE0:
            kinds.append(struct.unpack_from("<H", d, 2)[0])
        elif kind == 0x22:
            since_1904 = d[:1] == b"\x01"
        elif kind == 0x0A:
            break
    how = [format_kind(n, codes.get(n)) for n in kinds]
    number = lambda x, xf: shown(x, how[xf] if xf < len(how) else ("general", 0), since_1904)
    blocks: list = []
    for start, kind_of, name in sheets:
        if kind_of != 0 or start not in starts:
            continue
        cells, merges, last = {}, [], None
        for kind, d in records[starts[start] + 1 :]:
            if kind == 0x0A:
                break
            if kind in (0xFD, 0x203, 0x27E, 0x204, 0x205, 0x06, 0x406):
                r, c, xf = struct.unpack_from("<HHH", d)
                if kind == 0xFD:
                    spot = struct.unpack_from("<I", d, 6)[0]
                    cells[r, c] = shared[spot] if spot < len(shared) else ""
                elif kind == 0x203:
                    cells[r, c] = number(struct.unpack_from("<d", d, 6)[0], xf)
                elif kind == 0x27E:
                    cells[r, c] = number(_rk(struct.unpack_from("<I", d, 6)[0]), xf)
                elif kind == 0x204:
                    cells[r, c] = _short(d, 6, wide_count=True)
                elif kind == 0x205:
                    cells[r, c] = _ERRORS.get(d[6], "#ERR") if d[7] else "TRUE" if d[6] else "FALSE"
                elif d[12:14] == b"\xff\xff":
                    last = (r, c) if d[6] == 0 else last
                    cells[r, c] = ("TRUE" if d[8] else "FALSE") if d[6] == 1 else _ERRORS.get(d[8], "#ERR") if d[6] == 2 else ""
                else:
                    cells[r, c] = number(struct.unpack_from("<d", d, 6)[0], xf)
            elif kind == 0x207 and last:
                cells[last] = _short(d, 0, wide_count=True)
            elif kind == 0xBD:
                r, c = struct.unpack_from("<HH", d)
                for i in range((len(d) - 6) // 6):
                    xf, v = struct.unpack_from("<HI", d, 4 + 6 * i)
                    cells[r, c + i] = number(_rk(v), xf)
            elif kind == 0xE5:
                for i in range(struct.unpack_from("<H", d)[0]):
                    r1, r2, c1, c2 = struct.unpack_from("<4H", d, 2 + 8 * i)
                    merges.append((r1, c1, r2, c2))
        blocks += sheet_blocks(name, cells, merges)
    return model.document(blocks)


def read(data: bytes) -> dict:
    if data[:4] != b"PK\x03\x04" and data[:4] == b"\xd0\xcf\x11\xe0":
        return _xls(data)
    package = Package(data)
    if "xl/workbook.bin" in package:
        return _xlsb(package, "xl/workbook.bin")
    main = package.main_part("xl/workbook.xml")
    return _xlsb(package, main) if main.endswith(".bin") else _xlsx(package, main)
