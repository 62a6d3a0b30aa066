"""PDF files: objects, page content and fonts, as positioned glyphs. The layout is in :mod:`.pdf_layout`."""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from dataclasses import dataclass, field

from ..errors import ConvertError, malformed, unsupported
from .package import MAX_ENTRY_BYTES, over
from .pdf_layout import Glyph, page_markdown
from .pdf_security import Security

#: Nested forms, and operands before an operator, that a page may have.
_MOST_FORMS, _MOST_OPERANDS = 64, 1_000_000
_WS = b"\x00\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_BLANK = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_REF_TAIL = re.compile(rb"[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[ \t\r\n]+(\d{1,5})[ \t\r\n]+obj\b")
MAX_DEPTH = 100


class Name(str):
    __slots__ = ()


class Word(bytes):
    """A keyword or operator."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    entries: dict
    raw: bytes
    owner: object = field(default=None, repr=False)
    number: int = 0
    generation: int = 0


class Lexer:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def blank(self) -> None:
        self.at = _BLANK.match(self.data, self.at).end()

    def value(self, refs: bool = True, depth: int = 0):
        """The next object, or a Word; EOFError at the end."""
        if depth > MAX_DEPTH:
            raise malformed("objects are nested too deeply")
        self.blank()
        data, at = self.data, self.at
        if at >= len(data):
            raise EOFError
        c = data[at : at + 1]
        if c == b"/":
            m = _REGULAR.match(data, at + 1)
            self.at = m.end() if m else at + 1
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m[0]) if m else b""
            return Name(raw.decode("latin-1"))
        if c == b"(":
            return self._literal()
        if data[at : at + 2] == b"<<":
            self.at = at + 2
            out: dict = {}
            while True:
                key = self.value(refs, depth + 1)
                if key == Word(b">>") and isinstance(key, Word):
                    return out
                if isinstance(key, Word):
                    raise malformed("broken dictionary")
                out[str(key)] = self.value(refs, depth + 1)
        if c == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise EOFError
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at = at + 1
            items: list = []
            while True:
                item = self.value(refs, depth + 1)
                if isinstance(item, Word) and item == b"]":
                    return items
                items.append(item)
        if c in b"]{}" or data[at : at + 2] == b">>":
            self.at = at + (2 if c == b">" else 1)
            return Word(data[at : self.at])
        m = _REGULAR.match(data, at)
        if not m:
            self.at = at + 1
            return Word(c)
        self.at, raw = m.end(), m[0]
        try:
            number = float(raw) if b"." in raw or b"e" in raw.lower() else int(raw)
        except ValueError:
            return {b"true": True, b"false": False, b"null": None}.get(raw, Word(raw))
        if refs and isinstance(number, int) and (r := _REF_TAIL.match(data, self.at)):
            self.at = r.end()
            return Ref(number)
        return number

    def _literal(self) -> bytes:
        out, depth, at, data = bytearray(), 1, self.at + 1, self.data
        plain = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
        while at < len(data):
            c = data[at]
            at += 1
            if c == 92 and at < len(data):
                e = data[at]
                at += 1
                if e in plain:
                    out.append(plain[e])
                elif 48 <= e <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(data, at - 1)
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                elif e == 13:
                    at += data[at : at + 1] == b"\n"
                elif e != 10:
                    out.append(e)
                continue
            depth += (c == 40) - (c == 41)
            if depth == 0:
                break
            out.append(c)
        self.at = at
        return bytes(out)


class Document:
    def __init__(self, data: bytes) -> None:
        start = data[:1024].find(b"%PDF-")
        if start < 0:
            raise malformed("not a PDF: no header")
        self.data = data[start:]
        self.cache: dict = {}
        self.places: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.security: Security | None = None
        self.packs: dict[int, tuple[bytes, list]] = {}
        try:
            self._tables()
            self._unlock()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise malformed("no catalog")
        except (ConvertError, ValueError, EOFError, KeyError, IndexError, TypeError, struct.error, zlib.error):
            self._rebuild()
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise malformed("invalid PDF structure")
        self.pages = list(self._page_list(root.get("Pages"), {}, set()))
        if not self.pages:
            raise malformed("invalid PDF structure")

    def _unlock(self) -> None:
        """Decrypt streams from here on, if the file is encrypted."""
        if "Encrypt" in self.trailer and self.security is None:
            entries, names = self.get(self.trailer["Encrypt"]), self.get(self.trailer.get("ID"))
            name = self.get(names[0]) if isinstance(names, list) and names else b""
            entries = {k: self.get(v) for k, v in entries.items()} if isinstance(entries, dict) else {}
            self.security = Security(entries, name if isinstance(name, bytes) else b"")

    def _tables(self) -> None:
        spot = self.data.rfind(b"startxref")
        at, seen = int(re.match(rb"startxref\s+(\d+)", self.data[spot : spot + 40])[1]) if spot >= 0 else -1, set()
        if at < 0:
            raise malformed("no cross-reference table")
        while at is not None and at not in seen:
            seen.add(at)
            lexer = Lexer(self.data, at)
            lexer.blank()
            if self.data[lexer.at : lexer.at + 4] == b"xref":
                lexer.at += 4
                while True:
                    first = lexer.value()
                    if isinstance(first, Word):
                        break
                    count = lexer.value()
                    for k in range(count):
                        place, _, kind = lexer.value(refs=False), lexer.value(refs=False), lexer.value()
                        if kind == b"n":
                            self.places.setdefault(first + k, (place,))
                trailer = lexer.value()
            else:
                trailer = self._cross_reference(self._object_at(at))
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            hybrid = trailer.get("XRefStm")
            if isinstance(hybrid, int) and hybrid not in seen:
                seen.add(hybrid)
                self._cross_reference(self._object_at(hybrid))
            at = trailer.get("Prev")

    def _cross_reference(self, stream) -> dict:
        if not isinstance(stream, Stream) or stream.entries.get("Type") != "XRef":
            raise malformed("no cross-reference stream")
        widths, body = stream.entries["W"], self.decoded(stream)
        index = stream.entries.get("Index") or [0, stream.entries["Size"]]
        row, at = sum(widths), 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for number in range(first, first + count):
                cells, spot = [], at
                for w in widths:
                    cells.append(int.from_bytes(body[spot : spot + w], "big"))
                    spot += w
                at += row
                kind = cells[0] if widths[0] else 1
                if kind == 1:
                    self.places.setdefault(number, (cells[1],))
                elif kind == 2:
                    self.places.setdefault(number, (cells[1], cells[2]))
        return stream.entries

    def _rebuild(self) -> None:
        """Find the objects by their headers where the tables are broken."""
        self.cache, self.places, self.packs = {}, {}, {}
        trailer = dict(self.trailer)
        for m in _OBJECT.finditer(self.data):
            self.places[int(m[1])] = (m.start(),)
        for m in re.finditer(rb"trailer", self.data):
            try:
                found = Lexer(self.data, m.end()).value()
                trailer |= found if isinstance(found, dict) else {}
            except (EOFError, ConvertError):
                continue
        for number in list(self.places):
            o = self.get(Ref(number))
            if isinstance(o, Stream) and o.entries.get("Type") == "XRef":
                trailer = o.entries | trailer
        self.trailer = trailer
        self._unlock()
        for number in list(self.places):
            o = self.get(Ref(number))
            if isinstance(o, Stream) and o.entries.get("Type") == "ObjStm":
                try:
                    for k, inner in enumerate(self._packed_numbers(o)):
                        self.places.setdefault(inner, (number, k))
                except (ValueError, EOFError, ConvertError, TypeError):
                    continue
        if not isinstance(self.get(trailer.get("Root")), dict):
            for number in list(self.places):
                o = self.get(Ref(number))
                if isinstance(o, dict) and o.get("Type") == "Catalog":
                    trailer["Root"] = Ref(number)

    def _object_at(self, at: int):
        m = _OBJECT.match(self.data, _BLANK.match(self.data, at).end())
        if not m:
            raise malformed("object not found")
        lexer = Lexer(self.data, m.end())
        found = lexer.value()
        lexer.blank()
        if isinstance(found, dict) and self.data[lexer.at : lexer.at + 6] == b"stream":
            start = lexer.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else 1
            size = found.get("Length")
            size = self.get(size) if isinstance(size, Ref) else size
            end = start + size if isinstance(size, int) and size >= 0 else -1
            if end < 0 or not re.match(rb"\s*endstream", self.data[end : end + 20]):
                end = self.data.find(b"endstream", start)
                end = len(self.data) if end < 0 else end
                if not isinstance(size, int) or abs(end - start - size) > 2:
                    end -= self.data[end - 1 : end] == b"\n"
            return Stream(found, self.data[start:end], self, int(m[1]), int(m[2]))
        return found

    def _packed_numbers(self, stream: Stream) -> list[int]:
        lexer = Lexer(self.decoded(stream))
        numbers = [lexer.value(refs=False) for _ in range(2 * stream.entries["N"])]
        return numbers[::2]

    def _packed(self, number: int, depth: int) -> tuple[bytes, list]:
        """An object stream's content, and where each of its objects begins."""
        if number not in self.packs:
            holder = self.get(Ref(number), depth + 1)
            body, first = self.decoded(holder), self.get(holder.entries["First"])
            lexer = Lexer(body)
            heads = [lexer.value(refs=False) for _ in range(2 * holder.entries["N"])]
            self.packs[number] = body, [first + at for at in heads[1::2]]
        return self.packs[number]

    def get(self, o, depth: int = 0):
        """The object itself behind references."""
        while isinstance(o, Ref) and depth < 50:
            if o.number not in self.cache:
                self.cache[o.number] = None
                place = self.places.get(o.number)
                try:
                    if place and len(place) == 1:
                        self.cache[o.number] = self._object_at(place[0])
                    elif place:
                        body, starts = self._packed(place[0], depth)
                        self.cache[o.number] = Lexer(body, starts[place[1]]).value()
                except (EOFError, ValueError, KeyError, IndexError, TypeError, AttributeError, ConvertError):
                    pass
            o, depth = self.cache[o.number], depth + 1
        return o

    def decoded(self, stream: Stream) -> bytes:
        data = stream.raw
        if self.security and stream.entries.get("Type") != "XRef":
            data = self.security.stream(data, stream.number, stream.generation)
        filters, parms = self.get(stream.entries.get("Filter")) or [], self.get(stream.entries.get("DecodeParms"))
        filters = [self.get(f) for f in filters] if isinstance(filters, list) else [filters]
        parms = parms if isinstance(parms, list) else [parms]
        for k, f in enumerate(filters):
            parm = self.get(parms[k]) if k < len(parms) else None
            if f in ("FlateDecode", "Fl"):
                data = _predicted(_inflate(data), parm if isinstance(parm, dict) else {})
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif f in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif f in ("LZWDecode", "LZW"):
                data = _predicted(_lzw(data, (parm or {}).get("EarlyChange", 1)), parm if isinstance(parm, dict) else {})
            elif f in ("RunLengthDecode", "RL"):
                data = _run_lengths(data)
            else:
                break
        return data

    def _page_list(self, node, inherited: dict, seen: set):
        number = node.number if isinstance(node, Ref) else id(node)
        o = self.get(node)
        if number in seen or not isinstance(o, dict):
            return
        seen.add(number)
        own = inherited | {k: o[k] for k in ("Resources", "MediaBox", "Rotate") if k in o}
        if "Kids" in o:
            for kid in self.get(o["Kids"]) or []:
                yield from self._page_list(kid, own, seen)
        elif o.get("Type", "Page") == "Page":
            yield own | o


def _inflate(data: bytes) -> bytes:
    machine = zlib.decompressobj()
    try:
        out = machine.decompress(data, MAX_ENTRY_BYTES + 1)
    except zlib.error:
        out, machine = b"", zlib.decompressobj(-15)
        try:
            out = machine.decompress(data[2:], MAX_ENTRY_BYTES + 1)
        except zlib.error:
            return b""
    if len(out) > MAX_ENTRY_BYTES:
        raise over("max_entry_bytes")
    return out


def _predicted(data: bytes, parm: dict) -> bytes:
    kind = parm.get("Predictor", 1)
    if kind < 10:
        return data
    unit = max(1, parm.get("Colors", 1) * parm.get("BitsPerComponent", 8) // 8)
    row = (parm.get("Columns", 1) * parm.get("Colors", 1) * parm.get("BitsPerComponent", 8) + 7) // 8
    out, before = bytearray(), bytes(row)
    for at in range(0, len(data), row + 1):
        how, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(line)):
            left = line[i - unit] if i >= unit else 0
            up, corner = before[i], before[i - unit] if i >= unit else 0
            if how == 1:
                line[i] = (line[i] + left) & 255
            elif how == 2:
                line[i] = (line[i] + up) & 255
            elif how == 3:
                line[i] = (line[i] + (left + up) // 2) & 255
            elif how == 4:
                guess = left + up - corner
                nearest = min((left, up, corner), key=lambda x: abs(guess - x))
                line[i] = (line[i] + nearest) & 255
        before = bytes(line) + bytes(row - len(line))
        out += line
    return bytes(out)


def _ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~>")[0].removeprefix(b"<~"):
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def _lzw(data: bytes, early: int) -> bytes:
    out, table, width, bits, held, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            own = table[code]
        elif last:
            own = last + last[:1]
        else:
            break
        out += own
        if last:
            table.append(last + own[:1])
        last = own
        size = len(table) + early
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if len(out) > MAX_ENTRY_BYTES:
            raise over("max_entry_bytes")
    return bytes(out)


def _run_lengths(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


# Glyph names that no rule spells out.
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":",
    "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•",
    "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ",
    "oslash": "ø", "Oslash": "Ø", "degree": "°", "section": "§", "paragraph": "¶", "copyright": "©", "registered": "®", "trademark": "™",
    "Euro": "€", "sterling": "£", "yen": "¥", "cent": "¢", "minus": "−", "multiply": "×", "divide": "÷", "plusminus": "±", "mu": "µ",
    "guillemotleft": "«", "guillemotright": "»", "dotlessi": "ı", "nbspace": " ",
}
_DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_ACCENTS = {"acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON"}


def glyph_text(name: str) -> str:
    name = name.split(".")[0]
    if name in _GLYPHS:
        return _GLYPHS[name]
    if len(name) == 1:
        return name
    if name in _DIGITS:
        return str(_DIGITS.index(name))
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        return chr(int(m[1] or m[2], 16)) if int(m[1] or m[2], 16) < 0x110000 else ""
    if m := re.fullmatch(r"([A-Za-z])(\w+)", name):
        if m[2] in _ACCENTS:
            case = "SMALL" if m[1].islower() else "CAPITAL"
            try:
                return unicodedata.lookup(f"LATIN {case} LETTER {m[1].upper()} WITH {_ACCENTS[m[2]]}")
            except KeyError:
                return m[1]
    return ""


class Font:
    """Codes to text and widths."""

    def __init__(self, pdf: Document, entries: dict) -> None:
        get = pdf.get
        base = str(get(entries.get("BaseFont")) or "")
        self.composite = get(entries.get("Subtype")) == "Type0"
        self.widths: dict[int, float] = {}
        self.map: dict[int, str] = {}
        self.code_bytes = 2 if self.composite else 1
        own = entries
        if self.composite:
            own = get((get(entries.get("DescendantFonts")) or [{}])[0]) or {}
            self.default = float(get(own.get("DW")) or 1000)
            self._wide(get, get(own.get("W")) or [])
        else:
            first, widths = get(entries.get("FirstChar")) or 0, get(entries.get("Widths")) or []
            self.widths = {first + i: float(w) for i, w in enumerate(map(get, widths)) if isinstance(w, (int, float))}
            self.default = 600.0 if "Courier" in base else 500.0
            self._encode(get, get(entries.get("Encoding")))
        descriptor = get(own.get("FontDescriptor")) or {}
        weight, flags = get(descriptor.get("FontWeight")) or 400, get(descriptor.get("Flags")) or 0
        self.bold = bool(re.search(r"bold|black|heavy", base, re.I)) or weight >= 600 or bool(flags & 1 << 18)
        self.italic = bool(re.search(r"italic|oblique", base, re.I)) or bool(flags & 64)
        self.scale = 0.001
        if get(entries.get("Subtype")) == "Type3":
            matrix = get(entries.get("FontMatrix")) or [0.001]
            self.scale = abs(float(get(matrix[0]))) or 0.001
        unicode = get(entries.get("ToUnicode"))
        if isinstance(unicode, Stream):
            self._to_unicode(pdf.decoded(unicode))

    def _wide(self, get, entries: list) -> None:
        at = 0
        while at + 1 < len(entries):
            first, second = get(entries[at]), get(entries[at + 1])
            if isinstance(second, list):
                self.widths |= {first + i: float(get(w)) for i, w in enumerate(second)}
                at += 2
            elif at + 2 < len(entries) and isinstance(second, int):
                self.widths |= dict.fromkeys(range(first, min(second, first + 65536) + 1), float(get(entries[at + 2])))
                at += 3
            else:
                break

    def _encode(self, get, encoding) -> None:
        base = encoding if isinstance(encoding, str) else get((encoding or {}).get("BaseEncoding")) if isinstance(encoding, dict) else None
        codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        for code in range(32, 256):
            self.map[code] = bytes([code]).decode(codec, "ignore")
        at = 0
        for item in get(encoding.get("Differences")) or [] if isinstance(encoding, dict) else []:
            item = get(item)
            if isinstance(item, int):
                at = item
            else:
                self.map[at] = glyph_text(str(item))
                at += 1

    def _to_unicode(self, data: bytes) -> None:
        text = lambda b: b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")
        lexer, held = Lexer(data), []
        while True:
            try:
                token = lexer.value(refs=False)
            except EOFError:
                return
            except ConvertError:
                return
            if not isinstance(token, Word):
                held.append(token)
                continue
            if token == b"endcodespacerange" and held and isinstance(held[-1], bytes):
                self.code_bytes = max(1, len(held[-1]))
            elif token == b"endbfchar":
                for a, b in zip(held[::2], held[1::2], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        self.map[int.from_bytes(a, "big")] = text(b)
            elif token == b"endbfrange":
                for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                    lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    for k in range(lo, min(hi, lo + 65535) + 1):
                        if isinstance(c, list):
                            self.map[k] = text(c[k - lo]) if k - lo < len(c) else ""
                        else:
                            last = int.from_bytes(c[-2:], "big") + k - lo
                            self.map[k] = text(c[:-2] + (last & 0xFFFF).to_bytes(min(2, len(c)), "big"))
            held = []

    def codes(self, data: bytes):
        step = self.code_bytes
        for at in range(0, len(data) - step + 1, step):
            code = int.from_bytes(data[at : at + step], "big")
            yield code, self.map.get(code, "" if self.composite else chr(code)), self.widths.get(code, self.default) * self.scale


def _times(a: tuple, b: tuple) -> tuple:
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


class Content:
    """Glyphs and images of one page."""

    def __init__(self, pdf: Document, page: dict) -> None:
        self.pdf, self.glyphs, self.images = pdf, [], 0
        self.fonts: dict = {}
        parts = pdf.get(page.get("Contents"))
        parts = [pdf.get(p) for p in parts] if isinstance(parts, list) else [parts]
        data = b"\n".join(pdf.decoded(p) for p in parts if isinstance(p, Stream))
        rotate = pdf.get(page.get("Rotate")) or 0
        turn = {90: (0, -1, 1, 0, 0, 0), 180: (-1, 0, 0, -1, 0, 0), 270: (0, 1, -1, 0, 0, 0)}.get(rotate % 360, (1, 0, 0, 1, 0, 0))
        self.run(data, pdf.get(page.get("Resources")) or {}, turn, 0)

    def font(self, resources: dict, name: str) -> Font | None:
        holder = self.pdf.get(resources.get("Font")) or {}
        found = holder.get(name)
        key = found.number if isinstance(found, Ref) else id(found)
        if key not in self.fonts:
            entries = self.pdf.get(found)
            self.fonts[key] = Font(self.pdf, entries) if isinstance(entries, dict) else None
        return self.fonts[key]

    def run(self, data: bytes, resources: dict, ctm: tuple, depth: int) -> None:
        lexer, stack, held = Lexer(data), [], []
        state = {"ctm": ctm, "font": None, "size": 1.0, "char": 0.0, "word": 0.0, "wide": 1.0, "lead": 0.0, "rise": 0.0, "mode": 0}
        tm = line = (1, 0, 0, 1, 0, 0)

        def show(raw) -> None:
            """A glyph for every word and blank of the string, and the text matrix moved on."""
            nonlocal tm
            font = state["font"]
            if font is None or not isinstance(raw, bytes):
                return
            size, wide = state["size"], state["wide"]
            base = _times(tm, state["ctm"])
            trm = _times((size * wide, 0, 0, size, 0, state["rise"]), base)
            height = (trm[2] ** 2 + trm[3] ** 2) ** 0.5
            upright = abs(trm[1]) > abs(trm[0])
            along = at = begin = end = 0.0
            word = ""

            def put() -> None:
                a, b = trm[4] + begin * base[0], trm[4] + end * base[0]
                self.glyphs.append(Glyph(min(a, b), max(a, b), trm[5] + begin * base[1], height, word, font.bold, font.italic, upright))

            seen = state["mode"] != 3
            gap = state["word"] if font.code_bytes == 1 else 0
            for code, text, width in font.codes(raw):
                along = width * size * wide
                if seen and text:
                    if word and (text == " ") != (word[-1] == " "):
                        put()
                        word = ""
                    if not word:
                        begin = at
                    word, end = word + text, at + along
                at += along + (state["char"] + (gap if code == 32 else 0)) * wide
            if word:
                put()
            tm = _times((1, 0, 0, 1, at, 0), tm)

        while True:
            lexer.blank()
            if lexer.at >= len(data):
                return
            try:
                token = lexer.value(refs=False)
            except EOFError:
                raise malformed("a page's content ends inside an object") from None
            if not isinstance(token, Word):
                held.append(token)
                if len(held) > _MOST_OPERANDS:
                    raise over("max_operands")
                continue
            op, args, held = bytes(token), held, []
            numbers = [x for x in args if isinstance(x, (int, float)) and not isinstance(x, bool)]
            try:
                if op == b"q":
                    stack.append(dict(state))
                elif op == b"Q":
                    state = stack.pop() if stack else state
                elif op == b"cm":
                    state["ctm"] = _times(tuple(numbers[:6]), state["ctm"])
                elif op == b"BT":
                    tm = line = (1, 0, 0, 1, 0, 0)
                elif op == b"Tf":
                    state["font"], state["size"] = self.font(resources, str(args[0])), float(numbers[-1])
                elif op in (b"Td", b"TD"):
                    if op == b"TD":
                        state["lead"] = -numbers[1]
                    tm = line = _times((1, 0, 0, 1, numbers[0], numbers[1]), line)
                elif op == b"Tm":
                    tm = line = tuple(numbers[:6])
                elif op == b"T*":
                    tm = line = _times((1, 0, 0, 1, 0, -state["lead"]), line)
                elif op == b"Tj":
                    show(args[0])
                elif op == b"TJ":
                    for x in args[0]:
                        if isinstance(x, bytes):
                            show(x)
                        else:
                            tm = _times((1, 0, 0, 1, -x / 1000 * state["size"] * state["wide"], 0), tm)
                elif op in (b"'", b'"'):
                    if op == b'"':
                        state["word"], state["char"] = numbers[0], numbers[1]
                    tm = line = _times((1, 0, 0, 1, 0, -state["lead"]), line)
                    show(args[-1])
                elif op in (b"Tc", b"Tw", b"TL", b"Ts", b"Tr", b"Tz"):
                    key = {b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Ts": "rise", b"Tr": "mode", b"Tz": "wide"}[op]
                    state[key] = numbers[0] / 100 if op == b"Tz" else numbers[0]
                elif op == b"Do" and depth >= _MOST_FORMS:
                    raise over("max_form_depth")
                elif op == b"Do":
                    found = self.pdf.get((self.pdf.get(resources.get("XObject")) or {}).get(str(args[0])))
                    if isinstance(found, Stream) and found.entries.get("Subtype") == "Image":
                        self.images += 1
                    elif isinstance(found, Stream):
                        matrix = tuple(map(self.pdf.get, self.pdf.get(found.entries.get("Matrix")) or (1, 0, 0, 1, 0, 0)))
                        inner = self.pdf.get(found.entries.get("Resources")) or resources
                        self.run(self.pdf.decoded(found), inner, _times(matrix, state["ctm"]), depth + 1)
                elif op == b"BI":
                    self.images += 1
                    end = re.compile(rb"[\s]EI(?=[\s]|$)").search(data, lexer.at)
                    lexer.at = end.end() if end else len(data)
            except (IndexError, ValueError, TypeError, KeyError):
                continue


def pages(data: bytes) -> list[str]:
    """The Markdown of every page, blank ones as the empty string.

    A page without text that shows an image needs OCR, which fails the whole document; so does a document in
    which no page has text.
    """
    pdf = Document(data)
    made, flagged, images = [], [], 0
    for number, page in enumerate(pdf.pages, 1):
        content = Content(pdf, page)
        text = page_markdown(content.glyphs)
        images += content.images > 0
        if not text.strip() and content.images:
            flagged.append(number)
        made.append(text if text.strip() else "")
    if flagged:
        raise ConvertError("needsOcr", f"{len(flagged)} of {len(made)} pages need OCR", pages=flagged, page_count=len(made))
    if not any(made):
        raise unsupported(f"PDF has no extractable text (TextBased, {len(made)} pages)")
    return [t.replace("\0", "") for t in made]


def markdown(data: bytes) -> str:
    return "\n".join(t for t in pages(data) if t)
