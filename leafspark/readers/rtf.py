"""Rich Text Format."""

from __future__ import annotations

import re

from .. import model
from ..errors import malformed, unsupported
from .package import nested_lists

_TOKEN = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)
_SKIPPED = {
    "fonttbl", "colortbl", "info", "header", "headerl", "headerr", "headerf", "footer", "footerl", "footerr", "footerf", "generator", "xmlnstbl",
    "themedata", "colorschememapping", "datastore", "latentstyles", "listtable", "listoverridetable", "rsidtbl", "mmathPr", "pgptbl", "filetbl",
    "revtbl", "bkmkend", "nonshppict", "objdata", "template", "ftnsep", "ftnsepc", "aftnsep", "aftnsepc", "wgrffmtfilter",
}
_SIGNS = {"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "tab": "\t", "emspace": " ", "enspace": " "}
_PAGES = {"mac": "mac_roman", "pc": "cp437", "pca": "cp850"}


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.codec = data, "cp1252"
        self.blocks: list = []
        self.notes: list = []
        self.assets: list = []
        self.levels: dict[int, int] = {}  # style number: heading level
        self.run: list = []
        self.rows: list = []
        self.cells: list = []
        self.cell: list = []
        self.entries: list = []

    def read(self) -> dict:
        state = {"bold": False, "italic": False, "strike": False, "skip": False, "uc": 1, "to": "body", "hidden": False}
        para = {"style": 0, "outline": None, "table": False, "listed": False, "label": "", "level": 0}
        stack: list = []
        skip = 0
        pending = b""
        fresh = False  # whether a group has just begun
        holders: list = []  # (depth, kind, text or saved run)

        def flush() -> None:
            nonlocal pending
            if pending:
                put(pending.decode(self.codec, "replace"))
                pending = b""

        def put(t: str) -> None:
            if state["skip"] or state["hidden"]:
                return
            if state["to"] in ("label", "field", "style", "pict", "bookmark"):
                holders[-1][2].append(t)
            else:
                self.run.append(model.text(t, state["bold"], state["italic"], state["strike"]))

        for m in _TOKEN.finditer(self.data):
            word, number, hexed, sign, brace, text = m.groups()
            if text is not None:
                flush_now = text[skip:] if skip else text
                skip = max(0, skip - len(text))
                pending += flush_now
                fresh = False
                continue
            if hexed is not None:
                if skip:
                    skip -= 1
                else:
                    pending += bytes([int(hexed, 16)])
                continue
            flush()
            if brace == b"{":
                stack.append(dict(state))
                fresh = True
                continue
            if brace == b"}":
                if not stack:
                    break
                depth = len(stack)
                while holders and holders[-1][0] == depth:
                    self.close_holder(holders.pop(), para, holders)
                state.clear()
                state.update(stack.pop())
                continue
            if sign is not None:
                if sign == b"*":
                    state["skip"] = state["skip"] or not self.known(m.end())
                elif sign == b"~":
                    put(" ")
                elif sign == b"_":
                    put("-")
                elif sign in b"\\{}":
                    put(sign.decode())
                fresh = False
                continue
            if word is None:
                continue
            name, n = word.decode(), int(number) if number else None
            opened, fresh = fresh, False
            if name in _SKIPPED:
                state["skip"] = True
            elif state["skip"] and name not in ("u",):
                continue
            elif name in ("b", "i", "strike"):
                state[{"b": "bold", "i": "italic", "strike": "strike"}[name]] = n != 0
            elif name == "plain":
                state.update(bold=False, italic=False, strike=False, hidden=False)
            elif name == "v":
                state["hidden"] = n != 0
            elif name in ("par", "sect", "page"):
                self.end_paragraph(para)
            elif name == "pard":
                para.update(style=0, outline=None, table=False, listed=False, label="", level=0)
            elif name == "line":
                self.run.append(model.line_break())
            elif name == "intbl":
                para["table"] = True
            elif name == "cell":
                self.end_paragraph(para | {"table": True})
                self.cells.append(self.cell)
                self.cell = []
            elif name == "row":
                self.rows.append([(c, 1, 1) for c in self.cells])
                self.cells = []
            elif name == "s":
                para["style"] = n or 0
                if state["to"] == "style":
                    holders[-1].append(n or 0)
            elif name == "outlinelevel":
                para["outline"] = n
            elif name == "ilvl":
                para["level"] = n or 0
            elif name == "ls":
                para["listed"] = True
            elif name == "u":
                code = (n or 0) & 0xFFFF
                put(chr(code))
                skip = state["uc"]
            elif name == "uc":
                state["uc"] = n or 0
            elif name == "ansicpg" and n:
                self.codec = self.usable(f"cp{n}" if n != 65001 else "utf-8")
            elif name in _PAGES:
                self.codec = _PAGES[name]
            elif name in _SIGNS:
                put(_SIGNS[name])
            elif name == "stylesheet":
                state["to"] = "sheet"
                holders.append([len(stack), "sheet", []])
            elif name in ("listtext", "pntext"):
                state["to"] = "label"
                holders.append([len(stack), "label", []])
            elif name == "fldinst":
                state["to"] = "field"
                holders.append([len(stack), "field", []])
            elif name == "fldrslt":
                holders.append([len(stack), "result", self.run])
                self.run = []
            elif name == "field":
                holders.append([len(stack), "whole", []])
            elif name == "bkmkstart":
                state["to"] = "bookmark"
                holders.append([len(stack), "bookmark", []])
            elif name == "footnote":
                holders.append([len(stack), "note", (self.run, self.blocks, self.rows, self.cells, self.cell, self.entries, dict(para))])
                self.run, self.blocks, self.rows, self.cells, self.cell, self.entries = [], [], [], [], [], []
            elif name == "ftnalt" and holders and holders[-1][1] == "note":
                holders[-1].append("endnote")
            elif name == "pict":
                state["to"] = "pict"
                holders.append([len(stack), "pict", [], ""])
            elif name in ("pngblip", "jpegblip") and state["to"] == "pict":
                holders[-1][3] = "png" if name == "pngblip" else "jpeg"
            if opened and state["to"] == "sheet" and not state["skip"]:
                state["to"] = "style"
                holders.append([len(stack), "style", [], *([n or 0] if name == "s" else [])])
        flush()
        self.end_paragraph(para)
        self.close_blocks()
        return model.document(self._surrogates(self.blocks), self._surrogates(self.notes), self.assets)

    def known(self, at: int) -> bool:
        m = re.match(rb"\\([a-z]+)", self.data[at : at + 40])
        return bool(m) and m[1].decode() in ("shppict", "fldinst", "bkmkstart", "listtext", "pict")

    @staticmethod
    def usable(codec: str) -> str:
        try:
            b"".decode(codec)
            return codec
        except LookupError:
            return "cp1252"

    def close_holder(self, holder: list, para: dict, outer: list) -> None:
        kind, body = holder[1], holder[2]
        if kind == "label":
            para["listed"], para["label"] = True, "".join(body).strip()
        elif kind == "style":
            name = "".join(body).strip().rstrip(";").lower()
            if (m := re.fullmatch(r"heading (\d)", name)) and len(holder) > 3:
                self.levels[holder[3]] = int(m[1])
        elif kind == "field" and outer and outer[-1][1] == "whole":
            outer[-1][2].append("".join(body))
        elif kind == "result":
            content, self.run = model.merged(self.run), body
            inst = "".join(outer[-1][2]) if outer and outer[-1][1] == "whole" else ""
            m = re.search(r'HYPERLINK\s+(\\l\s+)?"([^"]+)"', inst)
            if m and content:
                content = [model.link(content, *(("anchor", m[2]) if m[1] else model.link_to(m[2])))]
            self.run += content
        elif kind == "bookmark":
            self.run.append(model.anchor("".join(body).strip()))
        elif kind == "note":
            self.end_paragraph({"style": 0, "outline": None, "table": False, "listed": False, "label": "", "level": 0})
            self.close_blocks()
            made = self.blocks
            self.run, self.blocks, self.rows, self.cells, self.cell, self.entries, _ = body
            own = str(len(self.notes) + 1)
            self.notes.append(model.note(own, holder[3] if len(holder) > 3 else "footnote", made))
            self.run.append(model.note_ref(own))
        elif kind == "pict":
            digits = re.sub(r"[^0-9a-fA-F]", "", "".join(body))
            if holder[3] and digits:
                n, ext = len(self.assets), holder[3]
                part = f"pict/image{n + 1}.{'jpg' if ext == 'jpeg' else ext}"
                self.assets.append(model.asset(n, f"image/{ext}", part, bytes.fromhex(digits[: len(digits) // 2 * 2])))
                self.run.append(model.image("", "asset", asset_id=n))
            elif digits:
                self.run.append(model.image("", "unavailable"))

    def end_paragraph(self, para: dict) -> None:
        content, self.run = model.merged(self.run), []
        if para["table"]:
            if content:
                self.cell.append(model.paragraph(content))
            return
        if not content:
            return
        level = para["outline"] + 1 if para["outline"] is not None and para["outline"] < 9 else self.levels.get(para["style"])
        if para["listed"] and not level:
            self.close_tables()
            marker = "decimal" if re.match(r"\d+", para["label"]) else "bullet"
            start = int(re.match(r"\d+", para["label"])[0]) if marker == "decimal" else 1
            self.entries.append((para["level"], marker, start, [model.paragraph(content)]))
            para["label"] = ""
            return
        self.close_blocks()
        if level:
            anchor = next((i["anchor"] for i in content if i["kind"] == "anchor"), None)
            content = [i for i in content if i["kind"] != "anchor"]
            self.blocks.append(model.heading(level, content, anchor))
        else:
            self.blocks.append(model.paragraph(content))

    def close_tables(self) -> None:
        if self.rows:
            self.blocks.append(model.table(model.grid_of(self.rows), 1))
            self.rows = []

    def close_blocks(self) -> None:
        self.close_tables()
        self.blocks += nested_lists(self.entries)
        self.entries = []

    def _surrogates(self, value):
        """Pairs of \\u escapes joined into the characters they spell."""
        if isinstance(value, str):
            return value.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        if isinstance(value, dict):
            return {k: self._surrogates(v) for k, v in value.items()}
        return [self._surrogates(v) for v in value] if isinstance(value, list) else value


def read(data: bytes) -> dict:
    if data.lstrip(b" \t\r\n")[:5] != b"{\\rtf":
        raise malformed("not an RTF document")
    if len(data) > 512 << 20:
        raise unsupported("RTF document of more than 512 MiB")
    return _Reader(data).read()
