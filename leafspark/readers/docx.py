"""Word documents (OOXML)."""

from __future__ import annotations

import re

from .. import model
from .package import Assets, Package, attribute, child, descend, local, nested_lists, value

_MARKERS = {
    "bullet": "bullet", "decimal": "decimal", "decimalZero": "decimal", "lowerLetter": "lower_alpha", "upperLetter": "upper_alpha",
    "lowerRoman": "lower_roman", "upperRoman": "upper_roman",
}


class _Reader:
    def __init__(self, package: Package) -> None:
        self.package = package
        self.part = package.main_part("word/document.xml")
        self.relations = package.relations(self.part)
        self.assets = Assets(package)
        near = {kind: target for kind, target, external in self.relations.values() if not external}
        self.levels = self._styles(near.get("styles", "word/styles.xml"))
        self.numbers = self._numbering(near.get("numbering", "word/numbering.xml"))
        self.note_parts = {k: near.get(f"{k}s", f"word/{k}s.xml") for k in ("footnote", "endnote")}

    def _styles(self, part: str) -> dict[str, int | str]:
        """Style id: heading level, or ``code`` or ``quote``."""
        root, own, based = self.package.maybe_xml(part), {}, {}
        for s in root if root is not None else ():
            if local(s) != "style":
                continue
            sid, name = attribute(s, "styleId", ""), (value(s, "name") or "").lower()
            based[sid] = value(s, "basedOn")
            level = value(s, "pPr", "outlineLvl")
            if m := re.fullmatch(r"heading (\d)", name):
                own[sid] = int(m[1])
            elif name == "title":
                own[sid] = 1
            elif name == "subtitle":
                own[sid] = 2
            elif level and level.isdigit() and int(level) < 9:
                own[sid] = int(level) + 1
            elif "quote" in name:
                own[sid] = "quote"
            elif "code" in name or "preformatted" in name:
                own[sid] = "code"
        for sid in based:
            at, seen = sid, set()
            while at and at not in own and at not in seen:
                seen.add(at)
                at = based.get(at)
            if at in own:
                own[sid] = own[at]
        return own

    def _numbering(self, part: str) -> dict[str, dict[int, tuple[str, int]]]:
        """Number id: level: (marker, start)."""
        root = self.package.maybe_xml(part)
        abstract, out = {}, {}
        for n in root if root is not None else ():
            if local(n) == "abstractNum":
                abstract[attribute(n, "abstractNumId")] = {
                    int(attribute(lvl, "ilvl", "0")): (_MARKERS.get(value(lvl, "numFmt", default="decimal"), "decimal"), int(value(lvl, "start", default="1")))
                    for lvl in n if local(lvl) == "lvl"
                }
        for n in root if root is not None else ():
            if local(n) == "num":
                levels = dict(abstract.get(value(n, "abstractNumId"), {}))
                for o in n:
                    if local(o) == "lvlOverride" and (start := value(o, "startOverride")):
                        at = int(attribute(o, "ilvl", "0"))
                        levels[at] = (levels.get(at, ("decimal", 1))[0], int(start))
                out[attribute(n, "numId")] = levels
        return out

    def document(self) -> dict:
        body = child(self.package.xml(self.part), "body")
        blocks = self.blocks(body if body is not None else ())
        notes = []
        for kind, part in self.note_parts.items():
            root = self.package.maybe_xml(part)
            if root is None:
                continue
            self.relations = self.package.relations(part)
            for n in root:
                if local(n) == kind and attribute(n, "type") in (None, "normal"):
                    notes.append(model.note(self._note_id(kind, attribute(n, "id", "")), kind, self.blocks(n)))
        return model.document(blocks, notes, self.assets.found)

    @staticmethod
    def _note_id(kind: str, own: str) -> str:
        return own if kind == "footnote" else f"e{own}"

    def blocks(self, parent) -> list:
        out: list = []
        entries: list = []

        def close() -> None:
            out.extend(nested_lists(entries))
            entries.clear()

        for e in parent:
            kind = local(e)
            if kind == "p":
                made, number = self.paragraph(e)
                if number and made:
                    entries.append((*number, made))
                elif made:
                    close()
                    out += made
            elif kind == "tbl":
                close()
                out.append(self.table(e))
            elif kind in ("sdt", "customXml", "ins", "smartTag"):
                close()
                inner = child(e, "sdtContent")
                out += self.blocks(e if inner is None else inner)
        close()
        return self._joined(out)

    @staticmethod
    def _joined(blocks: list) -> list:
        """Neighbouring code lines as one block, and neighbouring quotes as one."""
        out: list = []
        for b in blocks:
            last = out[-1] if out else None
            if last and b["kind"] == last["kind"] == "code_block":
                out[-1] = last | {"text": last["text"] + "\n" + b["text"]}
            elif last and b["kind"] == last["kind"] == "block_quote":
                out[-1] = model.quote(last["blocks"] + b["blocks"])
            else:
                out.append(b)
        return out

    def paragraph(self, p) -> tuple[list, tuple | None]:
        """Blocks of a paragraph, and (level, marker, start) if it is a list entry."""
        props = child(p, "pPr")
        style = self.levels.get(value(props, "pStyle"))
        outline = value(props, "outlineLvl")
        if outline and outline.isdigit() and int(outline) < 9:
            style = int(outline) + 1
        if (maths := [m for m in p if local(m) == "oMathPara"]) and len(p) <= 2:
            return [model.math("".join(t.text or "" for t in maths[0].iter() if local(t) == "t"))], None
        content = model.merged(self.inlines(p))
        if isinstance(style, int):
            anchor = next((i["anchor"] for i in content if i["kind"] == "anchor"), None)
            content = [i for i in content if i["kind"] != "anchor"]
            return ([model.heading(style, content, anchor)] if model.plain(content).strip() else []), None
        if not content:
            edge = descend(props, "pBdr", "bottom")
            return ([model.rule()] if edge is not None else []), None
        if style == "code":
            return [model.code(model.plain(content))], None
        made = [model.paragraph(content)]
        if style == "quote":
            return [model.quote(made)], None
        number = value(props, "numPr", "numId")
        if number and number != "0":
            level = int(value(props, "numPr", "ilvl", default="0"))
            marker, start = self.numbers.get(number, {}).get(level, ("bullet", 1))
            return made, (level, marker, start)
        return made, None

    def inlines(self, parent, link: bool = False) -> list:
        out: list = []
        field: list[str] | None = None
        hidden = 0
        for e in parent:
            kind = local(e)
            if kind == "r":
                mark = child(e, "fldChar")
                if mark is not None:
                    state = attribute(mark, "fldCharType")
                    hidden = 1 if state == "begin" else 0 if state in ("separate", "end") else hidden
                    if state == "begin":
                        field, at = [], len(out)
                    elif state == "end" and field:
                        if (m := re.search(r'HYPERLINK\s+(\\l\s+)?"([^"]+)"', "".join(field))) and out[at:]:
                            target = ("anchor", m[2]) if m[1] else model.link_to(m[2])
                            out[at:] = [model.link(model.merged(out[at:]), *target)]
                        field = None
                    continue
                if hidden:
                    field += [t.text or "" for t in e if local(t) == "instrText"]
                    continue
                out += self.run(e)
            elif kind == "hyperlink":
                content = model.merged(self.inlines(e))
                rel = self.relations.get(attribute(e, "id", ""))
                anchor = attribute(e, "anchor")
                if rel:
                    out.append(model.link(content, *model.link_to(rel[1] + (f"#{anchor}" if anchor else ""))))
                elif anchor:
                    out.append(model.link(content, "anchor", anchor))
                else:
                    out += content
            elif kind == "bookmarkStart":
                name = attribute(e, "name", "")
                if name and not name.startswith("_GoBack"):
                    out.append(model.anchor(name))
            elif kind == "oMath":
                out.append({"kind": "math", "text": "".join(t.text or "" for t in e.iter() if local(t) == "t")})
            elif kind == "sdt":
                box = next((c for c in e.iter() if local(c) == "checkbox"), None)
                if box is not None:
                    out.append(model.checkbox(value(box, "checked", default="0") in ("1", "true", "on")))
                else:
                    inner = child(e, "sdtContent")
                    out += self.inlines(inner) if inner is not None else []
            elif kind in ("ins", "smartTag", "fldSimple", "customXml", "dir", "bdo"):
                out += self.inlines(e)
        return out

    def run(self, r) -> list:
        props = child(r, "rPr")
        on = lambda name: (c := child(props, name)) is not None and attribute(c, "val", "1") not in ("0", "false", "none", "off")
        if on("vanish"):
            return []
        style = {"bold": on("b"), "italic": on("i"), "strike": on("strike") or on("dstrike")}
        fixed = "code" in (value(props, "rStyle") or "").lower()
        out: list = []
        add = lambda t: out.append(model.text(t, **style, code=fixed))
        for e in r:
            kind = local(e)
            if kind == "t":
                add(e.text or "")
            elif kind == "tab":
                add("\t")
            elif kind == "noBreakHyphen":
                add("-")
            elif kind == "sym":
                code = attribute(e, "char", "")
                add(chr(int(code, 16)) if re.fullmatch(r"[0-9A-Fa-f]{1,5}", code) else "")
            elif kind in ("br", "cr"):
                if attribute(e, "type") not in ("page", "column"):
                    out.append(model.line_break())
            elif kind in ("footnoteReference", "endnoteReference"):
                out.append(model.note_ref(self._note_id(kind[:-9], attribute(e, "id", ""))))
            elif kind in ("drawing", "pict", "object", "AlternateContent"):
                out += self.images(e)
        return out

    def images(self, e) -> list:
        alt = next((attribute(d, "descr") or attribute(d, "title") or "" for d in e.iter() if local(d) == "docPr"), "")
        out = []
        for b in e.iter():
            if local(b) in ("blip", "imagedata"):
                rel = self.relations.get(attribute(b, "embed") or attribute(b, "link") or attribute(b, "id") or "")
                if rel is None:
                    out.append(model.image(alt, "unavailable"))
                else:
                    out.append(model.image(alt, "external", url=rel[1]) if rel[2] else self.assets.image(rel[1], alt))
        return out

    def table(self, tbl) -> dict:
        rows, headers, opened = [], 0, {}
        for tr in (e for e in self._flat(tbl) if local(e) == "tr"):
            at, row = int(value(tr, "trPr", "gridBefore", default="0") or 0), []
            row += [[[], 1, 1] for _ in range(at)]
            for tc in (e for e in self._flat(tr) if local(e) == "tc"):
                span = max(1, int(value(tc, "tcPr", "gridSpan", default="1") or 1))
                merge = descend(tc, "tcPr", "vMerge")
                if merge is not None and attribute(merge, "val", "continue") == "continue" and at in opened:
                    opened[at][2] += 1
                else:
                    cell = [self.blocks(tc), span, 1]
                    row.append(cell)
                    opened.pop(at, None)
                    if merge is not None:
                        opened[at] = cell
                at += span
            if descend(tr, "trPr", "tblHeader") is not None and headers == len(rows):
                headers += 1
            rows.append(row)
        grid = model.grid_of([[tuple(c) for c in row] for row in rows])
        return model.table(grid, headers or min(1, len(grid)))

    @staticmethod
    def _flat(parent):
        for e in parent:
            inner = child(e, "sdtContent") if local(e) == "sdt" else None
            yield from inner if inner is not None else (e,)


def read(data: bytes) -> dict:
    return _Reader(Package(data)).document()
