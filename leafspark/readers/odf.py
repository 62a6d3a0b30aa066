"""OpenDocument text, spreadsheets and presentations."""

from __future__ import annotations

from .. import model
from ..errors import ConvertError
from .excel import MAX_CELLS
from .package import Assets, Package, attribute, child, local, nested_lists, over

#: Blanks that one element may stand for.
_MOST_BLANKS = 1_000_000
_MARKERS = {"1": "decimal", "a": "lower_alpha", "A": "upper_alpha", "i": "lower_roman", "I": "upper_roman"}


class _Reader:
    def __init__(self, package: Package) -> None:
        manifest = package.maybe_xml("META-INF/manifest.xml")
        if manifest is not None and any(local(e) == "encryption-data" for e in manifest.iter()):
            raise ConvertError("encrypted", "the document is password protected")
        self.package, self.assets = package, Assets(package)
        self.root = package.xml("content.xml")
        self.notes: list = []
        self.styles: dict[str, dict] = {}
        self.lists: dict[str, dict[int, tuple[str, int]]] = {}
        for root in (package.maybe_xml("styles.xml"), self.root):
            for holder in root if root is not None else ():
                if local(holder) in ("styles", "automatic-styles"):
                    for s in holder:
                        self._style(s)

    def _style(self, s) -> None:
        name = attribute(s, "name", "")
        if local(s) == "style":
            props = child(s, "text-properties")
            get = (lambda k: attribute(props, k)) if props is not None else (lambda k: None)
            self.styles[name] = {
                "parent": attribute(s, "parent-style-name"),
                "bold": None if get("font-weight") is None else get("font-weight") in ("bold", "600", "700", "800", "900"),
                "italic": None if get("font-style") is None else get("font-style") in ("italic", "oblique"),
                "strike": None if get("text-line-through-style") is None else get("text-line-through-style") != "none",
                "shown": attribute(s, "display-name", name),
            }
        elif local(s) == "list-style":
            levels = {}
            for lvl in s:
                at = int(attribute(lvl, "level", "1"))
                number = local(lvl) == "list-level-style-number"
                levels[at] = (_MARKERS.get(attribute(lvl, "num-format", "1"), "decimal") if number else "bullet", int(attribute(lvl, "start-value", "1")))
            self.lists[name] = levels

    def look(self, name: str | None, what: str) -> bool:
        seen = set()
        while name and name in self.styles and name not in seen:
            seen.add(name)
            if self.styles[name][what] is not None:
                return self.styles[name][what]
            name = self.styles[name]["parent"]
        return False

    def named(self, name: str | None) -> str:
        """Display names of a style and its parents, in lower case."""
        out, seen = [], set()
        while name and name not in seen:
            seen.add(name)
            out.append((self.styles.get(name, {}).get("shown") or name).replace("_20_", " ").lower())
            name = self.styles.get(name, {}).get("parent")
        return " ".join(out)

    def document(self) -> dict:
        body = child(self.root, "body")
        blocks: list = []
        for kind in body if body is not None else ():
            name = local(kind)
            if name == "spreadsheet":
                for t in kind:
                    if local(t) == "table":
                        blocks.append(model.heading(2, [model.text(attribute(t, "name", ""))]))
                        made = self.table(t)
                        blocks += [made] if made["table"]["grid"] else []
            elif name == "presentation":
                for page in kind:
                    if local(page) == "page":
                        blocks += self.slide(page)
            else:
                blocks += self.blocks(kind)
        return model.document(blocks, self.notes, self.assets.found)

    def slide(self, page) -> list:
        out: list = []
        for e in page:
            if local(e) in ("notes", "forms"):
                continue
            if local(e) == "frame" and attribute(e, "class") == "title":
                box = child(e, "text-box")
                content = [i for p in (box if box is not None else ()) for i in self.inlines(p)]
                out += [model.heading(2, model.merged(content))] if model.plain(content).strip() else []
            elif local(e) == "frame":
                out += self.frame_blocks(e)
            else:
                out += self.blocks(e)
        return out

    def frame_blocks(self, frame) -> list:
        for e in frame:
            if local(e) == "text-box":
                return self.blocks(e)
            if local(e) == "table":
                return [self.table(e)]
        made = self.image(frame)
        return [model.paragraph([made])] if made else []

    def blocks(self, parent) -> list:
        out: list = []
        for e in parent:
            kind = local(e)
            if kind == "h":
                content = model.merged(self.inlines(e))
                anchor = next((i["anchor"] for i in content if i["kind"] == "anchor"), None)
                content = [i for i in content if i["kind"] != "anchor"]
                if model.plain(content).strip():
                    out.append(model.heading(int(attribute(e, "outline-level", "1")), content, anchor))
            elif kind == "p":
                out += self.paragraph(e)
            elif kind == "list":
                out += nested_lists(self.entries(e, 1, attribute(e, "style-name")))
            elif kind == "table":
                made = self.table(e)
                out += [made] if made["table"]["grid"] else []
            elif kind == "frame":
                out += self.frame_blocks(e)
            elif kind in ("section", "text-box", "g", "custom-shape", "index-body", "table-of-content", "rect"):
                out += self.blocks(e)
        return out

    def paragraph(self, p) -> list:
        content = model.merged(self.inlines(p))
        style = self.named(attribute(p, "style-name"))
        if not content:
            return [model.rule()] if "horizontal line" in style else []
        if "preformatted" in style:
            return [model.code(model.plain(content))]
        if "title" in style.split() and "subtitle" not in style:
            return [model.heading(1, content)]
        made = [model.paragraph(content)]
        return [model.quote(made)] if "quotation" in style else made

    def entries(self, e, level: int, style: str | None) -> list:
        marker, start = self.lists.get(style or "", {}).get(level, ("bullet", 1))
        out: list = []
        for item in e:
            if local(item) not in ("list-item", "list-header"):
                continue
            blocks: list = []
            for part in item:
                if local(part) == "list":
                    if blocks or not out:
                        out.append((level, marker, start, blocks))
                        blocks = []
                    out += self.entries(part, level + 1, attribute(part, "style-name") or style)
                else:
                    blocks += self.blocks([part])
            if blocks:
                out.append((level, marker, int(attribute(item, "start-value", str(start))), blocks))
        return out

    def inlines(self, e, style: dict | None = None) -> list:
        style = style or {"bold": False, "italic": False, "strike": False}
        out: list = [model.text(e.text, **style)] if e.text else []
        for c in e:
            kind = local(c)
            if kind == "span":
                name = attribute(c, "style-name")
                own = {k: style[k] or self.look(name, k) for k in style}
                inner = self.inlines(c, own)
                if "source text" in self.named(name):
                    inner = [i | {"style": i["style"] | {"code": True}} if i["kind"] == "text" else i for i in inner]
                out += inner
            elif kind == "a":
                out.append(model.link(model.merged(self.inlines(c, style)), *model.link_to(attribute(c, "href", ""))))
            elif kind == "s":
                n = int(attribute(c, "c", "1"))
                if n > _MOST_BLANKS:
                    raise over("max_blanks")
                out.append(model.text(" " * n, **style))
            elif kind == "tab":
                out.append(model.text("\t", **style))
            elif kind == "line-break":
                out.append(model.line_break())
            elif kind in ("bookmark", "bookmark-start"):
                out.append(model.anchor(attribute(c, "name", "")))
            elif kind == "note":
                own = attribute(c, "id") or f"n{len(self.notes) + 1}"
                body = child(c, "note-body")
                what = "endnote" if attribute(c, "note-class") == "endnote" else "footnote"
                self.notes.append(model.note(own, what, self.blocks(body if body is not None else ())))
                out.append(model.note_ref(own))
            elif kind == "frame":
                made = self.image(c)
                if made:
                    out.append(made)
                elif (box := child(c, "text-box")) is not None:
                    out += [i for p in box for i in self.inlines(p, style)]
            elif kind not in ("annotation", "annotation-end", "tracked-changes", "soft-page-break"):
                out += self.inlines(c, style)
            if c.tail:
                out.append(model.text(c.tail, **style))
        return out

    def image(self, frame) -> dict | None:
        pic = child(frame, "image")
        if pic is None:
            return None
        alt = next(("".join(d.itertext()) for n in ("desc", "title") if (d := child(frame, n)) is not None), "")
        href = attribute(pic, "href", "")
        if ":" in href:
            return model.image(alt, "external", url=href)
        return self.assets.image(href.removeprefix("./"), alt)

    def table(self, t) -> dict:
        rows, headers = [], 0
        size = 0

        def walk(parent, head: bool) -> None:
            nonlocal headers, size
            for r in parent:
                kind = local(r)
                if kind in ("table-header-rows", "table-rows", "table-row-group"):
                    walk(r, head or kind == "table-header-rows")
                elif kind == "table-row":
                    row = []
                    for c in r:
                        if local(c) not in ("table-cell", "covered-table-cell"):
                            continue
                        times = int(attribute(c, "number-columns-repeated", "1"))
                        blocks = self.blocks(c)
                        row.append((None if local(c) == "covered-table-cell" else blocks, int(attribute(c, "number-columns-spanned", "1")), int(attribute(c, "number-rows-spanned", "1")), times))
                    while row and not row[-1][0] and row[-1][0] is not None:
                        row.pop()
                    times = int(attribute(r, "number-rows-repeated", "1"))
                    if not row:
                        rows.append((row, times))
                        continue
                    size += times * sum(x[3] for x in row)
                    if size > MAX_CELLS:
                        raise over("max_cells")
                    rows.extend([(row, 1)] * times)
                    headers += times if head and headers == len(rows) - times else 0

        walk(t, False)
        while rows and not rows[-1][0]:
            rows.pop()
        if sum(times for row, times in rows if not row) > MAX_CELLS:
            raise over("max_cells")
        flat = [row for row, times in rows for _ in range(times if not row else 1)]
        grid = model.grid_of([[(b, cs, rs) for b, cs, rs, times in row if b is not None for _ in range(times)] for row in flat])
        return model.table(grid, headers or min(1, len(grid)))


def read(data: bytes) -> dict:
    return _Reader(Package(data)).document()


