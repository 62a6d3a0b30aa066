"""PowerPoint presentations (OOXML): a heading and the shapes' blocks for every slide."""

from __future__ import annotations

from .. import model
from .package import Assets, Package, attribute, child, descend, local, nested_lists


class _Reader:
    def __init__(self, package: Package) -> None:
        self.package, self.assets = package, Assets(package)

    def document(self) -> dict:
        main = self.package.main_part("ppt/presentation.xml")
        relations = self.package.relations(main)
        slides = child(self.package.xml(main), "sldIdLst")
        blocks: list = []
        for s in slides if slides is not None else ():
            ids = [v for k, v in s.attrib.items() if k.endswith("}id")]
            rel = relations.get(ids[0]) if ids else None
            if rel:
                self.relations = self.package.relations(rel[1])
                tree = descend(self.package.xml(rel[1]), "cSld", "spTree")
                blocks += self.shapes(tree if tree is not None else ())
        return model.document(blocks, (), self.assets.found)

    def shapes(self, tree) -> list:
        out: list = []
        for e in tree:
            kind = local(e)
            if kind == "sp":
                out += self.shape(e)
            elif kind == "grpSp":
                out += self.shapes(e)
            elif kind == "graphicFrame":
                out += [self.table(t) for t in e.iter() if local(t) == "tbl"]
            elif kind == "pic":
                alt = next((attribute(d, "descr") or "" for d in e.iter() if local(d) == "cNvPr"), "")
                blip = next((b for b in e.iter() if local(b) == "blip"), None)
                rel = self.relations.get(attribute(blip, "embed", "") if blip is not None else "")
                made = model.image(alt, "unavailable") if rel is None else model.image(alt, "external", url=rel[1]) if rel[2] else self.assets.image(rel[1], alt)
                out.append(model.paragraph([made]))
        return out

    def shape(self, sp) -> list:
        holder = next((p for p in sp.iter() if local(p) == "ph"), None)
        role = "other" if holder is None else attribute(holder, "type", "body")
        body = child(sp, "txBody")
        paragraphs = [(self.level(p), model.merged(self.inlines(p)), p) for p in (body if body is not None else ()) if local(p) == "p"]
        paragraphs = [p for p in paragraphs if p[1]]
        if role in ("sldNum", "dt", "ftr") or not paragraphs:
            return []
        if role in ("title", "ctrTitle"):
            content = []
            for _, inlines, _ in paragraphs:
                content += ([model.text(" ")] if content else []) + inlines
            return [model.heading(2, model.merged(content))]
        out, entries = [], []
        for level, content, p in paragraphs:
            props = child(p, "pPr")
            numbered = child(props, "buAutoNum")
            plain = child(props, "buNone") is not None
            listed = numbered is not None or child(props, "buChar") is not None or (role in ("body", "obj") and not plain)
            if listed:
                marker = "bullet" if numbered is None else self.marker(attribute(numbered, "type", ""))
                start = 1 if numbered is None else int(attribute(numbered, "startAt", "1"))
                entries.append((level, marker, start, [model.paragraph(content)]))
            else:
                out += nested_lists(entries)
                entries = []
                out.append(model.paragraph(content))
        return out + nested_lists(entries)

    @staticmethod
    def marker(kind: str) -> str:
        for sign, name in (("alphaLc", "lower_alpha"), ("alphaUc", "upper_alpha"), ("romanLc", "lower_roman"), ("romanUc", "upper_roman")):
            if kind.startswith(sign):
                return name
        return "decimal"

    @staticmethod
    def level(p) -> int:
        props = child(p, "pPr")
        return int(attribute(props, "lvl", "0")) if props is not None else 0

    def inlines(self, p) -> list:
        out: list = []
        for e in p:
            kind = local(e)
            if kind in ("r", "fld"):
                props, t = child(e, "rPr"), child(e, "t")
                flag = lambda name, props=props: props is not None and attribute(props, name, "0") in ("1", "true")
                struck = props is not None and attribute(props, "strike", "noStrike") != "noStrike"
                run = model.text((t.text or "") if t is not None else "", flag("b"), flag("i"), struck)
                click = child(props, "hlinkClick")
                rel = self.relations.get(attribute(click, "id", "")) if click is not None else None
                out.append(model.link([run], *model.link_to(rel[1])) if rel and rel[2] else run)
            elif kind == "br":
                out.append(model.line_break())
        return out

    def table(self, tbl) -> dict:
        rows = []
        for tr in (e for e in tbl if local(e) == "tr"):
            row = []
            for tc in (e for e in tr if local(e) == "tc"):
                if attribute(tc, "hMerge", "0") in ("1", "true") or attribute(tc, "vMerge", "0") in ("1", "true"):
                    continue
                body = child(tc, "txBody")
                blocks = [model.paragraph(c) for p in (body if body is not None else ()) if local(p) == "p" and (c := model.merged(self.inlines(p)))]
                row.append((blocks, int(attribute(tc, "gridSpan", "1")), int(attribute(tc, "rowSpan", "1"))))
            rows.append(row)
        return model.table(model.grid_of(rows), min(1, len(rows)))


def read(data: bytes) -> dict:
    return _Reader(Package(data)).document()
