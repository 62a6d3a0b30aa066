"""EPUB publications: the spine's XHTML documents, one after the other."""

from __future__ import annotations

import html.entities
import posixpath
import re
from urllib.parse import unquote

from .. import model
from ..errors import ConvertError, malformed
from .package import Assets, Package, attribute, child, local, parse_xml

_ENTITY = re.compile(rb"&([A-Za-z][A-Za-z0-9]*);")
_XML = {b"amp", b"lt", b"gt", b"quot", b"apos"}
_BLOCKS = {
    "p", "div", "section", "article", "main", "header", "footer", "aside", "nav", "body", "figure", "figcaption", "center", "address", "details",
    "summary", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "dt", "dd", "table", "blockquote", "pre", "hr", "form", "fieldset",
}
_SKIPPED = {"script", "style", "head", "template", "noscript", "title"}
_OL = {"1": "decimal", "a": "lower_alpha", "A": "upper_alpha", "i": "lower_roman", "I": "upper_roman"}


def named_entities(data: bytes) -> bytes:
    """HTML's named entities as numeric references."""

    def of(m: re.Match) -> bytes:
        code = html.entities.name2codepoint.get(m[1].decode())
        return m[0] if m[1] in _XML or code is None else b"&#%d;" % code

    return _ENTITY.sub(of, data)


class Html:
    """Blocks of XHTML elements. ``picture`` makes an image from (source, alt), ``href`` rewrites a target."""

    def __init__(self, picture, href=lambda x: x) -> None:
        self.picture, self.href = picture, href

    def blocks(self, parent) -> list:
        out: list = []
        run: list = []

        def close() -> None:
            content = _trimmed(run)
            if content:
                out.append(model.paragraph(content))
            run.clear()

        def add(text: str | None) -> None:
            if text:
                run.append(model.text(re.sub(r"\s+", " ", text)))

        add(parent.text)
        for e in parent:
            kind = local(e)
            if kind in _BLOCKS:
                close()
                out += self.block(e, kind)
            elif kind and kind not in _SKIPPED:
                if any(local(d) in _BLOCKS for d in e.iter() if d is not e):
                    close()
                    out += self.blocks(e)
                else:
                    run += self.inline(e, {})
            add(e.tail)
        close()
        return out

    def block(self, e, kind: str) -> list:
        if re.fullmatch("h[1-6]", kind):
            content = _trimmed(self.inlines(e, {}))
            return [model.heading(int(kind[1]), content, attribute(e, "id"))] if content else []
        if kind in ("ul", "ol"):
            items = [self.item(li) for li in e if local(li) == "li"]
            start = attribute(e, "start", "1")
            marker = "bullet" if kind == "ul" else _OL.get(attribute(e, "type", "1"), "decimal")
            return [model.list_block(marker, items, int(start) if start.isdigit() else 1)] if items else []
        if kind == "table":
            return self.table(e)
        if kind == "blockquote":
            inner = self.blocks(e)
            return [model.quote(inner)] if inner else []
        if kind == "pre":
            inner = child(e, "code")
            lang = re.search(r"language-(\S+)", attribute(inner, "class", "") if inner is not None else "")
            return [model.code("".join(e.itertext()).strip("\n"), lang[1] if lang else None)]
        if kind == "hr":
            return [model.rule()]
        return self.blocks(e)

    def item(self, li) -> dict:
        blocks = self.blocks(li)
        return model.list_item(blocks)

    def inlines(self, e, style: dict) -> list:
        out = [model.text(re.sub(r"\s+", " ", e.text), **style)] if e.text else []
        for c in e:
            if local(c) and local(c) not in _SKIPPED:
                out += self.inline(c, style)
            if c.tail:
                out.append(model.text(re.sub(r"\s+", " ", c.tail), **style))
        return out

    def inline(self, e, style: dict) -> list:
        kind = local(e)
        if kind == "br":
            return [model.line_break()]
        if kind == "img" or kind == "image":
            return [self.picture(attribute(e, "src") or attribute(e, "href") or "", attribute(e, "alt", ""))]
        if kind == "input":
            box = attribute(e, "type") == "checkbox"
            return [model.checkbox("checked" in e.attrib)] if box else []
        if kind == "math":
            return [{"kind": "math", "text": attribute(e, "alttext") or "".join(e.itertext()).strip()}]
        for tags, name in ((("b", "strong"), "bold"), (("i", "em", "cite", "var"), "italic"), (("s", "del", "strike"), "strike"), (("code", "kbd", "samp", "tt"), "code")):
            if kind in tags:
                style = style | {name: True}
        inner = self.inlines(e, style)
        own = attribute(e, "id")
        if kind == "a" and attribute(e, "href"):
            inner = [model.link(model.merged(inner), *model.link_to(self.href(attribute(e, "href"))))]
        return ([model.anchor(own)] if own else []) + inner

    def table(self, e) -> list:
        rows, headers = [], 0
        out = []
        for part in e.iter():
            if local(part) == "caption" and (content := _trimmed(self.inlines(part, {}))):
                out.append(model.paragraph(content))
        for holder in [e, *[c for c in e if local(c) in ("thead", "tbody", "tfoot")]]:
            for tr in holder:
                if local(tr) != "tr":
                    continue
                cells = [c for c in tr if local(c) in ("td", "th")]
                span = lambda c, k: max(1, min(1000, int(attribute(c, k, "1")))) if attribute(c, k, "1").isdigit() else 1
                rows.append([(self.blocks(c), span(c, "colspan"), span(c, "rowspan")) for c in cells])
                head = local(holder) == "thead" or (cells and all(local(c) == "th" for c in cells))
                headers += head and headers == len(rows) - 1
        rows = [r for r in rows if r]
        return out + ([model.table(model.grid_of(rows), int(headers))] if rows else [])


def _trimmed(run: list) -> list:
    """Merged runs with white space collapsed at the ends and between runs; empty if nothing is left."""
    out: list = []
    space = True
    for i in model.merged(run):
        if i["kind"] == "text" and not i["style"]["code"]:
            value = i["text"].lstrip(" ") if space else i["text"]
            space = value.endswith(" ") if value else space
            if value:
                out.append(i | {"text": value})
        else:
            out.append(i)
            space = i["kind"] == "line_break"
    if out and out[-1]["kind"] == "text":
        out[-1] = out[-1] | {"text": out[-1]["text"].rstrip(" ")}
    out = model.merged(out)
    return out if any(i["kind"] != "anchor" for i in out) else []


def read(data: bytes) -> dict:
    p = Package(data)
    if "META-INF/encryption.xml" in p:
        methods = [attribute(e, "Algorithm", "") for e in p.xml("META-INF/encryption.xml").iter() if local(e) == "EncryptionMethod"]
        if any("adobe.com/pdf/enc" not in m and "idpf.org" not in m for m in methods):
            raise ConvertError("encrypted", "the publication is protected")
    container = p.xml("META-INF/container.xml")
    opf = next((attribute(e, "full-path") for e in container.iter() if local(e) == "rootfile"), None)
    if not opf:
        raise malformed("no root file", "META-INF/container.xml")
    package, folder = p.xml(opf, entities=True), posixpath.dirname(opf)
    where = lambda href, base=folder: posixpath.normpath(posixpath.join(base, unquote(href.split("#")[0])))
    manifest, spine = child(package, "manifest"), child(package, "spine")
    items = {attribute(i, "id"): i for i in (manifest if manifest is not None else ())}
    assets, blocks = Assets(p), []
    for ref in spine if spine is not None else ():
        item = items.get(attribute(ref, "idref"))
        if item is None or "html" not in attribute(item, "media-type", ""):
            continue
        part = where(attribute(item, "href", ""))
        root = parse_xml(named_entities(p.read(part)), part, entities=True)
        base = posixpath.dirname(part)

        def picture(src: str, alt: str, base: str = base) -> dict:
            return model.image(alt, "external", url=src) if re.match(r"[a-z]+:", src) else assets.image(where(src, base), alt)

        body = child(root, "body")
        blocks += Html(picture).blocks(body if body is not None else root)
    return model.document(blocks, (), assets.found)
