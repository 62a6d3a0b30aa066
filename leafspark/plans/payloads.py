"""Small writers that turn lines of text into documents: input for queries, tests and benchmarks.

The first line becomes a heading, the others paragraphs, so the readers' results are known exactly.
"""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
from xml.sax.saxutils import escape, quoteattr

_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
#: One white pixel.
PNG = bytes.fromhex(
    "89504e470d0a1a0a0000000d4948445200000001000000010802000000907753de0000000c49444154789c63f8ffff3f0005fe02fe0def46b80000000049454e44ae426082"
)


def clean(text: str) -> str:
    return escape(_BAD.sub("", text))


def attribute(text: str) -> str:
    """An attribute's value, with its quotes."""
    return quoteattr(_BAD.sub("", text))


def pack(parts: dict[str, str | bytes], stored: str | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == stored else zipfile.ZIP_DEFLATED
            z.writestr(info, body)
    return out.getvalue()


def _relations(*entries: tuple[str, str, str]) -> str:
    made = "".join(f'<Relationship Id="{i}" Type="{_REL}/{kind}" Target="{target}"/>' for i, kind, target in entries)
    return f"<Relationships {_PACK}>{made}</Relationships>"


def _types(kind: str, main: str) -> str:
    return (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        f'<Override PartName="/{main}" ContentType="application/vnd.openxmlformats-officedocument.{kind}.main+xml"/></Types>'
    )


def csv_file(rows: list[list]) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue().encode()


def docx_body(body: str, extra: dict[str, str | bytes] | None = None, relations: list[tuple[str, str, str]] = ()) -> bytes:
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="H{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 7))
    return pack(
        {
            "[Content_Types].xml": _types("wordprocessingml.document", "word/document.xml"),
            "_rels/.rels": _relations(("r1", "officeDocument", "word/document.xml")),
            "word/_rels/document.xml.rels": _relations(("s1", "styles", "styles.xml"), *relations),
            "word/styles.xml": f"<w:styles {_W}>{styles}</w:styles>",
            "word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>",
            **(extra or {}),
        }
    )


def docx_run(text: str, props: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{clean(text)}</w:t></w:r>'


def docx_paragraph(runs: str, style: str | None = None) -> str:
    return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}{runs}</w:p>'


def docx(lines: list[str]) -> bytes:
    return docx_body("".join(docx_paragraph(docx_run(x), "H1" if k == 0 else None) for k, x in enumerate(lines)))


def docx_table(rows: list[list[str]]) -> str:
    cell = lambda v: f"<w:tc>{docx_paragraph(docx_run(v))}</w:tc>"
    return "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows) + "</w:tbl>"


def docx_image(rel: str, alt: str) -> str:
    return f'<w:p><w:r><w:drawing><wp:inline><wp:docPr id="1" name="p" descr={attribute(alt)}/><a:blip r:embed="{rel}"/></wp:inline></w:drawing></w:r></w:p>'


def docx_listed(lines: list[str]) -> bytes:
    """A decimal list that begins at 3, an item a line."""
    level = '<w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl>'
    numbering = f'<w:numbering {_W}><w:abstractNum w:abstractNumId="0">{level}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    mark = '<w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr>'
    body = "".join(f"<w:p>{mark}{docx_run(x)}</w:p>" for x in lines)
    return docx_body(body, {"word/numbering.xml": numbering}, [("n", "numbering", "numbering.xml")])


def docx_referring(lines: list[str]) -> bytes:
    """A paragraph a line, which links to ``https://example.org/<number>`` and has a footnote that repeats the line."""
    paragraph = '<w:p><w:hyperlink r:id="h{0}">{1}</w:hyperlink><w:r><w:footnoteReference w:id="{2}"/></w:r></w:p>'
    body = "".join(paragraph.format(k, docx_run(x), k + 2) for k, x in enumerate(lines))
    notes = "".join(f'<w:footnote w:id="{k + 2}"><w:p>{docx_run(x)}</w:p></w:footnote>' for k, x in enumerate(lines))
    links = [(f'h{k}" TargetMode="External', "hyperlink", f"https://example.org/{k}") for k in range(len(lines))]
    return docx_body(body, {"word/footnotes.xml": f"<w:footnotes {_W}>{notes}</w:footnotes>"}, [("f", "footnotes", "footnotes.xml"), *links])


def docx_merged(lines: list[str]) -> bytes:
    """A table of two columns: the first line over both, then one cell beside all the other lines."""
    cell = lambda text, props="": f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if props else ''}{docx_paragraph(docx_run(text) if text else '')}</w:tc>"
    rows = [cell(x, '<w:gridSpan w:val="2"/>') for x in lines[:1]]
    rows += [cell("" if k else "side", "<w:vMerge/>" if k else '<w:vMerge w:val="restart"/>') + cell(x) for k, x in enumerate(lines[1:])]
    return docx_body(f"<w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>" if rows else "")


def _column(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": _types("spreadsheetml.sheet", "xl/workbook.xml"),
        "_rels/.rels": _relations(("r1", "officeDocument", "xl/workbook.xml")),
        "xl/_rels/workbook.xml.rels": _relations(*[(f"s{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(len(sheets))]),
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="{_REL}"><sheets>'
        + "".join(f'<sheet name={attribute(n)} sheetId="{k + 1}" r:id="s{k}"/>' for k, n in enumerate(sheets))
        + "</sheets></workbook>",
    }

    def cell(r: int, c: int, v) -> str:
        ref = f"{_column(c)}{r + 1}"
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{clean(str(v))}</t></is></c>'

    for k, rows in enumerate(sheets.values()):
        body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"
    return pack(parts)


def pptx(slides: list[list[str]]) -> bytes:
    ns = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{_REL}"'
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": _types("presentationml.presentation", "ppt/presentation.xml"),
        "_rels/.rels": _relations(("r1", "officeDocument", "ppt/presentation.xml")),
        "ppt/_rels/presentation.xml.rels": _relations(*[(f"s{k}", "slide", f"slides/slide{k}.xml") for k in range(len(slides))]),
        "ppt/presentation.xml": f"<p:presentation {ns}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + k}" r:id="s{k}"/>' for k in range(len(slides))) + "</p:sldIdLst></p:presentation>",
    }
    shape = '<p:sp><p:nvSpPr><p:nvPr><p:ph type="{0}"/></p:nvPr></p:nvSpPr><p:txBody>{1}</p:txBody></p:sp>'
    line = lambda t: f"<a:p><a:r><a:t>{clean(t)}</a:t></a:r></a:p>"
    for k, lines in enumerate(slides):
        made = shape.format("title", line(lines[0])) + (shape.format("body", "".join(map(line, lines[1:]))) if lines[1:] else "")
        parts[f"ppt/slides/slide{k}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree>{made}</p:spTree></p:cSld></p:sld>"
    return pack(parts)


_ODF = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for p, n in (("office", "office"), ("text", "text"), ("table", "table"), ("draw", "drawing"), ("presentation", "presentation"), ("style", "style"), ("fo", "xsl-fo-compatible")))


def _spaces(text: str) -> str:
    """Runs of blanks and tabs as OpenDocument elements, which survive white-space collapsing."""
    return re.sub("  +", lambda m: f' <text:s text:c="{len(m[0]) - 1}"/>', clean(text)).replace("\t", "<text:tab/>")


def odf(kind: str, body: str, manifest: str | None = None) -> bytes:
    mimetype = {"odt": "text", "ods": "spreadsheet", "odp": "presentation"}[kind]
    content = f"<office:document-content {_ODF}><office:body><office:{mimetype}>{body}</office:{mimetype}></office:body></office:document-content>"
    parts: dict[str, str | bytes] = {"mimetype": f"application/vnd.oasis.opendocument.{mimetype}", "content.xml": content}
    if manifest:
        parts["META-INF/manifest.xml"] = manifest
    return pack(parts, stored="mimetype")


def odt(lines: list[str]) -> bytes:
    return odf("odt", "".join(f'<text:h text:outline-level="1">{_spaces(x)}</text:h>' if k == 0 else f"<text:p>{_spaces(x)}</text:p>" for k, x in enumerate(lines)))


def ods(sheets: dict[str, list[list[str]]]) -> bytes:
    cell = lambda v: f"<table:table-cell><text:p>{_spaces(v)}</text:p></table:table-cell>"
    return odf("ods", "".join(f'<table:table table:name={attribute(n)}>' + "".join("<table:table-row>" + "".join(map(cell, r)) + "</table:table-row>" for r in rows) + "</table:table>" for n, rows in sheets.items()))


def odp(slides: list[list[str]]) -> bytes:
    box = lambda lines, kind: f'<draw:frame presentation:class="{kind}"><draw:text-box>' + "".join(f"<text:p>{_spaces(x)}</text:p>" for x in lines) + "</draw:text-box></draw:frame>"
    return odf("odp", "".join(f"<draw:page>{box(s[:1], 'title')}{box(s[1:], 'outline') if s[1:] else ''}</draw:page>" for s in slides))


def epub(lines: list[str]) -> bytes:
    body = "".join(f"<h1>{clean(x)}</h1>" if k == 0 else f"<p>{clean(x)}</p>" for k, x in enumerate(lines))
    return pack(
        {
            "mimetype": "application/epub+zip",
            "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
            "O/p.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>',
            "O/a.xhtml": f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body>{body}</body></html>',
        },
        stored="mimetype",
    )


def _rtf_text(text: str) -> str:
    out = []
    for c in text:
        if c in "\\{}":
            out.append("\\" + c)
        elif " " <= c < "\x7f":
            out.append(c)
        else:
            units = c.encode("utf-16-le", "surrogatepass")
            out += [f"\\u{struct.unpack_from('<h', units, k)[0]}?" for k in range(0, len(units), 2)]
    return "".join(out)


def rtf(lines: list[str]) -> bytes:
    made = "".join(f"\\pard{'\\outlinelevel0' if k == 0 else ''} {_rtf_text(x)}\\par\n" for k, x in enumerate(lines))
    return ("{\\rtf1\\ansi\\ansicpg1252\\uc1 " + made + "}").encode("ascii")


def pdf(pages: list[list[str]], images: tuple[int, ...] = ()) -> bytes:
    """A PDF with one line of 10 pt text per line, 20 pt apart; pages numbered in ``images`` (from 1) show an image."""
    chars = sorted({c for p in pages for x in p for c in x})
    codes = {c: k + 1 for k, c in enumerate(chars)}
    cmap = "begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n"
    for k in range(0, len(chars), 100):
        part = chars[k : k + 100]
        cmap += f"{len(part)} beginbfchar\n" + "".join(f"<{codes[c]:04x}> <{c.encode('utf-16-be').hex()}>\n" for c in part) + "endbfchar\n"
    stream = lambda body, extra="": f"<< /Length {len(body)} {extra}>>\nstream\n{body}\nendstream"
    objects = [
        "<< /Type /Catalog /Pages 2 0 R >>", "",
        "<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        "<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /DW 500 >>", stream(cmap + "endcmap"),
        stream("00>", "/Type /XObject /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter /ASCIIHexDecode "),
    ]
    kids = []
    for number, lines in enumerate(pages, 1):
        top = 40 + 20 * len(lines)
        body = "".join(f"BT /F1 10 Tf 1 0 0 1 20 {top - 20 * k} Tm <{''.join(f'{codes[c]:04x}' for c in x)}> Tj ET\n" for k, x in enumerate(lines) if x)
        body += "q 50 0 0 50 20 20 cm /I Do Q\n" if number in images else ""
        kids.append(f"{len(objects) + 1} 0 R")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 600 {top + 40}] /Resources << /Font << /F1 3 0 R >> /XObject << /I 6 0 R >> >> /Contents {len(objects) + 2} 0 R >>")
        objects.append(stream(body))
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>"
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n{o}\nendobj\n".encode("latin-1")
    xref = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{xref}\n%%EOF\n".encode()
    return bytes(out)
