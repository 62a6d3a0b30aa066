"""Documents for the tests, written here."""

from leafspark.plans import payloads as P

OUTLINE = P.docx(["Annual plan", "The plan has two parts."])
RICH = P.docx_body(
    P.docx_paragraph(P.docx_run("Results"), "H2")
    + P.docx_paragraph(P.docx_run("bold", "<w:b/>") + P.docx_run(" and ") + P.docx_run("slanted", "<w:i/>"))
    + P.docx_table([["Quarter", "Widgets"], ["Q1", "3|4"]])
    + P.docx_image("i1", "a dot"),
    {"word/media/dot.png": P.PNG},
    [("i1", "image", "media/dot.png")],
)
SHEET = b"Kind,Value,Note\npercent,15.5%,x\nnumber,1234.5,y\n"
MIXED_PDF = P.pdf([["Text on the first page"], []], images=(2,))
ENCRYPTED_ODT = P.odf("odt", "", '<m:manifest xmlns:m="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><m:file-entry m:full-path="content.xml"><m:encryption-data/></m:file-entry></m:manifest>')
BOMB = P.docx_body("", {"word/styles.xml": b" " * ((64 << 20) + 10)})
#: Of a handler that leaves out what is needed to open it.
ENCRYPTED_PDF = MIXED_PDF.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << /Filter /Standard /V 1 /R 2 >>")


def typed(*pages, seal=lambda number, stream: stream, trailer=b""):
    """A PDF of A5 pages in two simple fonts whose characters are half as wide as high, bold where a text begins with *.

    A page is a list of (left, bottom, size, text), bottoms counted from the page's lower edge. ``seal`` encrypts the
    stream of an object, ``trailer`` adds entries to the trailer.
    """
    parts = {1: b"<</Type/Catalog/Pages 2 0 R>>"}
    for own, name in ((3, b"Times-Roman"), (4, b"Times-Bold")):
        parts[own] = b"<</Type/Font/Subtype/Type1/BaseFont/%s/FirstChar 32/LastChar 126/Widths[%s]/Encoding/WinAnsiEncoding>>" % (name, b" ".join([b"500"] * 95))
    for k, page in enumerate(pages):
        shown = [b"BT /%s %d Tf %d %d Td (%s) Tj ET" % (b"B" if t[0] == "*" else b"R", size, x, y, t.lstrip("*").encode()) for x, y, size, t in page]
        stream = seal(6 + 2 * k, b"\n".join(shown))
        parts[5 + 2 * k] = b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 420 595]/Resources<</Font<</R 3 0 R/B 4 0 R>>>>/Contents %d 0 R>>" % (6 + 2 * k)
        parts[6 + 2 * k] = b"<</Length %d>>stream\n%s\nendstream" % (len(stream), stream)
    parts[2] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages))))
    data, offsets = b"%PDF-1.5\n", []
    for own in sorted(parts):
        offsets.append(len(data))
        data += b"%d 0 obj%s endobj\n" % (own, parts[own])
    table = b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return data + b"xref\n0 %d\n0000000000 65535 f \n%strailer<</Size %d/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF" % (len(parts) + 1, table, len(parts) + 1, trailer, len(data))


def row(bottom, *cells, size=9):
    """Cells at their columns' left edges."""
    return [(x, bottom, size, t) for x, t in zip((30, 150, 240, 330), cells, strict=False) if t]


#: A table whose header fills two lines.
RAINFALL = typed(
    [(30, 540, 18, "*Rainfall at four stations"), (30, 510, 9, "Measured with a gauge at each harbour wall."),
     *row(466, "", "*Rain in", "*Sunny", "*Wettest"), *row(460, "*Station", "*June (mm)", "*days", "*day"),
     *row(440, "Northhaven", "61", "14", "9 June"), *row(420, "Eastport", "48", "17", "21 June"), *row(400, "Southcliff", "35", "22", "2 June"), *row(380, "*All", "*144", "*53", "")],
)
#: Labels and what belongs to them.
GAUGE = typed(
    [(30, 540, 18, "*About the gauge"), *[(x, 500 - 18 * k, 9, t) for k, pair in enumerate(
        [("Maker", "Tidewater Instruments"), ("Height above the sea wall", "2 m"), ("Read at", "7 o'clock")]) for x, t in zip((30, 250), pair, strict=True)]],
)
_LETTER = [(30, 540, 18, "*To the harbour master"), (30, 500, 9, "The gauge was moved in spring."), (30, 470, 9, "It is read every morning.")]
LETTER = typed(_LETTER, [], [(30, 540, 18, "*Postscript"), (30, 500, 9, "The old gauge is for sale.")])
SURVEY = typed(_LETTER, row(471, "*Bird", "*Seen") + row(450, "Tern", "12") + row(430, "Gull", "90"))
