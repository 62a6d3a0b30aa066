import re
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from leafspark import FORMATS, ConvertError, convert, format_from_bytes, format_from_extension, format_from_path, model
from leafspark.formats import check_format, join_formats
from leafspark.plans import payloads as P

from . import fixtures as X


def code(make, *args):
    with pytest.raises(ConvertError) as e:
        make(*args)
    return e.value


def plain_lines(markdown):
    kept = [x for x in markdown.split("\n") if not x.startswith("|---")]
    return [y for x in kept if (y := re.sub(" +", " ", re.sub(r"\*\*|\||\s+", " ", x)).strip())]


def test_format_from_bytes():
    assert format_from_bytes(b"%PDF-1.7\n") == "pdf"
    assert format_from_bytes(b"{\\rtf1") == "rtf"
    for data, want in ((X.OUTLINE, "docx"), (X.RICH, "docx"), (X.MIXED_PDF, "pdf"), (P.xlsx({"a": [["b"]]}), "xlsx"), (P.pptx([["t"]]), "pptx"), (P.odt(["x"]), "odt"), (P.ods({"a": [["b"]]}), "ods"), (P.odp([["t"]]), "odp"), (P.epub(["x"]), "epub")):
        assert format_from_bytes(data) == want
    for data in (b"a,b\n1,2\n", X.SHEET, b"", None, b"PK\x03\x04broken", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1broken"):
        assert format_from_bytes(data) is None


def test_format_names():
    wanted = {".pptm": "pptx", "ppsx": "pptx", ".docm": "docx", "xls": "xlsx", ".xlsb": "xlsx", "xlsm": "xlsx", "..PDF": "pdf", "html": None, "": None}
    assert {k: format_from_extension(k) for k in wanted} == wanted
    assert format_from_path("report.odt") == "odt"
    assert format_from_path("report.unknown") is None
    assert format_from_path("a.b/.docx") is None
    assert join_formats() == ", ".join(FORMATS) and len(FORMATS) == 12
    with pytest.raises(ValueError, match='unknown format "word"; expected one of doc, docx, odt'):
        check_format("word")


def test_csv():
    data = b"name,qty\nwidgets,3\n"
    assert code(convert.to_markdown, data).code == "unsupported"
    assert convert.to_markdown(data, "csv") == "| name | qty |\n| --- | --- |\n| widgets | 3 |"
    blocks = convert.to_document(data, "csv")["blocks"]
    assert [b["kind"] for b in blocks] == ["table"] and blocks[0]["table"]["header_rows"] == 1
    assert convert.to_document(b"", "csv") == {"blocks": [], "notes": [], "assets": []}
    assert "| 1 |  |" in convert.to_markdown(b"\xef\xbb\xbfa,b\n1\n", "csv")


def test_path(tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_bytes(X.SHEET)
    assert "| --- |" in convert.path_to_markdown(str(sheet))
    outline = tmp_path / "outline.bin"
    outline.write_bytes(X.OUTLINE)
    assert "# Annual plan" in convert.path_to_markdown(str(outline))
    assert code(convert.path_to_markdown, str(tmp_path / "missing.doc")).code == "io"


def test_office():
    assert "| Quarter | Widgets |" in convert.to_markdown(X.RICH)
    assert "3\\|4" in convert.to_markdown(X.RICH)
    assert convert.to_markdown(X.RICH, "docx") == convert.to_markdown(X.RICH)
    doc = convert.to_document(X.RICH)
    heading = next(b for b in doc["blocks"] if b["kind"] == "heading")
    assert 1 <= heading["level"] <= 6 and heading["content"][0]["kind"] == "text" and heading["content"][0]["text"]
    assert set(heading["content"][0]["style"]) == {"bold", "italic", "strike", "code"}
    assert [(a["media_type"], a["origin_part"]) for a in doc["assets"]] == [("image/png", "word/media/dot.png")]
    assert "**bold** and *slanted*" in convert.to_markdown(X.RICH)


@pytest.mark.parametrize("write", [P.docx, P.odt, P.rtf, P.epub])
def test_same_text_in_every_format(write):
    doc = convert.to_document(write(["Tïtle & more", "One <two> {three} \\ four", "日本語 😀"]))
    assert [(b["kind"], b["content"][0]["text"]) for b in doc["blocks"]] == [("heading", "Tïtle & more"), ("paragraph", "One <two> {three} \\ four"), ("paragraph", "日本語 😀")]


def test_sheets_and_slides():
    rows = [["a", "b"], ["1", "x y"]]
    for data in (P.xlsx({"S": rows}), P.ods({"S": rows})):
        assert convert.to_markdown(data) == "## S\n\n| a | b |\n| --- | --- |\n| 1 | x y |"
    assert "| 0.5 |" in convert.to_markdown(P.xlsx({"S": [["h"], [0.5]]}))
    assert convert.to_markdown(P.pptx([["T", "one", "two"]])) == "## T\n\n- one\n- two"
    assert convert.to_markdown(P.odp([["T", "one"]])) == "## T\n\none"


def test_errors():
    e = code(convert.to_document, X.MIXED_PDF)
    assert e.code == "unsupported" and "markdown" in e.message.lower()
    e = code(convert.to_markdown, X.MIXED_PDF)
    assert (e.code, e.pages, e.page_count) == ("needsOcr", [2], 2)
    assert code(convert.to_markdown, X.ENCRYPTED_ODT).code == "encrypted"
    e = code(convert.to_markdown, X.BOMB)
    assert (e.code, e.limit) == ("resourceLimit", "max_entry_bytes")
    e = code(convert.to_markdown, P.pack({"[Content_Types].xml": " "}), "docx")
    assert (e.code, e.part) == ("missingPart", "word/document.xml")
    assert code(convert.to_markdown, b"not a document", "docx").code == "malformed"
    bad = P.docx_body("", {"word/document.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'})
    assert code(convert.to_markdown, bad).code == "malformed"
    for name in ("doc", "ppt", "xlsx", "odt", "rtf", "epub", "pdf"):
        assert code(convert.to_markdown, b"junk", name).code == "malformed"


def test_every_cut_of_a_document_is_an_error_or_a_result():
    for data, name in ((X.RICH, "docx"), (X.RAINFALL, "pdf"), (P.rtf(["a", "b"]), "rtf"), (P.xlsx({"a": [["b"]]}), "xlsx")):
        for cut in range(0, len(data), max(1, len(data) // 40)):
            value, error = convert.guarded(convert.to_markdown, data[:cut], name)
            assert (value is None) != (error is None)


def test_concurrent_calls():
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(convert.to_markdown, [X.OUTLINE, X.RICH] * 8))
    assert len(set(made)) == 2


def test_pages_in_order():
    pages = convert.to_pages(X.SURVEY)
    assert [n for n, _ in pages] == [1, 2] and convert.to_pages(X.SURVEY, "pdf") == pages
    assert pages[0][1].startswith("# To the harbour master") or pages[0][1].startswith("## To the harbour master")
    for data in (X.SURVEY, X.LETTER, X.GAUGE, X.RAINFALL):
        assert "\n".join(t for _, t in convert.to_pages(data) if t) == convert.to_markdown(data)


def test_blank_pages_stay():
    pages = convert.to_pages(X.LETTER)
    assert [(n, t == "") for n, t in pages] == [(1, False), (2, True), (3, False)]
    assert "# Postscript" in pages[2][1] and "The old gauge is for sale." in pages[2][1]


def test_page_errors():
    e = code(convert.to_pages, X.MIXED_PDF)
    assert (e.code, e.pages, e.page_count) == ("needsOcr", [2], 2)
    assert code(convert.to_pages, X.ENCRYPTED_PDF).code == "encrypted"
    assert code(convert.to_pages, b"%PDF-1.7\nnot really a pdf", "pdf").code == "malformed"
    assert code(convert.to_pages, P.pdf([[], []])).code == "unsupported"
    assert code(convert.to_pages, X.RICH).message == "per-page conversion supports PDF only, not Docx"
    assert code(convert.to_pages, X.SHEET, "csv").code == "unsupported"
    assert code(convert.to_pages, b"name,qty\n").message == "unrecognized file content: name the format explicitly"


def test_table_with_a_header_of_two_lines():
    ((_, text),) = convert.to_pages(X.RAINFALL)
    lines = text.split("\n")
    (rule,) = [k for k, x in enumerate(lines) if x.startswith("|---|")]
    bare = [x.replace("*", "").strip("|").split("|") for x in (lines[rule - 1], *lines[rule + 1 : rule + 5])]
    assert bare[0] == ["Station", "Rain in June (mm)", "Sunny days", "Wettest day"]
    assert bare[1:4] == [["Northhaven", "61", "14", "9 June"], ["Eastport", "48", "17", "21 June"], ["Southcliff", "35", "22", "2 June"]]
    assert {"Eastport 48 17 21 June", "All 144 53"} <= set(plain_lines(text)) and "Measured with a gauge at each harbour wall." in text


def test_labels_and_values_stay_together():
    ((_, text),) = convert.to_pages(X.GAUGE)
    assert ["Maker Tidewater Instruments", "Height above the sea wall 2 m", "Read at 7 o'clock"] == plain_lines(text)[-3:]


def test_broken_cross_reference_is_rebuilt():
    broken = re.sub(rb"startxref\n\d+", b"startxref\n99999999", X.SURVEY)
    assert convert.to_pages(broken) == convert.to_pages(X.SURVEY)


def test_lists_notes_links_and_merged_cells():
    w = P._W
    numbering = f'<w:numbering {w}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    item = lambda t, lvl: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="1"/></w:numPr></w:pPr>{P.docx_run(t)}</w:p>'
    merged = '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>tall</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>z</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    note = f'<w:footnotes {w}><w:footnote w:id="2"><w:p>{P.docx_run("a note")}</w:p></w:footnote></w:footnotes>'
    link = f'<w:p><w:hyperlink r:id="h">{P.docx_run("site")}</w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
    data = P.docx_body(
        item("a", 0) + item("b", 1) + item("c", 0) + link + merged,
        {"word/numbering.xml": numbering, "word/footnotes.xml": note},
        [("n", "numbering", "numbering.xml"), ("f", "footnotes", "footnotes.xml"), ('h" TargetMode="External', "hyperlink", "https://example.org/")],
    )
    doc = convert.to_document(data)
    assert convert.to_markdown(data).startswith("3. a\n   - b\n4. c\n\n[site](https://example.org/)[^2]")
    grid = doc["blocks"][-1]["table"]["grid"]
    assert grid[0][1] == {"kind": "covered", "origin_row": 0, "origin_col": 0}
    assert grid[1][0]["cell"]["row_span"] == 2 and grid[2][0] == {"kind": "covered", "origin_row": 1, "origin_col": 0}
    assert [n["kind"] for n in doc["notes"]] == ["footnote"] and "[^2]: a note" in convert.to_markdown(data)


def test_rtf_tables_styles_and_notes():
    data = rb"{\rtf1\ansi{\stylesheet{\s1 heading 1;}}\pard\s1 Head\par\pard {\b bold} \u8364?\'e9{\footnote note}\par\trowd\intbl a\cell b\cell\row\pard end\par}"
    doc = convert.to_document(data)
    assert [b["kind"] for b in doc["blocks"]] == ["heading", "paragraph", "table", "paragraph"]
    assert doc["blocks"][1]["content"][0]["style"]["bold"] and "€é" in convert.to_markdown(data) and doc["notes"][0]["kind"] == "footnote"


def test_zip_writer_round_trip():
    with zipfile.ZipFile(__import__("io").BytesIO(X.RICH)) as z:
        assert "word/document.xml" in z.namelist()


def test_json_round_trips():
    doc = convert.to_document(X.RICH)
    assert model.from_json(model.to_json(doc)) == doc
    pages = convert.to_pages(X.LETTER)
    assert model.pages_from_json(model.pages_to_json(pages)) == pages
    for bad in ("", "[]", "{}", '{"blocks": 1}'):
        assert code(model.from_json, bad).message.startswith("document json: ")
    assert code(model.pages_from_json, "{}").message.startswith("pages json: ")
    assert convert.plain_text([model.link([model.text("a")], "external", "x:y"), model.text("b")]) == "ab"


def test_model_invariants():
    for data in (X.RICH, P.xlsx({"S": [["a"], ["b", "c"]]}), P.ods({"S": [["a", "b"]]})):
        for b in convert.to_document(data)["blocks"]:
            grid = b.get("table", {}).get("grid", [])
            assert not grid or (b["table"]["header_rows"] <= len(grid) and len({len(r) for r in grid}) == 1)
            for r, row in enumerate(grid):
                for c, slot in enumerate(row):
                    if slot["kind"] == "covered":
                        cell = grid[slot["origin_row"]][slot["origin_col"]]["cell"]
                        assert slot["origin_row"] + cell["row_span"] > r and slot["origin_col"] + cell["col_span"] > c


def test_white_space_of_any_length_before_a_signature(spark):
    from leafspark.functions import detect

    heads = [b" " * n + b"{\\rtf1 x}" for n in (0, 3, 59, 60, 64, 80, 5000)] + [b" " * 90, b"\n" * 70 + b"no", b""]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], "k int, content binary").select("k", detect(F.col("content")).alias("f")).collect()
    assert {r["k"]: r["f"] for r in rows} == {k: format_from_bytes(h) for k, h in enumerate(heads)}


def test_what_cannot_be_read_whole_is_an_error():
    bomb = P.odf("odt", '<text:p>a<text:s text:c="2000000"/>b</text:p>')
    e = code(convert.to_markdown, bomb)
    assert (e.code, e.limit) == ("resourceLimit", "max_blanks")
    assert "a" + " " * 1500 + "b" in convert.plain_text(convert.to_document(P.odf("odt", '<text:p>a<text:s text:c="1500"/>b</text:p>'))["blocks"][0]["content"])


def test_failed_documents_have_a_row(spark):
    from leafspark import operators

    df = spark.createDataFrame([(1, P.docx(["a"])), (2, P.docx_body("<w:p>").replace(b"document.xml", b"documens.xml"))], "doc_id long, content binary")
    rows = operators.node_table(df, "blocks", format="docx", errors=True).select("doc_id", "text", "error.code").collect()
    assert sorted(map(tuple, rows)) == [(1, "a", None), (2, None, rows[[r["doc_id"] for r in rows].index(2)]["code"])] and all(r["code"] for r in rows if r["doc_id"] == 2)
    assert [r["doc_id"] for r in operators.node_table(df, "blocks", format="docx").collect()] == [1]


def test_attributes_with_quotes():
    made = P.docx_body(P.docx_image("i1", 'a "quoted" <name>'), {"word/media/p.png": P.PNG}, [("i1", "image", "media/p.png")])
    (image,) = [i for b in convert.to_document(made)["blocks"] for i in b["content"] if i["kind"] == "image"]
    assert image["alt"] == 'a "quoted" <name>' and len(convert.to_document(P.xlsx({'x"y': [["b"]]}))["blocks"]) == 2
