"""Binary office formats, from files that these tests write by the published structures."""

import struct

import pytest

from leafspark import ConvertError, convert, format_from_bytes
from leafspark.plans import payloads as P
from leafspark.readers.cfb import CompoundFile
from leafspark.readers.excel import format_kind, shown

END, FREE, FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def compound(streams, small=()):
    """A compound file; streams named in ``small`` go to the mini stream, the others are padded past the cutoff."""
    mini, mini_fat, places = b"", [], {}
    for name in small:
        data = streams[name]
        n = -(-len(data) // 64)
        places[name] = (len(mini_fat), len(data))
        mini_fat += [len(mini_fat) + k + 1 for k in range(n - 1)] + [END]
        mini += data.ljust(64 * n, b"\0")
    sectors, fat = [], [FAT]

    def put(data):
        n = -(-len(data) // 512)
        first = len(fat)
        fat.extend([first + k + 1 for k in range(n - 1)] + [END])
        sectors.extend(data[512 * k : 512 * k + 512].ljust(512, b"\0") for k in range(n))
        return first

    for name, data in streams.items():
        if name not in small:
            data = data.ljust(4096, b"\0")
            places[name] = (put(data), len(data))
    root = (put(mini), len(mini)) if mini else (END, 0)
    mini_at = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(512, b"\xff")) if mini_fat else END

    def entry(name, kind, start, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", FREE, FREE, FREE) + bytes(36) + struct.pack("<IQ", start, size)

    listing = entry("Root Entry", 5, *root) + b"".join(entry(n, 2, *places[n]) for n in streams)
    directory = put(listing.ljust(-(-len(listing) // 512) * 512, b"\0"))
    assert len(fat) <= 128
    table = struct.pack("<128I", *fat, *[FREE] * (128 - len(fat)))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<9I", 0, 1, directory, 0, 4096, mini_at, int(bool(mini_fat)), END, 0) + struct.pack("<109I", 0, *[FREE] * 108)
    return head + table + b"".join(sectors)


def test_compound_files():
    data = compound({"Big": b"x" * 5000, "Small": b"tiny" * 40, "Other": b"y"}, small=("Small", "Other"))
    file = CompoundFile(data)
    assert file.names() == ["Big", "Small", "Other"]
    assert file.stream("big") == b"x" * 5000 and file.stream("Small") == b"tiny" * 40 and file.stream("Other") == b"y" and file.stream("none") is None
    with pytest.raises(ConvertError):
        CompoundFile(data[:700])


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def biff_string(text, wide=True):
    return struct.pack("<HB", len(text), int(wide)) + text.encode("utf-16-le" if wide else "latin-1")


def xls(extra=b""):
    texts = ["Quarter", "Wïdgets", "Q1"]
    sst = struct.pack("<II", 3, 3) + b"".join(map(biff_string, texts[:2]))
    tail = biff_string(texts[2], wide=False)
    split = record(0xFC, sst + tail[:3]) + record(0x3C, b"\0" + tail[3:])
    cells = b"".join(record(0xFD, struct.pack("<HHHI", r, c, 0, k)) for r, c, k in ((0, 0, 0), (0, 1, 1), (1, 0, 2)))
    cells += record(0x203, struct.pack("<HHHd", 1, 1, 0, 2.5)) + record(0x27E, struct.pack("<HHHI", 2, 0, 1, (45000 << 2) | 2))
    cells += record(0xBD, struct.pack("<HHHIHIH", 3, 0, 0, (7 << 2) | 2, 0, (150 << 2) | 3, 1))
    cells += record(0x205, struct.pack("<HHHBB", 4, 0, 0, 1, 0)) + record(0x06, struct.pack("<HHH", 4, 1, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(6))
    cells += record(0x207, biff_string("made")) + record(0xE5, struct.pack("<H4H", 1, 5, 5, 0, 1)) + record(0x204, struct.pack("<HHH", 5, 0, 0) + biff_string("wide"))
    xf = record(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + record(0xE0, struct.pack("<HH", 0, 14) + bytes(16))
    bof = record(0x809, bytes(16))
    name = struct.pack("<BB", 5, 0) + b"Sales"
    size = len(bof + extra + xf + split) + 4 + 6 + len(name) + 4
    book = bof + extra + xf + split + record(0x85, struct.pack("<IBB", size, 0, 0) + name) + record(0x0A, b"")
    return compound({"Workbook": book + bof + cells + record(0x0A, b"")})


def test_xls():
    data = xls()
    assert format_from_bytes(data) == "xlsx"
    assert convert.to_markdown(data) == "\n".join(["## Sales", "", "| Quarter | Wïdgets |", "| --- | --- |", "| Q1 | 2.5 |", "| 2023-03-15 |  |", "| 7 | 1.5 |", "| TRUE | made |", "| wide |  |"])
    grid = convert.to_document(data)["blocks"][1]["table"]["grid"]
    assert grid[5][0]["cell"]["col_span"] == 2 and grid[5][1]["kind"] == "covered"
    with pytest.raises(ConvertError) as e:
        convert.to_markdown(xls(record(0x2F, b"\0\0")))
    assert e.value.code == "encrypted"


def bin_record(kind, body):
    head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    n, size = len(body), b""
    while True:
        size += bytes([n & 0x7F | (0x80 if n > 127 else 0)])
        n >>= 7
        if not n:
            return head + size + body


def wide(text):
    return struct.pack("<I", len(text)) + text.encode("utf-16-le")


def test_xlsb():
    cell = lambda kind, col, body: bin_record(kind, struct.pack("<II", col, 0) + body)
    sheet = bin_record(0, struct.pack("<I", 0) + bytes(13)) + cell(7, 0, struct.pack("<I", 0)) + cell(6, 1, wide("text"))
    sheet += bin_record(0, struct.pack("<I", 1) + bytes(13)) + cell(2, 0, struct.pack("<I", (12 << 2) | 2)) + cell(5, 1, struct.pack("<d", 0.25)) + cell(4, 2, b"\1")
    relations = P._relations(("s", "worksheet", "worksheets/sheet1.bin"), ("t", "sharedStrings", "sharedStrings.bin"))
    data = P.pack({
        "[Content_Types].xml": '<Types><Override PartName="/xl/workbook.bin" ContentType="application/vnd.ms-excel.sheet.binary.macroEnabled.main"/></Types>',
        "_rels/.rels": P._relations(("r", "officeDocument", "xl/workbook.bin")), "xl/_rels/workbook.bin.rels": relations,
        "xl/workbook.bin": bin_record(156, struct.pack("<II", 0, 1) + wide("s") + wide("Data")),
        "xl/sharedStrings.bin": bin_record(159, struct.pack("<II", 1, 1)) + bin_record(19, b"\0" + wide("shared")),
        "xl/worksheets/sheet1.bin": sheet,
    })
    assert format_from_bytes(data) == "xlsx"
    assert convert.to_markdown(data) == "## Data\n\n| shared | text |  |\n| --- | --- | --- |\n| 12 | 0.25 | TRUE |"


def doc(encrypted=False):
    """A heading, a paragraph with a field, and a table of one row."""
    parts = [("Title", 1, False, "\r"), ("See \x13 HYPERLINK x \x14the site\x15.", 0, False, "\r"), ("a", 0, True, "\x07"), ("b", 0, True, "\x07"), ("", 0, True, "\x07"), ("end", 0, False, "\r")]
    text, starts, row = "", [], 0x800
    for body, style, table, mark in parts:
        starts.append((row + len(text), style, table, table and not body))
        text += body + mark
    main = bytearray(0x800) + text.encode("cp1252")
    main = main.ljust(0x1000, b"\0")
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 10, 0x200 | (0x100 if encrypted else 0))
    struct.pack_into("<i", main, 0x4C, len(text))
    page, n, at = bytearray(512), len(parts), 508
    for k, (start, style, table, ends) in enumerate(starts):
        struct.pack_into("<I", page, 4 * k, start)
        props = struct.pack("<H", style) + (struct.pack("<HB", 0x2416, 1) if table else b"") + (struct.pack("<HB", 0x2417, 1) if ends else b"")
        body = bytes([(len(props) + 1) // 2]) + props if len(props) % 2 else bytes([0, len(props) // 2]) + props
        at = (at - len(body)) & ~1
        page[at : at + len(body)] = body
        page[4 * (n + 1) + 13 * k] = at // 2
    struct.pack_into("<I", page, 4 * n, row + len(text))
    page[511] = n
    main += page
    clx = b"\2" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, (row * 2) | 0x40000000, 0)
    papx = struct.pack("<II", row, row + len(text)) + struct.pack("<I", 0x1000 // 512)
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    struct.pack_into("<II", main, 0x102, len(clx), len(papx))
    return compound({"WordDocument": bytes(main), "1Table": clx + papx})


def test_doc():
    assert format_from_bytes(doc()) == "doc"
    assert convert.to_markdown(doc()) == "# Title\n\nSee the site.\n\n| a | b |\n| --- | --- |\n\nend"
    with pytest.raises(ConvertError) as e:
        convert.to_markdown(doc(encrypted=True))
    assert e.value.code == "encrypted"


def atom(kind, body, instance=0, container=False):
    return struct.pack("<HHI", instance << 4 | (15 if container else 0), kind, len(body)) + body


def ppt(token=0xE391C05F):
    text = lambda kind, t: atom(0xF9F, struct.pack("<I", kind)) + atom(0xFA0, t.encode("utf-16-le"))
    slides = atom(0x3F3, bytes(20)) + text(0, "Plän") + text(1, "one\rtwo") + atom(0x3F3, bytes(20)) + atom(0xF9F, struct.pack("<I", 4)) + atom(0xFA8, b"free text")
    user = struct.pack("<HHIII", 0, 0xFF6, 20, 20, token) + bytes(12)
    return compound({"PowerPoint Document": atom(0x3E8, atom(0xFF0, slides, container=True), container=True), "Current User": user}, small=("Current User",))


def test_ppt():
    assert format_from_bytes(ppt()) == "ppt"
    assert convert.to_markdown(ppt()) == "## Plän\n\n- one\n- two\n\nfree text"
    with pytest.raises(ConvertError) as e:
        convert.to_markdown(ppt(0xF3D1C4DF))
    assert e.value.code == "encrypted"


def test_number_formats():
    kinds = {"0.00%": "percent", "yyyy-mm-dd": "date", "hh:mm:ss": "time", "m/d/yy h:mm": "datetime", "#,##0.00": "general", '"days" 0': "general", "[Red]0": "general"}
    assert {k: format_kind(164, k)[0] for k in kinds} == kinds
    assert shown(0.155, format_kind(10, None)) == "15.50%" and shown(0.5, ("time", 0)) == "12:00:00" and shown(1e21, ("general", 0)) == "1e+21"
    assert shown(1, ("date", 0)) == "1900-01-01" and shown(60.5, ("datetime", 0)) == "1900-02-28 12:00:00" and shown(0, ("date", 0), True) == "1904-01-01"


def test_encrypted_package():
    data = compound({"EncryptedPackage": b"x", "EncryptionInfo": b"y"})
    for name in ("docx", "xlsx", "pptx"):
        with pytest.raises(ConvertError) as e:
            convert.to_markdown(data, name)
        assert e.value.code == "encrypted"
