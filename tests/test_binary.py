"""Round trips of hand-made workbooks, shapefiles and photos; broken files give an error row."""

import datetime
import struct
import zipfile

import pytest

from fieldloom.sources import binary

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="Plots" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>date</t></si><si><t>v</t></si><si><r><t>al</t></r><r><t>der</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        rows = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="AA2" t="s"><v>1</v></c></row>'
        rows += '<row r="3"><c r="A3" s="1"><v>43831</v></c><c r="B3"><v>1.5</v></c><c r="AA3" t="inlineStr"><is><t>x</t></is></c></row>'
        rows += '<row r="4"><c r="A4" s="2"><v>43832.5</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="AA4" t="s"><v>2</v></c></row><row r="5"><c r="B5" t="b"><v>1</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    book(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    x = binary.workbook(spark, f"file://{tmp_path}").cache()
    assert [(r.path.endswith("b.xlsx"), r.value) for r in x.where("error is not null").collect()] == [(True, None)]
    got = {(r.row, r.col): r.value for r in x.where("error is null").collect()}
    assert got == {(1, 0): "date", (1, 1): "v", (1, 26): "v", (2, 0): "2020-01-01", (2, 1): "1.5", (2, 26): "x", (3, 0): "2020-01-02 12:00:00", (3, 26): "alder", (4, 1): "TRUE"}
    assert [tuple(r) for r in binary.as_cells(x, "Plots").collect()] == [("2020-01-01", "1.5", "x"), ("2020-01-02 12:00:00", None, "alder"), (None, "TRUE", None)]
    assert binary.as_cells(x, "Plots").columns == ["date", "v", "v_2"]
    with pytest.raises(ValueError, match="no cells"):
        binary.as_cells(x, "Other")


def shp(*records):
    body = b"".join(struct.pack(">ii", i, len(r) // 2) + r for i, r in enumerate(records, 1))
    return struct.pack(">i20xi", 9994, (100 + len(body)) // 2) + bytes(100 - 28) + body


def test_shapefiles(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    hole = [(0.5, 1.0), (0.6, 1.1), (0.5, 1.1), (0.5, 1.0)]
    polygon = struct.pack("<i4d3i", 5, 0, 0, 2, 2, 2, 8, 0)[:44] + struct.pack("<2i", 0, 4) + b"".join(struct.pack("<2d", *p) for p in ring + hole)
    whole = shp(struct.pack("<i2d", 1, 94.1, 25.5), polygon, struct.pack("<i", 0))
    (tmp_path / "a.shp").write_bytes(whole)
    (tmp_path / "b.shp").write_bytes(whole[:-20])
    x = binary.shapefile(spark, f"file://{tmp_path}").collect()
    got = [tuple(r)[1:7] for r in x if r.path.endswith("a.shp")]
    assert got == [(1, "Point", 0, 0, 94.1, 25.5)] + [(2, "Polygon", p, i, *v) for p, part in enumerate((ring, hole)) for i, v in enumerate(part)]
    assert [r.error for r in x if r.path.endswith("b.shp")] == ["ValueError: the file ends inside a record"]
    fields = b"".join(struct.pack("<11sc4xBB14x", n, b"C", size, 0) for n, size in ((b"NAME", 6), (b"AREA", 4)))
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 120, 1, 1, 3, 32 + len(fields) + 1, 11) + fields + b"\r" + b" oak   12.5" + b"*gone     1" + " fèvre    ".encode())
    got = {r.record: r.fields for r in binary.attributes(spark, f"file://{tmp_path}").collect()}
    assert got == {1: {"NAME": "oak", "AREA": "12.5"}, 3: {"NAME": "fèvre"}}


def test_photos(spark, tmp_path):
    def ifd(at, entries):
        head, extra = struct.pack("<H", len(entries)), b""
        data = at + 2 + 12 * len(entries) + 4
        for tag, kind, count, raw in entries:
            head += struct.pack("<HHI", tag, kind, count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", data + len(extra)))
            extra += raw if len(raw) > 4 else b""
        return head + bytes(4) + extra

    ratio = lambda *v: b"".join(struct.pack("<II", int(x * 100), 100) for x in v)
    gps = [(1, 2, 2, b"S\0"), (2, 5, 3, ratio(25, 30, 36)), (3, 2, 2, b"E\0"), (4, 5, 3, ratio(94, 6, 0)), (5, 1, 1, b"\1"), (6, 5, 1, ratio(12.5))]
    own = [(0x9003, 2, 20, b"2024:03:15 10:20:30\0")]
    top = lambda a, b: [(0x010F, 2, 6, b"Maker\0"), (0x0112, 3, 1, struct.pack("<H", 6)), (0x8769, 4, 1, struct.pack("<I", a)), (0x8825, 4, 1, struct.pack("<I", b))]
    a = 8 + len(ifd(8, top(0, 0)))
    b = a + len(ifd(a, own))
    block = b"II*\0" + struct.pack("<I", 8) + ifd(8, top(a, b)) + ifd(a, own) + ifd(b, gps)
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda")
    (tmp_path / "plain.jpg").write_bytes(b"\xff\xd8\xff\xda")
    (tmp_path / "bad.jpg").write_bytes(b"GIF89a")
    got = {r.path.rsplit("/", 1)[1]: r for r in binary.photos(spark, f"file://{tmp_path}").collect()}
    r = got["a.jpg"]
    assert (r.make, r.model, r.taken, r.orientation, r.altitude) == ("Maker", None, datetime.datetime(2024, 3, 15, 10, 20, 30), 6, -12.5)
    assert (r.lat, r.lon) == (pytest.approx(-25.51), pytest.approx(94.1))
    assert got["plain.jpg"].make is None and got["plain.jpg"].error is None and got["bad.jpg"].error == "ValueError: no JPEG file"
