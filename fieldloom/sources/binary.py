"""Spreadsheets, shapefiles and photo tags, parsed from Spark's binaryFile rows by table functions: any store that Spark reads will do, and a file is one row.

A file that can't be read gives one row with its error and nothing else, so one broken file doesn't stop a folder.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row int, col int, value string, error string"
SHAPES = "path string, record int, kind string, part int, i int, x double, y double, error string"
RECORDS = "path string, record int, fields map<string, string>, error string"
TAGS = "path string, make string, model string, taken timestamp, orientation int, lat double, lon double, altitude double, error string"

# Names of the formats' parts.
SHEET, RELATION = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
KINDS = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
EXIF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _parsed(spark: SparkSession, path: str, schema: str, parse, pattern: str) -> DataFrame:  # noqa: ANN001
    """What parse(content) yields for each file, with its path; an error row for what can't be parsed."""
    names = [c.split()[0] for c in schema.split(", ")]

    class Parser:
        def eval(self, name: str, content: bytes) -> Iterator[tuple[Any, ...]]:
            try:
                yield from [(name, *r, None) for r in parse(content)]
            except Exception as e:  # whatever is wrong with the file, its row says so
                yield (name, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")

    table = F.udtf(Parser, returnType=schema)
    spark.udtf.register("parsed_file_", table)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    files.select("path", "content").createOrReplaceTempView("binary_files_")
    return spark.sql("SELECT p.* FROM binary_files_ f, LATERAL parsed_file_(f.path, f.content) p")


def sheet_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """sheet, row, col (from 0) and text of the filled cells of a workbook; numbers of a date format become dates."""
    import datetime

    z = zipfile.ZipFile(io.BytesIO(content))
    tree = lambda name: ElementTree.fromstring(z.read(name))
    texts = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    dated: list[bool] = []
    if "xl/styles.xml" in z.namelist():
        styles = tree("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{SHEET}numFmt")}
        is_date = lambda k: k in DATE_FORMATS or any(c in own.get(k, "").lower().split("[")[0] for c in ("yy", "dd", "mmm", "h:"))
        dated = [is_date(int(x.get("numFmtId", 0))) for cells in styles.iter(f"{SHEET}cellXfs") for x in cells]
    book = tree("xl/workbook.xml")
    epoch = datetime.datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{SHEET}workbookPr")) else datetime.datetime(1899, 12, 30)
    targets = {r.get("Id"): r.get("Target", "") for r in tree("xl/_rels/workbook.xml.rels")}
    for sheet in book.iter(f"{SHEET}sheet"):
        target = targets[sheet.get(RELATION)].lstrip("/")
        for n, row in enumerate(tree(target if target.startswith("xl/") else f"xl/{target}").iter(f"{SHEET}row")):
            at = int(row.get("r", n + 1)) - 1
            for k, c in enumerate(row.iter(f"{SHEET}c")):
                col = k
                if c.get("r"):
                    col = 0
                    for letter in c.get("r").rstrip("0123456789"):
                        col = col * 26 + ord(letter) - 64
                    col -= 1
                v, kind = c.find(f"{SHEET}v"), c.get("t", "n")
                text = v.text if v is not None else None
                if kind == "s" and text is not None:
                    text = texts[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                elif kind == "b" and text is not None:
                    text = "TRUE" if text == "1" else "FALSE"
                elif kind == "n" and text is not None and int(c.get("s", 0)) < len(dated) and dated[int(c.get("s", 0))]:
                    when = epoch + datetime.timedelta(seconds=round(float(text) * 86400))
                    text = when.date().isoformat() if when.time() == datetime.time() else when.isoformat(sep=" ")
                if text and kind != "e":
                    yield sheet.get("name", ""), at, col, text


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, col, value and error of the cells of workbooks."""
    return _parsed(spark, path, CELLS, sheet_cells, "*.xlsx")


def as_cells(cells: DataFrame, sheet: str) -> DataFrame:
    """One sheet as a table of text with its first filled row as header, as read_cells gives a delimited file. The header alone comes to the driver."""
    own = cells.where((F.col("sheet") == sheet) & F.col("value").isNotNull())
    top = own.agg(F.min("row")).first()[0]
    if top is None:
        raise ValueError(f"the sheet {sheet} has no cells")
    names: dict[int, str] = {}
    for r in own.where(F.col("row") == top).orderBy("col").collect():
        n = sum(1 for x in names.values() if x == r.value or x.rpartition("_")[0] == r.value)
        names[r.col] = f"{r.value}_{n + 1}" if n else r.value
    x = own.where(F.col("row") > top).groupBy("path", "row").pivot("col", list(names)).agg(F.first("value"))
    return x.orderBy("path", "row").select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def shape_points(content: bytes) -> Iterator[tuple[int, str, int, int, float, float]]:
    """record, kind, part, i, x and y of the points of a shapefile's shapes; those with heights or measures by their plane."""
    if len(content) < 100 or struct.unpack(">i", content[:4])[0] != 9994:
        raise ValueError("no shapefile")
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack_from(">ii", content, at)
        body, at = content[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
        if len(body) < 2 * words:
            raise ValueError("the file ends inside a record")
        code = struct.unpack_from("<i", body)[0] % 10
        if code == 1:
            yield (number, "Point", 0, 0, *struct.unpack_from("<2d", body, 4))
        elif code == 8:
            for i in range(struct.unpack_from("<i", body, 36)[0]):
                yield (number, "MultiPoint", 0, i, *struct.unpack_from("<2d", body, 40 + 16 * i))
        elif code in (3, 5):
            parts, points = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
            for p in range(parts):
                for i in range(starts[p], starts[p + 1]):
                    yield (number, KINDS[code], p, i - starts[p], *struct.unpack_from("<2d", body, 44 + 4 * parts + 16 * i))
        elif code:
            raise ValueError(f"shapes of kind {code}")


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """path, record, kind, part, i, x, y and error of the points of shapefiles."""
    return _parsed(spark, path, SHAPES, shape_points, "*.shp")


def dbf_records(content: bytes) -> Iterator[tuple[int, dict[str, str]]]:
    """record (from 1, as in the shapes) and filled fields of a table of attributes; deleted records are left out."""
    many, start, length = struct.unpack_from("<IHH", content, 4)
    fields, at, offset = [], 32, 1
    while content[at] != 13:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), offset, content[at + 16]))
        offset, at = offset + content[at + 16], at + 32
    for k in range(many):
        r = content[start + k * length : start + (k + 1) * length]
        if len(r) < length:
            raise ValueError("the file ends inside a record")
        if r[:1] != b"*":
            values = {n: r[o : o + size].decode("utf-8", "replace").strip("\0 ") for n, o, size in fields}
            yield k + 1, {n: v for n, v in values.items() if v}


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """path, record, fields and error of the attribute tables beside shapefiles."""
    return _parsed(spark, path, RECORDS, dbf_records, "*.dbf")


def photo_tags(content: bytes) -> Iterator[tuple[Any, ...]]:
    """make, model, taken, orientation, lat, lon and altitude from a JPEG's tags; each null if it isn't there."""
    import datetime

    if content[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, block = 2, b""
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = struct.unpack_from(">H", content, at + 2)[0]
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            block = content[at + 10 : at + 2 + size]
            break
        at += 2 + size
    if not block:
        yield (None,) * 7
        return
    order = {b"II": "<", b"MM": ">"}[block[:2]]

    def tags(start: int) -> dict[int, Any]:
        out = {}
        for k in range(struct.unpack_from(f"{order}H", block, start)[0]):
            tag, kind, count = struct.unpack_from(f"{order}HHI", block, start + 2 + 12 * k)
            place, size = start + 10 + 12 * k, EXIF_SIZES.get(kind, 0) * count
            if size > 4:
                place = struct.unpack_from(f"{order}I", block, place)[0]
            raw = block[place : place + size]
            if not size or len(raw) < size:
                continue
            if kind in (5, 10):
                pairs = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
                out[tag] = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            elif kind in (2, 7):
                out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
            else:
                out[tag] = list(struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 9: 'i'}[kind]}", raw))
        return out

    top = tags(struct.unpack_from(f"{order}I", block, 4)[0])
    own, place = tags(top[0x8769][0]) if 0x8769 in top else {}, tags(top[0x8825][0]) if 0x8825 in top else {}

    def degrees(value: int, side: int, most: float) -> float | None:
        v = place.get(value)
        if not v or len(v) < 3 or None in v:
            return None
        found = (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if place.get(side) in ("S", "W") else 1)
        return found if abs(found) <= most else None

    taken = None
    try:
        taken = datetime.datetime.strptime(own.get(0x9003) or top.get(0x0132) or "", "%Y:%m:%d %H:%M:%S")
    except ValueError:
        pass
    height = (place.get(6) or [None])[0]
    below = (place.get(5) or [0])[0] in (1, "\x01")
    yield (top.get(0x010F), top.get(0x0110), taken, (top.get(0x0112) or [None])[0], degrees(2, 1, 90), degrees(4, 3, 180), -height if height is not None and below else height)


def photos(spark: SparkSession, path: str) -> DataFrame:
    """path, make, model, taken, orientation, lat, lon, altitude and error of photos."""
    return _parsed(spark, path, TAGS, photo_tags, "*.{jpg,jpeg,JPG,JPEG}")
