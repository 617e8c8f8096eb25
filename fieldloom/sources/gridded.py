"""Rasters and point clouds as Spark data sources: uncompressed GeoTIFF files and LAS records, read by ranges of rows or records.

    register(spark)
    spark.read.format("geotiff").load("/mnt/images/dem.tif").where("row between 100 and 199")
    spark.read.format("las").load("/mnt/clouds").where("classification = 2").select("x", "y", "z")

A partition is a range of rows (or records). Filters on row and col cut the ranges and the part of each row that is read
(spark.sql.python.filterPushdown.enabled, which register() sets); no other byte of the pixels is touched. A path is a
file or a folder that executors can open; the files of a folder are one mosaic, each with its own rows and columns from the common origin.

write_geotiff() writes such a folder, a file for each block of rows, through Spark's own writer.

Cases: values equal to the file's no-data value and those that aren't finite are null. Compressed files, unknown sample types and
broken headers raise an error that names the file.
"""

from __future__ import annotations

import glob
import math
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Pixels or records of a partition and of an Arrow batch, about.
PARTITION, BATCH = 1 << 22, 1 << 18

# Sizes of tag types, tags, sample types (format, bits), and point record layouts of the two formats.
TAG_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
TAG_CODES = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, TILE_WIDTH, FORMAT, SCALE, TIE, KEYS, NO_DATA = 256, 257, 258, 259, 273, 277, 278, 279, 284, 322, 339, 33550, 33922, 34735, 42113
SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
RETURNS = {**dict.fromkeys(range(6), (14, 7, 3, 7, 15, 31)), **dict.fromkeys(range(6, 11), (14, 15, 4, 15, 16, 255))}


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    path = path[5:] if path.startswith("file:") else path
    found = sorted(f for f in glob.glob(f"{path}/*") if not os.path.basename(f).startswith(("_", "."))) if os.path.isdir(path) else [path]
    if not found:
        raise ValueError(f"no files in {path}")
    return found


def bounds(filters: Iterable[Filter], limits: dict[str, tuple[float, float]]) -> tuple[dict[str, tuple[float, float]], list[Filter]]:
    """The limits (inclusive) of columns after the filters, and the filters that say nothing of them."""
    limits, rest = dict(limits), []
    for f in filters:
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if name not in limits or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or f.value is None:
            rest.append(f)
            continue
        low, high = limits[name]
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            low = max(low, math.floor(f.value) + 1 if isinstance(f, GreaterThan) else math.ceil(f.value))
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            high = min(high, math.ceil(f.value) - 1 if isinstance(f, LessThan) else math.floor(f.value))
        limits[name] = (low, high)
    return limits, rest


@dataclass
class Tiff:
    """What the header of an uncompressed file says."""

    path: str
    width: int
    height: int
    bands: int
    sample: np.dtype
    strips: tuple[int, ...]
    strip_rows: int
    planar: bool
    scale: tuple[float, float] | None
    origin: tuple[float, float] | None
    no_data: float | None
    epsg: int | None

    @classmethod
    def open(cls, path: str) -> Tiff:
        with open(path, "rb") as f:
            head = f.read(8)
            order = {b"II": "<", b"MM": ">"}.get(head[:2])
            if order is None or struct.unpack(f"{order}H", head[2:4])[0] != 42:
                raise ValueError(f"{path} is no TIFF file that this reads")
            f.seek(struct.unpack(f"{order}I", head[4:8])[0])
            (n,) = struct.unpack(f"{order}H", f.read(2))
            entries, tags = f.read(12 * n), {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHI", entries, 12 * k)
                size = TAG_SIZES.get(kind, 0) * count
                if not size or kind not in TAG_CODES:
                    continue
                if size > 4:
                    f.seek(struct.unpack_from(f"{order}I", entries, 12 * k + 8)[0])
                    raw = f.read(size)
                else:
                    raw = entries[12 * k + 8 : 12 * k + 8 + size]
                tags[tag] = raw if kind == 2 else struct.unpack(f"{order}{count}{TAG_CODES[kind]}", raw)
        one = lambda tag, default: tags.get(tag, (default,))[0]
        kind = (one(FORMAT, 1), one(BITS, 1))
        if one(COMPRESSION, 1) != 1 or kind not in SAMPLES or TILE_WIDTH in tags or len(set(tags.get(BITS, (0,)))) > 1 or not {WIDTH, HEIGHT, STRIPS} <= set(tags):
            raise ValueError(f"{path} is compressed, tiled or of a sample type that this doesn't read")
        keys = tags.get(KEYS, ())
        epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (2048, 3072) and keys[i + 1] == 0), None)
        tie, scale, text = tags.get(TIE), tags.get(SCALE), tags.get(NO_DATA)
        return cls(path, one(WIDTH, 0), one(HEIGHT, 0), one(BANDS, 1), np.dtype(order + SAMPLES[kind]), tags[STRIPS], one(ROWS_PER_STRIP, one(HEIGHT, 0)), one(PLANAR, 1) == 2, scale and scale[:2], tie and scale and (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]), float(text.rstrip(b"\0 ")) if text else None, epsg)

    def rows(self, f, low: int, high: int, left: int, right: int, band: int) -> np.ndarray:
        """Values of a window (inclusive) of one band; of each row only what lies between its columns is read."""
        step = 1 if self.planar else self.bands
        out = np.empty((high - low + 1, right - left + 1), np.float64)
        for r in range(low, high + 1):
            strip, inside = divmod(r, self.strip_rows)
            at = self.strips[strip + (band * -(-self.height // self.strip_rows) if self.planar else 0)]
            f.seek(at + (inside * self.width + left) * step * self.sample.itemsize)
            line = np.frombuffer(f.read((right - left + 1) * step * self.sample.itemsize), self.sample)
            out[r - low] = line[0 if self.planar else band :: step]
        bad = ~np.isfinite(out)
        if self.no_data is not None:
            bad |= out == np.array(self.no_data).astype(self.sample)
        out[bad] = np.nan
        return out


@dataclass
class Rows(InputPartition):
    tiff: Tiff
    first: int
    last: int
    top: int
    left: int

    def __post_init__(self) -> None:
        super().__init__(self.first)


class TiffReader(DataSourceReader):
    def __init__(self, tiffs: list[Tiff]) -> None:
        self.tiffs, self.bands = tiffs, tiffs[0].bands
        if any(t.bands != self.bands for t in tiffs):
            raise ValueError("the files of a mosaic have different numbers of bands")
        placed = [t for t in tiffs if t.origin]
        self.west = min((t.origin[0] for t in placed), default=0.0)
        self.north = max((t.origin[1] for t in placed), default=0.0)
        self.limits: dict[str, tuple[float, float]] = {"row": (-math.inf, math.inf), "col": (-math.inf, math.inf)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        self.limits, rest = bounds(filters, self.limits)
        return rest

    def partitions(self) -> list[Rows]:
        out = []
        for t in self.tiffs:
            top = round((self.north - t.origin[1]) / t.scale[1]) if t.origin else 0
            left = round((t.origin[0] - self.west) / t.scale[0]) if t.origin else 0
            low, high = (max(0, self.limits["row"][0] - top), min(t.height - 1, self.limits["row"][1] - top))
            if self.limits["col"][0] > left + t.width - 1 or self.limits["col"][1] < left:
                continue
            step = max(1, PARTITION // t.width)
            out += [Rows(t, int(r), int(min(r + step - 1, high)), top, left) for r in range(int(low), int(high) + 1, step)] if low <= high else []
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is left of the grid
            return
        t = partition.tiff
        left, right = int(max(0, self.limits["col"][0] - partition.left)), int(min(t.width - 1, self.limits["col"][1] - partition.left))
        wide = right - left + 1
        step = max(1, BATCH // wide)
        with open(t.path, "rb") as f:
            for low in range(partition.first, partition.last + 1, step):
                high = min(low + step - 1, partition.last)
                row, col = np.repeat(np.arange(low, high + 1), wide), np.tile(np.arange(left, right + 1), high - low + 1)
                x = t.origin[0] + (col + 0.5) * t.scale[0] if t.origin else col + 0.5
                y = t.origin[1] - (row + 0.5) * t.scale[1] if t.origin else row + 0.5
                values = [pa.array(t.rows(f, low, high, left, right, b).ravel(), from_pandas=True) for b in range(self.bands)]
                yield pa.RecordBatch.from_arrays([pa.array(row + partition.top, pa.int32()), pa.array(col + partition.left, pa.int32()), pa.array(x), pa.array(y), *values], names=["row", "col", "x", "y", *[f"band_{b + 1}" for b in range(self.bands)]])


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        bands = Tiff.open(files_of(self.options["path"])[0]).bands
        return "row int, col int, x double, y double, " + ", ".join(f"band_{b + 1} double" for b in range(bands))

    def reader(self, schema) -> TiffReader:  # noqa: ANN001
        return TiffReader([Tiff.open(f) for f in files_of(self.options["path"])])


@dataclass
class Records(InputPartition):
    path: str
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__(self.first)


@dataclass
class Las:
    """What the header of a file of point records says."""

    path: str
    start: int
    kind: int
    length: int
    count: int
    scale: tuple[float, ...]
    offset: tuple[float, ...]

    @classmethod
    def open(cls, path: str) -> Las:
        with open(path, "rb") as f:
            h = f.read(375)
        if h[:4] != b"LASF" or len(h) < 227:
            raise ValueError(f"{path} is no LAS file")
        start, kind, length, count = struct.unpack_from("<I", h, 96)[0], h[104], struct.unpack_from("<H", h, 105)[0], struct.unpack_from("<I", h, 107)[0]
        if kind not in RETURNS:
            raise ValueError(f"{path} has compressed records or a layout ({kind}) that this doesn't read")
        if (h[24], h[25]) >= (1, 4) and not count:
            (count,) = struct.unpack_from("<Q", h, 247)
        return cls(path, start, kind, length, count, struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155))


class LasReader(DataSourceReader):
    def __init__(self, clouds: list[Las]) -> None:
        self.clouds = clouds
        self.limits: dict[str, tuple[float, float]] = {"classification": (-math.inf, math.inf), "return_number": (-math.inf, math.inf)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        self.limits, rest = bounds(filters, self.limits)
        return rest

    def partitions(self) -> list[Records]:
        return [Records(c.path, i, min(i + PARTITION, c.count)) for c in self.clouds for i in range(0, c.count, PARTITION)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        c = Las.open(partition.path)
        at, first, shift, second, where, class_bits = RETURNS[c.kind]
        with open(c.path, "rb") as f:
            for low in range(partition.first, partition.last, BATCH):
                n = min(BATCH, partition.last - low)
                f.seek(c.start + low * c.length)
                raw = np.frombuffer(f.read(n * c.length), np.uint8)
                if len(raw) < n * c.length:
                    raise ValueError(f"{c.path} ends before its last record")
                raw = raw.reshape(n, c.length)
                xyz = raw[:, :12].copy().view("<i4") * np.array(c.scale) + np.array(c.offset)
                returns, many, kind = raw[:, at] & first, (raw[:, at] >> shift) & second, raw[:, where] & class_bits
                own = np.ones(n, bool)
                for name, v in (("classification", kind), ("return_number", returns)):
                    own &= (v >= self.limits[name][0]) & (v <= self.limits[name][1])
                yield pa.RecordBatch.from_arrays([*[pa.array(xyz[own, k]) for k in range(3)], *[pa.array(v[own].astype(np.int32)) for v in (returns, many, kind)]], names=["x", "y", "z", "return_number", "returns", "classification"])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "x double, y double, z double, return_number int, returns int, classification int"

    def reader(self, schema) -> LasReader:  # noqa: ANN001
        return LasReader([Las.open(f) for f in files_of(self.options["path"])])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    spark.dataSource.register(LasSource)


def tiff_bytes(bands: list[np.ndarray], west: float, north: float, dx: float, dy: float, no_data: float = -9999.0, epsg: int | None = None, geographic: bool = False) -> bytes:
    """A GeoTIFF of 32-bit floats in one strip, bands side by side in each pixel; missing values become no_data."""
    h, w = bands[0].shape
    pixels = np.where(np.isfinite(v := np.stack(bands, axis=-1)), v, no_data).astype("<f4").tobytes()
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg) if epsg else None
    tags = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (32,) * len(bands)), (COMPRESSION, 3, (1,)), (262, 3, (1,)), (STRIPS, 4, (0,)), (BANDS, 3, (len(bands),)), (ROWS_PER_STRIP, 4, (h,)), (STRIP_BYTES, 4, (len(pixels),)), (PLANAR, 3, (1,)), (FORMAT, 3, (3,) * len(bands)), (SCALE, 12, (dx, dy, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, west, north, 0.0))]
    tags += [(KEYS, 3, keys)] if keys else []
    tags.append((NO_DATA, 2, f"{no_data:g}\0".encode()))
    at = 8 + 2 + 12 * len(tags) + 4
    entries, extra = b"", b""
    for tag, kind, v in tags:
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{TAG_CODES[kind]}", *v)
        if tag == STRIPS:
            hole = len(entries) + 8
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, len(v), at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
    entries = entries[:hole] + struct.pack("<I", at + len(extra)) + entries[hole + 4 :]
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + b"\0\0\0\0" + extra + pixels


def write_geotiff(cells: DataFrame, path: str, bands: list[str], west: float, north: float, dx: float, dy: float, block: int = 256, epsg: int | None = None, geographic: bool = False) -> None:
    """Writes cells (row, col, bands) as a folder of GeoTIFF files, one for each block of rows and columns. Missing cells become no data."""

    def build(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        r, c = (p[k].to_numpy() - key[i] * block for i, k in enumerate(("row", "col")))
        grids = [np.full((r.max() + 1, c.max() + 1), np.nan) for _ in bands]
        for g, b in zip(grids, bands, strict=True):
            g[r, c] = p[b]
        return pd.DataFrame({"value": [tiff_bytes(grids, west + key[1] * block * dx, north - key[0] * block * dy, dx, dy, epsg=epsg, geographic=geographic)]})

    x = cells.select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands])
    files = x.groupBy(F.floor(F.col("row") / block).alias("i"), F.floor(F.col("col") / block).alias("j")).applyInPandas(build, "value binary")
    # Spark's text source writes the bytes of a value as they are, and commits whole files; what it adds after them is no part of the image.
    files.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
