"""Round trips of hand-made rasters and point records, and which bytes are read."""

import builtins
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from fieldloom.sources import gridded


@pytest.fixture
def image(tmp_path):
    z = np.arange(40 * 30, dtype=float).reshape(40, 30)
    z[3, 4] = np.nan
    path = tmp_path / "a.tif"
    path.write_bytes(gridded.tiff_bytes([z, -z], 94.0, 26.0, 0.1, 0.2, epsg=4326, geographic=True))
    return str(path), z


def test_header(image):
    t = gridded.Tiff.open(image[0])
    assert (t.width, t.height, t.bands, t.epsg, t.no_data, t.scale, t.origin, t.sample.str) == (30, 40, 2, 4326, -9999.0, (0.1, 0.2), (94.0, 26.0), "<f4")


def test_whole_image_and_windows(spark, image):
    gridded.register(spark)
    path, z = image
    x = spark.read.format("geotiff").load(path)
    assert x.columns == ["row", "col", "x", "y", "band_1", "band_2"] and x.count() == 1200
    p = x.toPandas()
    assert np.array_equal(z[p.row, p.col], p.band_1, equal_nan=True) and np.allclose(p.x, 94.05 + p.col * 0.1) and np.allclose(p.y, 25.9 - p.row * 0.2)
    part = x.where("row between 5 and 7 and col > 27 and band_2 < -160").select("row", "col", "band_2").toPandas()
    assert sorted(zip(part.row, part.col, part.band_2, strict=True)) == [(r, c, -z[r, c]) for r in (5, 6, 7) for c in (28, 29) if -z[r, c] < -160]
    assert x.where("row = 3 and col = 4").first()["band_1"] is None and x.where("row > 39").count() == 0


def test_a_strip_reads_its_bytes_alone(image, monkeypatch):
    path, z = image
    reader, read = gridded.TiffReader([gridded.Tiff.open(path)]), []
    rest = list(reader.pushFilters([GreaterThan(("row",), 9), LessThanOrEqual(("row",), 11), EqualTo(("col",), 5), GreaterThan(("x",), 1.0)]))
    assert rest == [GreaterThan(("x",), 1.0)]
    (part,) = reader.partitions()

    class Spied:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, n):
            self.f.seek(n)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    monkeypatch.setattr(gridded, "open", lambda *a: Spied(builtins.open(*a)), raising=False)
    (batch,) = reader.read(part)
    assert batch.column(4).to_pylist() == [z[r, 5] for r in (10, 11)] and sum(read) == 2 * 2 * 2 * 4  # rows, bands, samples of a pixel, bytes


def test_many_partitions_and_other_sample_types(spark, tmp_path, monkeypatch):
    path, z = tmp_path / "b.tif", np.arange(12, dtype=">u2").reshape(4, 3)
    tags = [(256, 3, 3), (257, 3, 4), (258, 3, 16), (259, 3, 1), (273, 4, 0), (277, 3, 1), (278, 3, 2), (279, 4, 12)]
    at = 8 + 2 + 12 * len(tags) + 4
    entries = b"".join(struct.pack(">HHI", t, k, 2 if t == 273 else 1) + (struct.pack(">I", at) if t == 273 else struct.pack(">H2x" if k == 3 else ">I", v)) for t, k, v in tags)
    path.write_bytes(b"MM\0*" + struct.pack(">IH", 8, len(tags)) + entries + b"\0\0\0\0" + struct.pack(">II", at + 8 + 12, at + 8) + z[2:].tobytes() + z[:2].tobytes())
    monkeypatch.setattr(gridded, "PARTITION", 3)
    reader = gridded.TiffReader([gridded.Tiff.open(str(path))])
    parts = reader.partitions()
    assert len(parts) == 4 and [v for p in parts for b in reader.read(p) for v in b.column(4).to_pylist()] == list(range(12))


def test_broken_files_are_named(tmp_path):
    for i, raw in enumerate((b"", b"II*\0\x08\0\0\0\0\0\0\0\0\0", b"LASF" + bytes(10), b"plain text that is long enough")):
        path = tmp_path / f"x{i}"
        path.write_bytes(raw)
        with pytest.raises((ValueError, struct.error)):
            gridded.Tiff.open(str(path))
        with pytest.raises(ValueError, match=f"x{i}"):
            gridded.Las.open(str(path))
    with pytest.raises(ValueError, match="no files"):
        (tmp_path / "empty").mkdir()
        gridded.files_of(str(tmp_path / "empty"))


def test_mosaic_of_written_blocks(spark, tmp_path):
    gridded.register(spark)
    cells = spark.range(50 * 33).selectExpr("CAST(id DIV 33 AS INT) AS row", "CAST(id % 33 AS INT) AS col").withColumn("v", F.when(F.col("row") != 20, F.col("row") * 100.0 + F.col("col"))).where("row <> 48 or col <> 2")
    gridded.write_geotiff(cells, f"file://{tmp_path}/out", ["v"], 500_000.0, 2_000_000.0, 10.0, 10.0, block=16, epsg=32646)
    x = spark.read.format("geotiff").load(f"file://{tmp_path}/out")
    assert len(gridded.files_of(f"{tmp_path}/out")) == 12 and x.count() == 1650
    both = x.select("row", "col", "band_1").join(cells.withColumnsRenamed({"row": "r", "col": "c"}), (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")), "left")
    assert both.where("not (band_1 <=> v)").count() == 0
    assert x.where("row between 15 and 16 and col = 32").select("x", "y", "band_1").collect() == [(500_325.0, 1_999_845.0, 1532.0), (500_325.0, 1_999_835.0, 1632.0)]


@pytest.mark.parametrize(("version", "kind", "length"), [(2, 1, 28), (4, 6, 30)])
def test_point_records(spark, tmp_path, version, kind, length):
    gridded.register(spark)
    n, rng = 500, np.random.default_rng(1)
    xyz, returns, classes = rng.integers(-1000, 1000, (n, 3)), rng.integers(1, 4, n), rng.integers(0, 10, n)
    head = bytearray(375 if version == 4 else 227)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, version, kind
    struct.pack_into("<I", head, 96, len(head))
    struct.pack_into("<HI", head, 105, length, 0 if version == 4 else n)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.5, 600_000.0, 2_800_000.0, 10.0)
    if version == 4:
        struct.pack_into("<Q", head, 247, n)
    body = np.zeros((n, length), np.uint8)
    body[:, :12] = xyz.astype("<i4").view(np.uint8)
    body[:, 14] = returns | (3 << (3 if kind < 6 else 4))
    body[:, 15 if kind < 6 else 16] = classes | (32 if kind < 6 else 0)  # a flag beside the class
    path = tmp_path / "c.las"
    path.write_bytes(bytes(head) + body.tobytes())
    x = spark.read.format("las").load(str(path))
    p = x.toPandas()
    assert np.allclose(p[["x", "y", "z"]], xyz * [0.01, 0.01, 0.5] + [600_000, 2_800_000, 10]) and p.returns.eq(3).all() and (p.return_number == returns).all()
    assert x.where("classification = 2 and return_number < 3").count() == int(((classes == 2) & (returns < 3)).sum())
    path.write_bytes(bytes(head) + body.tobytes()[:-1])
    with pytest.raises(Exception, match="ends before its last record"):
        spark.read.format("las").load(str(path)).count()
