"""Conic and polar projections, and rasters in them."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.functions import projections as J
from pluvia.operators import grid as G
from pluvia.sources import geotiff, storage


def _at(spark, pair):
    return spark.range(1).select(*(c.alias(n) for c, n in zip(pair, ("a", "b"), strict=True))).first()[:]


def test_published_points(spark):
    """Worked examples of the EPSG guidance note: Lambert with two parallels (feet), polar variants A and B."""
    foot = 1200 / 3937
    clarke = {"a": 6378206.4, "f": 1 / 294.97870}
    texas = J.Lambert(-99.0, 27 + 50 / 60, 28 + 23 / 60, 30 + 17 / 60, 2000000 * foot, 0.0, **clarke)
    x, y = _at(spark, texas.forward(F.lit(-96.0), F.lit(28.5)))
    assert x / foot == pytest.approx(2963503.91, abs=0.02) and y / foot == pytest.approx(254759.80, abs=0.02)
    ups = J.PolarStereographic(0.0, 90.0, 0.994, 2000000.0, 2000000.0)
    assert _at(spark, ups.forward(F.lit(44.0), F.lit(73.0))) == pytest.approx((3320416.75, 632668.43), abs=0.02)
    south = J.PolarStereographic(70.0, -71.0, 1.0, 6000000.0, 6000000.0)
    assert _at(spark, south.forward(F.lit(120.0), F.lit(-75.0))) == pytest.approx((7255380.79, 7053389.56), abs=0.02)
    assert _at(spark, south.inverse(F.lit(7255380.79), F.lit(7053389.56))) == pytest.approx((120.0, -75.0), abs=1e-6)


def test_poles_nulls_and_bad_parallels(spark):
    pole = J.PolarStereographic(10.0, 90.0)
    assert _at(spark, pole.forward(F.lit(33.0), F.lit(90.0))) == pytest.approx((0.0, 0.0), abs=1e-9)
    assert _at(spark, pole.inverse(F.lit(0.0), F.lit(0.0)))[1] == 90.0
    cone = J.Lambert(0.0, 40.0, 40.0, 40.0)
    assert _at(spark, cone.forward(F.lit(0.0), F.lit(40.0))) == pytest.approx((0.0, 0.0), abs=1e-6)
    assert _at(spark, cone.forward(F.lit(0.0), F.lit(-90.0))) == (None, None) and _at(spark, cone.forward(F.lit(None).cast("double"), F.lit(1.0)))[0] is None
    south = J.Lambert(20.0, -30.0, -20.0, -40.0)
    x, y = south.forward(F.lit(-175.0), F.lit(-55.0))
    assert _at(spark, south.inverse(x, y)) == pytest.approx((-175.0, -55.0), abs=1e-8)
    for bad in (lambda: J.Lambert(0, 0, 30, -30), lambda: J.Lambert(0, 0, 90, 30), lambda: J.PolarStereographic(0, 0), lambda: J.of(3857), lambda: J.from_mapping({"grid_mapping_name": "mercator"})):
        with pytest.raises(ValueError):
            bad()


def test_grid_mappings():
    a = J.from_mapping({"grid_mapping_name": "lambert_conformal_conic", "standard_parallel": [38.0, 46.0], "longitude_of_central_meridian": 12.0, "latitude_of_projection_origin": 42.0, "earth_radius": 6370000.0})
    assert a == J.Lambert(12.0, 42.0, 38.0, 46.0, a=6370000.0, f=0.0)
    b = J.from_mapping({"grid_mapping_name": "polar_stereographic", "straight_vertical_longitude_from_pole": -45.0, "latitude_of_projection_origin": 90.0, "standard_parallel": 70.0, "semi_major_axis": 6378137.0, "inverse_flattening": 298.257223563})
    assert (b.lon0, b.lat1) == (-45.0, 70.0) and b.f == pytest.approx(J.S.WGS84_F)


def test_cells_find_their_node_in_a_projection(spark):
    cone = J.Lambert(12.0, 42.0, 38.0, 46.0)
    mapping = {"grid_mapping_name": "lambert_conformal_conic", "standard_parallel": [38.0, 46.0], "longitude_of_central_meridian": 12.0, "latitude_of_projection_origin": 42.0}
    nodes = spark.range(400).select((F.col("id") % 20).cast("int").alias("i"), F.floor(F.col("id") / 20).cast("int").alias("j"))
    lon, lat = cone.inverse(F.col("i") * 5000.0 - 40000, 50000.0 - F.col("j") * 5000.0)
    cells = nodes.select((F.col("j") * 20 + F.col("i")).cast("long").alias("cell_id"), (lon + 0.001).alias("x"), (lat - 0.001).alias("y"))
    got = G.reprojected(cells, mapping, -40000.0, 5000.0, 20, 50000.0, -5000.0, 20, nodes.withColumn("v", F.col("j") * 20 + F.col("i")))
    assert got.count() == 400 and got.where("v != cell_id").count() == 0


def _lzw(data: bytes) -> bytes:
    """A plain encoder for the test: a string table that starts again when it is full."""
    codes, table, here = [(256, 9)], {bytes([k]): k for k in range(256)}, b""
    size, width = 258, 9
    for k in range(len(data)):
        one = data[k : k + 1]
        if here + one in table:
            here += one
            continue
        codes.append((table[here], width))
        table[here + one] = size
        size += 1
        width = max(9, size.bit_length())
        if size == 4095:  # entry 4094 is the last one
            codes.append((256, 12))
            table, size, width = {bytes([j]): j for j in range(256)}, 258, 9
        here = one
    if here:
        codes.append((table[here], width))
        size += 1
        width = max(9, size.bit_length())
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def _file(v: np.ndarray, compression: int, predictor: int, tile: int | None, order: str = "<", strip: int = 7) -> bytes:
    """A file of several strips or of tiles."""
    import zlib

    h, w = v.shape
    th, tw = (tile, tile) if tile else (strip, w)
    blocks = []
    for r in range(0, h, th):
        for c in range(0, w, tw):
            b = v[r : r + th, c : c + tw]
            if tile:
                b = np.pad(b, ((0, tile - b.shape[0]), (0, tile - b.shape[1])))
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros((b.shape[0], 1), b.dtype))
            raw = b.astype(b.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = b.astype(b.dtype.newbyteorder(">")).view(np.uint8).reshape(*b.shape, -1).transpose(0, 2, 1).reshape(b.shape[0], -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((b.shape[0], 1), np.uint8)).tobytes()
            blocks.append({1: bytes, 5: _lzw, 8: zlib.compress}[compression](raw))
    counts = [len(b) for b in blocks]
    offsets = list(8 + np.cumsum([0, *counts[:-1]]))
    body = b"".join(blocks)
    places = [("tile_width", 3, [tw]), ("tile_height", 3, [th]), ("tile_offsets", 4, offsets), ("tile_counts", 4, counts)] if tile else [("offsets", 4, offsets), ("strip_rows", 3, [th]), ("counts", 4, counts)]
    tags = [("width", 3, [w]), ("height", 3, [h]), ("bits", 3, [v.dtype.itemsize * 8]), ("compression", 3, [compression]), ("samples", 3, [1]), ("predictor", 3, [predictor]), ("format", 3, [{"u": 1, "i": 2, "f": 3}[v.dtype.kind]]), ("scale", 12, [0.5, 0.25, 0.0]), ("tie", 12, [0.0, 0.0, 0.0, 10.0, 45.0, 0.0]), *places]
    at = 8 + len(body)
    spare, head, tail = at + 2 + 12 * len(tags) + 4, struct.pack(order + "H", len(tags)), b""
    for name, kind, values in sorted(tags, key=lambda t: geotiff.TAGS[t[0]]):
        raw = struct.pack(f"{order}{len(values)}{geotiff.FIELDS[kind][0]}", *values)
        head += struct.pack(order + "HHI", geotiff.TAGS[name], kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", spare + len(tail)))
        tail += raw if len(raw) > 4 else b""
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + head + b"\0\0\0\0" + tail


@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize("order", ["<", ">"])
def test_compressed_and_predicted_rasters(compression, order):
    rng = np.random.default_rng(3)
    whole = np.add.outer(np.arange(61) * 3, rng.integers(0, 900, 83)).astype("i2")
    for tile in (None, 16):
        for v, predictor in ((whole, 1), (whole, 2), (whole.astype("u1"), 2), (whole.astype("i4") * 70001, 2), (whole.astype("f4") / 7, 1), (whole.astype("f4") / 7, 3), (whole / 7.0, 3)):
            back = geotiff.parse(_file(v, compression, predictor, tile, order))
            assert back.values.dtype == v.dtype and np.array_equal(back.values, v), (tile, v.dtype, predictor)


def test_lzw_tables_start_again_and_broken_codes_are_told():
    data = np.random.default_rng(1).integers(0, 7, 60000).astype("u1").tobytes()
    assert geotiff.unpack_lzw(_lzw(data)) == data and geotiff.unpack_lzw(_lzw(b"")) == b"" and geotiff.unpack_lzw(_lzw(b"a" * 5000)) == b"a" * 5000
    noise = np.random.default_rng(2).integers(0, 256, 20000).astype("u1").tobytes()
    assert geotiff.unpack_lzw(_lzw(noise)) == noise
    with pytest.raises(ValueError):
        geotiff.unpack_lzw(b"\x80\x7f\xff\xff\xff")


def test_one_large_raster_is_many_tasks_work(spark, tmp_path):
    v = np.add.outer(np.arange(300) * 5, np.arange(200)).astype("i2")
    (tmp_path / "a b.tif").write_bytes(_file(v, 5, 2, 32))
    d = geotiff.read_rasters(spark, str(tmp_path), cells=4096)
    assert d.count() == v.size and d.where("value != r * 5 + c or x != 10.25 + 0.5 * c or y != 44.875 - 0.25 * r").count() == 0
    assert d.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert d.select("r", "c").distinct().count() == v.size


def test_files_by_uri(tmp_path):
    (tmp_path / "a b.bin").write_bytes(bytes(range(100)))
    for path in (f"{tmp_path}/a b.bin", f"file:{tmp_path}/a%20b.bin", f"file://{tmp_path}/a%20b.bin"):
        with storage.opened(path) as f:
            f.seek(90)
            assert f.read(4) == bytes([90, 91, 92, 93])
    assert storage.uri("s3a://bucket/x.nc") == "s3://bucket/x.nc" and storage.uri("/a/b.nc") is None and storage.uri("hdfs://n:8020/x") == "hdfs://n:8020/x"


def test_arrow_file_systems_serve_ranges(monkeypatch, tmp_path):
    from pyarrow import fs

    (tmp_path / "x.bin").write_bytes(bytes(range(100)))
    asked = []

    class Known:
        @staticmethod
        def from_uri(whole):
            asked.append(whole)
            return fs.LocalFileSystem(), str(tmp_path / "x.bin")

    monkeypatch.setattr(fs, "FileSystem", Known)
    with storage.opened("s3a://bucket/x.bin") as f:
        f.seek(50)
        assert f.read(2) == bytes([50, 51])
    assert asked == ["s3://bucket/x.bin"]


def test_radar_in_a_cone(spark, tmp_path):
    from pluvia import cli
    from pluvia.sources import netcdf

    cone = {"grid_mapping_name": "lambert_conformal_conic", "standard_parallel": [38.0, 46.0], "longitude_of_central_meridian": 10.0, "latitude_of_projection_origin": 45.0}
    v = np.where(np.arange(40) < 20, 10.0, 40.0)[None].repeat(40, 0).astype("f4")  # weak rain in the west
    (tmp_path / "dbz").mkdir()
    (tmp_path / "dbz" / "a.tif").write_bytes(geotiff.build(geotiff.Raster(v, -39000.0, 39000.0, 2000.0, -2000.0)))
    (tmp_path / "dem.tif").write_bytes(geotiff.build(geotiff.Raster(np.full((4, 6), 9.0), 9.75, 45.15, 0.1, -0.1, None, 4326)))
    cli.main(["make-domain", "--dem", f"{tmp_path}/dem.tif", "--out", f"{tmp_path}/grid"])
    cli.main(["radar", "--input-dir", f"{tmp_path}/dbz", "--domain", f"{tmp_path}/grid", "--out", f"{tmp_path}/r.nc", "--start", "2024-01-01T00:00:00Z", "--step-s", "600", "--crs", json.dumps(cone)])
    rain = netcdf.parse((tmp_path / "r.nc").read_bytes()).variables["rain_rate"][1][0]
    weak, strong = ((10 ** (x / 10) / 200) ** (1 / 1.6) for x in (10, 40))
    assert np.allclose(rain[:, :3], weak, rtol=1e-5) and np.allclose(rain[:, 3:], strong, rtol=1e-5)
