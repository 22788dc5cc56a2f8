"""Files that other programs read: round trips and formats."""

import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.functions import geometry
from terraframe.sources import catalog, exports, rasters, scenes, tiff


@pytest.mark.parametrize(("dtype", "crs"), [("uint8", "EPSG:3857"), ("int16", "EPSG:4326"), ("float32", None)])
def test_geotiff_round_trip(spark, tmp_path, dtype, crs):
    path, scene = str(tmp_path / "s.tif"), scenes.synthetic(spark, 31, 300, 3)
    tiff.write_scene(scene, path, 31, 300, dtype, crs, (2, 0, 100, 0, -2, 200), nodata=0)
    info = tiff.describe(path)
    assert (info["width"], info["height"], info["count"], info["dtype"], info["crs"], info["transform"], info["nodata"]) == (31, 300, 3, dtype, crs, (2, 0, 100, 0, -2, 200), 0)
    assert sorted(map(tuple, tiff.read_scene(spark, path).collect())) == sorted(map(tuple, scene.collect()))
    with pytest.raises(ValueError):
        tiff.describe(__file__)


def _lzw(raw):
    """LZW as TIFF has it, with a table that is cleared before it is full."""
    codes, table, word = [256], {bytes([i]): i for i in range(256)}, b""
    n, widths = 258, [9]

    def put(code):
        codes.append(code)
        widths.append(9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12)

    for i in raw:
        longer = word + bytes([i])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = n
        n += 1
        word = bytes([i])
        if n > 4000:
            put(table[word])
            word = b""
            n += 1
            put(256)
            table, n = {bytes([k]): k for k in range(256)}, 258
    if word:
        put(table[word])
        n += 1
    put(257)
    bits = "".join(format(c, f"0{w}b") for c, w in zip(codes, widths, strict=True))
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


PACK = {1: bytes, 5: _lzw, 8: zlib.compress, 32773: lambda raw: b"".join(bytes([len(raw[i : i + 100]) - 1]) + raw[i : i + 100] for i in range(0, len(raw), 100))}


@pytest.mark.parametrize(("compression", "predictor", "tiled", "order", "planar"), [(8, 2, True, "<", False), (5, 2, False, ">", False), (32773, 1, True, ">", True), (1, 1, True, "<", False), (8, 1, False, "<", True)])
def test_other_forms_of_tiff(spark, tmp_path, compression, predictor, tiled, order, planar):
    """Files made here, tiled or in strips, packed and differenced, read back pixel by pixel."""
    width, height, bands, wide, high = 37, 29, 2, (16 if tiled else 37), 16
    image = np.random.default_rng(4).integers(0, 60, (height, width, bands)).astype(order + "u2")
    full = np.zeros((-(-height // high) * high, -(-width // wide) * wide, bands), order + "u2")
    full[:height, :width] = image
    blocks = []
    for group in ([image[:, :, [b]] for b in range(bands)] if planar else [image]):
        source = np.zeros((*full.shape[:2], group.shape[2]), order + "u2")
        source[:height, :width] = group
        for top in range(0, height, high):
            for left in range(0, width, wide):
                part = source[top : top + high if tiled else min(top + high, height), left : left + wide]
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1).astype(part.dtype)
                blocks.append(PACK[compression](np.ascontiguousarray(part).tobytes()))
    at = np.cumsum([8, *map(len, blocks)])
    fields = {256: [width], 257: [height], 258: [16] * bands, 259: [compression], 277: [bands], 284: [2 if planar else 1], 317: [predictor], 339: [1] * bands}
    fields |= {322: [wide], 323: [high], 324: at[:-1].tolist(), 325: [len(b) for b in blocks]} if tiled else {273: at[:-1].tolist(), 278: [high], 279: [len(b) for b in blocks]}
    more, entries, start = b"", b"", int(at[-1]) + 2 + 12 * len(fields) + 4
    for tag in sorted(fields):
        raw = struct.pack(f"{order}{len(fields[tag])}I", *fields[tag])
        entries += struct.pack(order + "HHI", tag, 4, len(fields[tag])) + (raw if len(raw) == 4 else struct.pack(order + "I", start + len(more)))
        more += raw if len(raw) > 4 else b""
    path = tmp_path / "t.dat"
    path.write_bytes((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", int(at[-1])) + b"".join(blocks) + struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0" + more)
    found = {(r.y, r.x): (r.b1, r.b2) for r in rasters.read_scene(spark, str(path)).collect()}
    assert found == {(y, x): tuple(int(v) for v in image[y, x]) for y in range(height) for x in range(width)}
    assert rasters.describe(str(path))["driver"] == "GTiff"


def test_scattered_pixels_are_written_to_their_places(spark, tmp_path):
    path, scene = str(tmp_path / "s.tif"), scenes.synthetic(spark, 40, 30, 2).filter("(x + y) % 3 = 0").repartition(5)
    tiff.write_scene(scene, path, 40, 30, "int16", nodata=-7)
    found = {(r.y, r.x): (r.b1, r.b2) for r in tiff.read_scene(spark, path).collect()}
    kept = {(r.y, r.x): (r.b1, r.b2) for r in scene.collect()}
    assert found == {(y, x): kept.get((y, x), (-7, -7)) for y in range(30) for x in range(40)}
    with pytest.raises(ValueError):
        rasters.describe(__file__)


def test_geopackage_and_png(spark, tmp_path):
    rows = spark.createDataFrame([("ship", [0.0, 0.0, 10.0, 10.0])], "label string, bbox array<double>").withColumn("ring", geometry.box_polygon(F.col("bbox")))
    exports.write_gpkg(rows, str(tmp_path / "f.gpkg"))
    con = sqlite3.connect(tmp_path / "f.gpkg")
    label, box, geom = con.execute("select label, bbox, geom from features").fetchone()
    assert label == "ship" and box == "[0.0, 0.0, 10.0, 10.0]" and struct.unpack("<dd", geom[-16:]) == (0, 0) and con.execute("pragma application_id").fetchone()[0] == exports.GPKG_ID
    pixels = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 2, 255, 0, 9)], "y int, x int, r int, g int, b int")
    exports.write_png(pixels, str(tmp_path / "p.png"), 3, 2)
    raw = (tmp_path / "p.png").read_bytes()
    at = raw.index(b"IDAT")
    image = zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]])
    assert image == bytes([0, 1, 2, 3, *[0] * 6, 0, *[0] * 6, 255, 0, 9])


def test_reports_and_file_checks(tmp_path):
    manifest = {"task": "change_detection", "job_id": "j", "status": "success", "inputs": {"a_raster": {"width": 2, "height": 3, "count": 1, "crs": None}}, "outputs": {"mask": str(tmp_path / "none")}, "stats": {"count": 0}}
    report = exports.processing_report(manifest)
    assert "2 x 3, 1 band(s), CRS=None" in report and "## Quality Flags" in report
    assert [f["code"] for f in exports.file_checks(manifest)] == ["missing_output", "empty_result", "missing_crs"]
    with pytest.raises(ValueError):
        exports.file_checks()
    summary = dict.fromkeys(("min", "max", "mean", "std", "p5", "p50", "p95"), 0.5) | {"threshold_areas": {">0.3": {"area_m2": 4.0, "area_km2": 4e-6}}}
    assert "- 阈值 >0.3: 4.00 m2 (0.000004 km2)" in exports.index_report("x.tif", 4.0, {"red": 3}, {"ndvi": summary}, [], {})


def test_class_maps(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("id: x\nclasses:\n  0: {name: background, color: '#000'}\n  7: {name: roof}\n")
    assert [(r.class_id, r.class_name) for r in catalog.class_map(spark, str(tmp_path / "c.yaml")).orderBy("class_id").collect()] == [(0, "background"), (7, "roof")]
    assert catalog.class_map(spark, str(tmp_path / "none.yaml")).count() == 0
