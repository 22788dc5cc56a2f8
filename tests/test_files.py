"""Scene files: what a scan opens, files beyond 4 GB, writers that are run again or fail, strips put together."""

import os
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraframe.sources import exports, npz, pieces, rasters, scene_source, scenes, tiff


def pixels(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """One scene as planar TIFF, as NPZ of its own strips, and as containers of another program."""
    folder = tmp_path_factory.mktemp("files")
    scene = scenes.synthetic(spark, 70, 1100, 3).cache()
    tiff.write_scene(scene, str(folder / "s.tif"), 70, 1100, "uint8", "EPSG:3857", (2, 0, 0, 0, -2, 0))
    npz.write_scene(scene, str(folder / "s.npz"), 70, 1100, "uint8", "EPSG:3857", (2, 0, 0, 0, -2, 0), strip=100)
    data = np.zeros((3, 1100, 70), np.uint8)
    for y, x, *bands in scene.collect():
        data[:, y, x] = bands
    np.savez(folder / "plain.npz", data=data)
    np.savez_compressed(folder / "packed.npz", data=data)
    np.savez_compressed(folder / "columns.npz", data=np.asfortranarray(data))
    return folder, scene, data


NAMES = ["s.tif", "s.npz", "plain.npz", "packed.npz", "columns.npz"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("window", [None, (10, 5, 7, 3), (60, 1000, 100, 1000), (-5, -5, 10, 520), (3, 254, 60, 600), (200, 0, 5, 5)])
def test_windows_and_bands_equal_the_whole_read_then_filtered(spark, files, name, window):
    folder, scene, _ = files
    x, y, w, h = window or (0, 0, 70, 1100)
    found = rasters.read_scene(spark, str(folder / name), bands=[3, 1], window=window)
    wanted = scene.filter((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)).select("y", "x", "b3", "b1")
    assert pixels(found) == pixels(wanted)


@pytest.mark.parametrize("name", NAMES[:3])
def test_a_window_opens_its_own_parts_only(files, name, monkeypatch):
    folder, _, data = files
    path, read = str(folder / name), []
    info = scene_source.reader_of(path).describe(path)
    wanted = scene_source.SceneReader(info, [2], (5, 600, 20, 10))
    pread = os.pread
    monkeypatch.setattr(os, "pread", lambda *a: read.append(pread(*a)) or read[-1])
    batches = [b for p in wanted.partitions() for b in wanted.read(p)]
    assert sum(map(len, batches)) == 200 and len(wanted.partitions()) == 1
    assert sum(map(len, read)) <= info["high"] * 70 + 64  # one strip of one band, and its place in the file's table
    first = batches[0]
    assert (first.column("b2").to_numpy().reshape(10, 20) == data[1, 600:610, 5:25]).all()
    assert scene_source.SceneReader(info, [1], (0, 5000, 5, 5)).partitions() == []


def test_filters_of_a_query_choose_parts(spark, files):
    folder, scene, _ = files
    before = spark.conf.get(scene_source.PUSHDOWN)
    spark.conf.set(scene_source.PUSHDOWN, "true")
    try:
        own = scenes.window(rasters.read_scene(spark, str(folder / "s.tif")), 4, 300, 30, 20, [2])
        assert pixels(own) == pixels(scenes.window(scene, 4, 300, 30, 20, [2]))
        assert own.rdd.getNumPartitions() == 1  # of five strips
        whole = rasters.read_scene(spark, str(folder / "s.tif")).filter("y > 1098 and b1 % 2 = 0 and x in (3, 5, 69)")
        assert pixels(whole) == pixels(scene.filter("y > 1098 and b1 % 2 = 0 and x in (3, 5, 69)"))
    finally:
        spark.conf.set(scene_source.PUSHDOWN, before)


def test_bands_out_of_range(spark, files):
    with pytest.raises(Exception, match="numbered from 1"):
        rasters.read_scene(spark, str(files[0] / "s.tif"), bands=[4]).count()


def test_a_file_beyond_4_gb(spark, tmp_path):
    """Holes everywhere but in three places; neither the file nor its tables are held."""
    path, width, height = str(tmp_path / "big.tif"), 40_000, 60_000
    rows = [(0, 0, 1.5, 2.5), (30_000, 39_999, -7.25, 0.5), (59_999, 12_345, 3.0, 4.0)]
    tiff.write_scene(spark.createDataFrame(rows, "y long, x long, b1 double, b2 double"), path, width, height, "float32", "EPSG:3857", (1, 0, 0, 0, -1, 0))
    assert os.path.getsize(path) > 19e9 and os.stat(path).st_blocks * 512 < 2e8
    info = tiff.describe(path)
    assert (info["width"], info["height"], info["count"], info["dtype"]) == (width, height, 2, "float32")
    with open(path, "rb") as file:
        assert file.read(4) == b"II+\0"
    for y, x, *bands in rows:
        (found,) = rasters.read_scene(spark, path, window=(x, y, 1, 1)).collect()
        assert tuple(found) == (y, x, *bands)
    assert rasters.read_scene(spark, path, bands=[2], window=(100, 40_000, 3, 2)).agg(F.sum("b2"), F.count("*")).collect()[0] == (0.0, 6)


def test_small_big_tiff_and_nodata(spark, tmp_path):
    path, scene = str(tmp_path / "b.tif"), scenes.synthetic(spark, 40, 700, 2).filter("(x + y) % 3 = 0 and y < 100").repartition(5)
    tiff.write_scene(scene, path, 40, 700, "int16", nodata=-7, big=True)
    found = {(r.y, r.x): (r.b1, r.b2) for r in tiff.read_scene(spark, path).collect()}
    kept = {(r.y, r.x): (r.b1, r.b2) for r in scene.collect()}
    assert found == {(y, x): kept.get((y, x), (-7, -7)) for y in range(700) for x in range(40)} and tiff.describe(path)["nodata"] == -7


def test_a_task_that_runs_again_writes_the_same(tmp_path):
    path = str(tmp_path / "a.tif")
    layout = tiff.Layout(3, 2, 1, "uint8", None, None, None)
    batch = pa.record_batch({"__strip": pa.array([0, 0]), "y": pa.array([0, 1]), "x": pa.array([2, 0]), "b1": pa.array([9, 8])})

    def broken():
        yield batch.slice(0, 1)
        raise RuntimeError("lost")

    writer = tiff.SceneWriter(path, layout)
    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert not os.path.exists(path)
    writer.commit([writer.write(iter([batch])), writer.write(iter([batch]))])
    data = open(path, "rb").read()
    assert data[8:14] == bytes([0, 0, 9, 8, 0, 0])
    again = tiff.SceneWriter(path, layout)
    again.abort([None])
    assert sorted(os.listdir(tmp_path)) == ["a.tif"] and open(path, "rb").read() == data


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    scene = scenes.synthetic(spark, 20, 20, 1)
    broken = scene.withColumn("b1", F.when(F.col("y") == 19, F.raise_error(F.lit("broken"))).otherwise(F.col("b1")).cast("long"))
    image = broken.select("y", "x", *[F.col("b1").alias(c) for c in "rgb"])
    for write in (lambda: tiff.write_scene(broken, str(tmp_path / "a"), 20, 20, "uint8"), lambda: npz.write_scene(broken, str(tmp_path / "a"), 20, 20, "uint8"), lambda: exports.write_png(image, str(tmp_path / "a"), 20, 20)):
        with pytest.raises(Exception, match="broken"):
            write()
        assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="outside"):
        tiff.write_scene(scene, str(tmp_path / "a"), 20, 10, "uint8")
    assert os.listdir(tmp_path) == []


def test_containers_read_by_others(files):
    folder, _, data = files
    with np.load(folder / "s.npz", allow_pickle=False) as found:
        assert (found["data"] == data).all()
    assert zipfile.ZipFile(folder / "s.npz").testzip() is None
    assert npz.describe(str(folder / "s.npz"))["crs"] == "EPSG:3857" and npz.describe(str(folder / "packed.npz"))["restarts"] is None


@pytest.mark.parametrize("limit", [exports.CHUNK_LIMIT, 900, 10])
def test_a_preview_of_many_strips(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(exports, "CHUNK_LIMIT", limit)
    scene = scenes.synthetic(spark, 33, 100, 3).filter("y < 40 or y > 80").select("y", "x", F.col("b1").alias("r"), F.col("b2").alias("g"), F.col("b3").alias("b"))
    exports.write_png(scene, str(tmp_path / "p.png"), 33, 100, rows=7)
    raw, at, body = (tmp_path / "p.png").read_bytes(), 8, b""
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        assert zlib.crc32(raw[at + 4 : at + 8 + size]) == struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0]
        body += raw[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    image = np.frombuffer(zlib.decompress(body), np.uint8).reshape(100, 1 + 99)
    wanted = np.zeros((100, 33, 3), np.uint8)
    for y, x, *colour in scene.collect():
        wanted[y, x] = colour
    assert (image[:, 0] == 0).all() and (image[:, 1:].reshape(wanted.shape) == wanted).all() and os.listdir(tmp_path) == ["p.png"]


def test_checksums_of_joined_parts():
    rng = np.random.default_rng(1)
    for a, b in ((0, 0), (0, 5), (7, 0), (70_000, 131_072), (3, 65_521)):
        first, second = rng.bytes(a), rng.bytes(b)
        assert pieces.joined_crc(zlib.crc32(first), zlib.crc32(second), b) == zlib.crc32(first + second)
        assert pieces.joined_adler(zlib.adler32(first), zlib.adler32(second), b) == zlib.adler32(first + second)
    assert zlib.decompress(pieces.deflated(b"ab") + pieces.deflated(b"cd") + pieces.END, -15) == b"abcd"
