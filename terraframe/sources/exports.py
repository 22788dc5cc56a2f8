"""Results for other programs: PNG previews, made by tasks; GeoPackage and reports of jobs, written on the driver."""

from __future__ import annotations

import json
import sqlite3
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame

from ..operators import quality
from . import pieces

# Fixed values of the GeoPackage format.
GPKG_ID, GPKG_VERSION = 0x47504B47, 10200
#: Bytes of a PNG chunk at most, some less than the format allows.
CHUNK_LIMIT = (1 << 31) - 64


def _polygon(ring: list) -> bytes:
    """A GeoPackage geometry: its header without an envelope, then WKB."""
    points = b"".join(struct.pack("<dd", p["x"], p["y"]) for p in ring)
    return b"GP\0\1" + struct.pack("<i", 0) + struct.pack("<BIII", 1, 3, 1, len(ring)) + points


def write_gpkg(features: DataFrame, path: str, layer: str = "features") -> None:
    """Rows with a column `ring` as polygons; nested properties as JSON text. No rows give an empty layer."""
    names = [c for c in features.columns if c != "ring"]
    con = sqlite3.connect(path)
    con.executescript(f"""pragma application_id = {GPKG_ID}; pragma user_version = {GPKG_VERSION};
create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
insert into gpkg_spatial_ref_sys values ('undefined cartesian', -1, 'NONE', -1, 'undefined', null), ('undefined geographic', 0, 'NONE', 0, 'undefined', null);
create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change text not null default (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x double, min_y double, max_x double, max_y double, srs_id integer);
create table gpkg_geometry_columns (table_name text primary key, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null);""")
    columns = ", ".join(f'"{n}"' for n in names)
    con.execute(f'create table "{layer}" (fid integer primary key autoincrement, geom blob{", " + columns if names else ""})')
    con.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, 0)", (layer, layer))
    con.execute("insert into gpkg_geometry_columns values (?, 'geom', 'POLYGON', 0, 0, 0)", (layer,))
    for row in features.toLocalIterator():
        found = row.asDict(recursive=True)
        values = [json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else v for v in (found[n] for n in names)]
        con.execute(f'insert into "{layer}" (geom{", " + columns if names else ""}) values ({", ".join("?" * (len(names) + 1))})', [_polygon(found["ring"]), *values])
    con.commit()
    con.close()


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(pixels: DataFrame, path: str, width: int, height: int, rows: int = 256) -> None:
    """Columns y, x, r, g, b as an image of 8 bits a sample; pixels that are not there are black. Tasks deflate strips of so many rows."""

    def make(strip: int, image: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        lines = np.zeros((image.shape[1], 1 + 3 * width), np.uint8)  # each begins with its filter, none
        lines[:, 1:] = image.transpose(1, 2, 0).reshape(len(lines), -1)
        yield strip, pieces.deflated(lines.tobytes()), lines.tobytes()

    def frame(file: BinaryIO, found: list[pieces.Piece]) -> list[int]:
        file.write(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)))
        adler = 1
        for p in found:
            adler = pieces.joined_adler(adler, p.adler, p.raw)
        # pieces in chunks, one where they fit; the first begins with the stream's head, the last ends with its sum
        places, at, k = [], file.tell(), 0
        while k < len(found):
            body = b"IDAT" + (b"" if k else b"\x78\x9c")
            size, crc, start = len(body) - 4, zlib.crc32(body), at + 8
            file.seek(at + 4)
            file.write(body)
            at = start + size
            while k < len(found) and (size + found[k].size < CHUNK_LIMIT or at == start + len(body) - 4):
                places.append(at)
                at, size, crc = at + found[k].size, size + found[k].size, pieces.joined_crc(crc, found[k].stored_crc, found[k].size)
                k += 1
            tail = pieces.END + struct.pack(">I", adler) if k == len(found) else b""
            file.seek(at)
            file.write(tail + struct.pack(">I", zlib.crc32(tail, crc)))
            file.seek(start - 8)
            file.write(struct.pack(">I", size + len(tail)))
            at += len(tail) + 4
        file.seek(at)
        file.write(_chunk(b"IEND", b""))
        return places

    pieces.write(path, lambda folder: pieces.strips(pixels, ["r", "g", "b"], width, height, rows, np.dtype(np.uint8), 0, make, folder), frame, pixels)


def processing_report(manifest: dict, title: str = "Remote Sensing Processing Report") -> str:
    """Markdown of a manifest: inputs, outputs, statistics and flags."""
    scene = lambda v: f"{v.get('width')} x {v.get('height')}, {v.get('count')} band(s), CRS={v.get('crs')}"
    inputs = [f"- {k}: {scene(v)}" if k.endswith("raster") and isinstance(v, dict) else f"- {k}: `{v}`" for k, v in manifest.get("inputs", {}).items()]
    flags = [f"- [{f.get('severity', 'warning')}] {f.get('code')}: {f.get('message')}" for f in manifest.get("quality_flags", [])]
    sections = {
        "Inputs": inputs, "Outputs": [f"- {k}: `{v}`" for k, v in manifest.get("outputs", {}).items()],
        "Statistics": [f"- {k}: `{v}`" for k, v in manifest.get("stats", {}).items()] or ["- No statistics were recorded."], "Quality Flags": flags or [quality.EMPTY["flags"]],
    }
    head = [f"# {title}", "", *(f"- Source {n}: `{manifest.get(k)}`" for n, k in (("task", "task"), ("job", "job_id"), ("status", "status"))), ""]
    return "\n".join([*head, *(line for name, lines in sections.items() for line in (f"## {name}", "", *lines, ""))])


def index_report(source: str, area: float, bands: dict, summaries: dict[str, dict], flags: list[dict], outputs: dict[str, str]) -> str:
    """Markdown of spectral indices: extent, spread and threshold areas of each, flags, files in order of name."""
    lines = ["# 光谱指数分析报告", "", "## 数据概况", f"- 输入影像: `{source}`", f"- 像元面积: {area:.6f} m2", f"- 波段映射: `{bands}`", "", "## 指数统计"]
    for name, s in summaries.items():
        lines += [f"### {name.upper()}", *(f"- {'/'.join(keys)}: " + " / ".join(f"{s[k]:.6f}" for k in keys) for keys in (("min", "max"), ("mean", "std"), ("p5", "p50", "p95")))]
        lines += [f"- 阈值 {label}: {a['area_m2']:.2f} m2 ({a['area_km2']:.6f} km2)" for label, a in s.get("threshold_areas", {}).items()]
    lines += ["", "## 质量检查", *([f"- [{f['severity']}] {f['code']}: {f['message']}" for f in flags] or ["- 未发现明显质量风险。"])]
    return "\n".join([*lines, "", "## 输出文件", *(f"- {k}: `{v}`" for k, v in sorted(outputs.items()))]) + "\n"


def file_checks(manifest: dict | None = None, source: dict | None = None, exists=None) -> list[dict]:
    """Flags of a result's files: missing outputs, no records, a scene without CRS; needs a manifest or a scene's description."""
    import os

    if manifest is None and source is None:
        raise ValueError("a manifest or an input is needed")
    exists, flags = exists or os.path.exists, []
    for name, path in ((manifest or {}).get("outputs") or {}).items():
        if not exists(path):
            flags.append({"code": "missing_output", "severity": "error", "message": f"Output {name} is missing: {path}"})
    if (manifest or {}).get("stats", {}).get("count") == 0:
        flags.append({"code": "empty_result", "severity": "warning", "message": "The result has no records."})
    for scene in [source] if source else [v for v in (manifest or {}).get("inputs", {}).values() if isinstance(v, dict)]:
        if not scene.get("crs"):
            flags.append({"code": "missing_crs", "severity": "warning", "message": "The scene has no CRS."})
    seen: dict = {}
    for f in flags:
        seen.setdefault((f["code"], f["message"]), f)
    return list(seen.values())
