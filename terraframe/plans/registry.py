"""All named queries of the raster engine and the SQL each is held against.

Doubles are rounded in both, after a small nudge off rounding ties, which engines break differently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import affine, geometry, indices, tiles
from ..operators import raster_ops, statistics, stitching
from ..sources import scenes

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable:
    def add(query: Callable) -> Callable:
        _QUERIES[query.__name__] = query
        if sql:
            _SQL[query.__name__] = sql
        return query

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(1.37e-9), 6)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


SCENE = """scene as (select event_id // 100 as y, event_id % 100 as x, regexp_extract(props, '([0-9]+)', 1)::double as blue, (user_id % 256)::double as green,
  value::double as red, (minute(ts) * 4)::double as nir, (second(ts) * 4)::double as swir1, (hour(ts) * 10)::double as swir2 from events)"""
LATER = "later as (select o_orderkey // 100 as y, o_orderkey % 100 as x, (o_totalprice::double % 256) as red from orders)"
VECTORS = "vectors as (select vec_id // 25 as y, vec_id % 25 as x, list_transform(embedding, lambda v: v::double) as bands, label as class_id from embeddings)"
BOXES = """boxes as (select p_partkey as id, p_brand as label, (p_partkey * 7919 % 1000)::double / 1000e0 as score, (p_partkey * 37 % 400)::double as x1, (p_partkey * 91 % 300)::double as y1,
  (p_partkey * 37 % 400)::double + p_size as x2, (p_partkey * 91 % 300)::double + p_size as y2 from part)"""
INDEX_SQL = {
    "ndvi": ("nir - red", "nir + red"), "ndwi": ("green - nir", "green + nir"), "mndwi": ("green - swir1", "green + swir1"), "ndbi": ("swir1 - nir", "swir1 + nir"),
    "savi": ("1.5e0 * (nir - red)", "nir + red + 0.5e0"), "evi": ("2.5e0 * (nir - red)", "nir + 6e0 * red - 7.5e0 * blue + 1e0"),
}


def _sql_r6(x: str) -> str:
    return f"round(({x})::double + 1.37e-9, 6)"


def _sql_index(name: str) -> str:
    n, d = INDEX_SQL[name]
    return f"case when abs({d}) >= 1e-6 then ({n}) / ({d}) end"


def _bands(names: list[str] | None = None) -> dict[str, Column]:
    return {n: F.col(n) for n in names or scenes.BANDS}


# --- M: indices ---------------------------------------------------------------------------------

def _index_query(number: int, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scenes.scene(spark, sf_dir)
        return rows.select("y", "x", r6(indices.index(name, _bands())).alias("value"), indices.near_zero(name, _bands()).alias("near_zero"))

    run.__name__ = f"m{number}_{name}"
    d = INDEX_SQL[name][1]
    _query(f"with {SCENE} select y, x, {_sql_r6(_sql_index(name))} as value, abs({d}) < 1e-6 as near_zero from scene")(run)


for _i, _n in enumerate(indices.FORMULAS, 1):
    _index_query(_i, _n)

_SUMMARY_SQL = ", ".join(f"coalesce({_sql_r6(e)}, 0) as {n}" for n, e in (("min", "min(v)"), ("max", "max(v)"), ("mean", "avg(v)"), ("std", "stddev_pop(v)"), ("p5", "quantile_cont(v, 0.05)"), ("p50", "quantile_cont(v, 0.5)"), ("p95", "quantile_cont(v, 0.95)")))


@_query(f"with {SCENE}, i as (select {_sql_index('ndvi')} as v from scene) select {_SUMMARY_SQL}, count(v) as valid_pixels from i")
def m7_index_summary(spark, sf_dir):
    rows = scenes.scene(spark, sf_dir).select(indices.index("ndvi", _bands()).alias("v"))
    return _rounded(spark.createDataFrame(statistics.summaries(rows, ["v"])[0], statistics.SUMMARY))


@_query("with " + SCENE + ", i as (" + " union all ".join(f"select '{n}' as name, {_sql_index(n)} as v, (abs({INDEX_SQL[n][1]}) < 1e-6)::int as z from scene" for n in INDEX_SQL) + f") select name, {_SUMMARY_SQL}, count(v) as valid_pixels, sum(z)::bigint as near_zero_pixels from i group by name")
def m7_all_indices(spark, sf_dir):
    """Every index of one scan: one aggregate and the passes for percentiles, for all of them."""
    rows = scenes.scene(spark, sf_dir).select(*[c for n in indices.FORMULAS for c in (indices.index(n, _bands()).alias(n), indices.near_zero(n, _bands()).cast("int").alias(f"{n}_z"))])
    found, more = statistics.summaries(rows, list(indices.FORMULAS), *[F.sum(f"{n}_z").alias(n) for n in indices.FORMULAS])
    found = [{"name": n, "near_zero_pixels": more[n]} | x for n, x in zip(indices.FORMULAS, found, strict=True)]
    return _rounded(spark.createDataFrame(found, f"name string, {statistics.SUMMARY}, near_zero_pixels long"))


@_query(f"""with {SCENE}, i as (select {_sql_index('ndvi')} as v from scene), c as (select unnest([{{'label': 'dense', 'n': count_if(v > 0.3e0)}}, {{'label': 'water', 'n': count_if(v <= -0.1e0)}}, {{'label': 'some', 'n': count_if(v >= 0.1e0)}}]) as r from i)
select r.label as label, r.n::bigint as pixel_count, {_sql_r6('r.n * 4e0')} as area_m2, {_sql_r6('r.n * 4e0 / 1e6')} as area_km2 from c""")
def m8_threshold_areas(spark, sf_dir):
    rows = scenes.scene(spark, sf_dir).select(indices.index("ndvi", _bands()).alias("v"))
    return _rounded(statistics.threshold_areas(rows, "v", indices.thresholds({"dense": 0.3, "water": "<= -0.1", "some": ">= 0.1"}), 4.0))


@_query(f"with {SCENE}, i as (select {_sql_index('ndvi')} as v from scene) select count_if(v >= 0.5e0)::bigint as ge, count_if(v <= 0.5e0)::bigint as le, count_if(v > 0.5e0)::bigint as gt, count_if(v < 0.5e0)::bigint as lt, count_if(v > 0.5e0)::bigint as bare from i")
def m9_threshold_rules(spark, sf_dir):
    rows = scenes.scene(spark, sf_dir).select(indices.index("ndvi", _bands()).alias("v"))
    return rows.agg(*[F.count_if(indices.threshold(t)(F.col("v"))).alias(n) for n, t in (("ge", ">=0.5"), ("le", "<= 0.5"), ("gt", ">0.5"), ("lt", " < 0.5"), ("bare", 0.5))])


@_query("with " + SCENE + ", i as (" + " union all ".join(f"select '{n}' as name, {_sql_index(n)} as v, {1.5 if n == 'evi' else 1.05}::double as w from scene" for n in INDEX_SQL) + ") select name, case when count(v) = 0 then 'empty_index' when min(v) < -max(w) or max(v) > max(w) then 'index_value_out_of_range' end as code from i group by name")
def m10_range_warning(spark, sf_dir):
    rows = scenes.scene(spark, sf_dir)
    ends = rows.agg(*[f(indices.index(n, _bands())).alias(f"{p}_{n}") for n in indices.FORMULAS for p, f in (("a", F.min), ("b", F.max))])
    return ends.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), indices.range_flag(n, F.col(f"a_{n}"), F.col(f"b_{n}")).alias("code")) for n in indices.FORMULAS])).alias("r")).select("r.*")


# --- G: affine transforms and geometry ----------------------------------------------------------

@_query("select p_partkey as id, abs((p_size + 1e0) * -2e0 - 0e0) as area from part")
def m11_pixel_area(spark, sf_dir):
    t = F.struct(*[c.cast("double").alias(n) for n, c in zip("abcdef", (F.col("p_size") + 1, F.lit(0), F.lit(5), F.lit(0), F.lit(-2), F.lit(9)), strict=True)])
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), affine.pixel_area(t).alias("area"))


T = (2.0, 0.5, 1000.0, 0.25, -3.0, 2000.0)
_GX, _GY = "(2e0 * ({0}) + 0.5e0 * ({1}) + 1000e0)", "(0.25e0 * ({0}) - 3e0 * ({1}) + 2000e0)"


@_query(f"with {BOXES} select id, {_GX.format('x1', 'y1')} as gx, {_GY.format('x1', 'y1')} as gy from boxes")
def g1_pixel_to_geo(spark, sf_dir):
    p = affine.pixel_to_geo(affine.transform(T), F.col("bbox")[0], F.col("bbox")[1])
    return scenes.boxes(spark, sf_dir).select("id", p["x"].alias("gx"), p["y"].alias("gy"))


_CORNERS = [("0", "0"), ("w", "0"), ("0", "h"), ("w", "h")]
_BOUNDS_SQL = ", ".join(f"{f}({', '.join(g.format(*c) for c in _CORNERS)}) as {n}" for f, g, n in (("least", _GX, "xmin"), ("least", _GY, "ymin"), ("greatest", _GX, "xmax"), ("greatest", _GY, "ymax")))


@_query(f"select id, {_BOUNDS_SQL} from (select p_partkey as id, (p_size * 3)::double as w, (p_size + 7)::double as h from part)")
def g2_geo_bounds(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    b = affine.geo_bounds(affine.transform(T), (F.col("p_size") * 3).cast("double"), (F.col("p_size") + 7).cast("double"))
    return rows.select(F.col("p_partkey").alias("id"), *[b[n].alias(n) for n in ("xmin", "ymin", "xmax", "ymax")])


def _points(df: DataFrame, ring: Column) -> DataFrame:
    return df.select("id", F.posexplode(ring).alias("seq", "p")).select("id", "seq", r6("p.x").alias("px"), r6("p.y").alias("py"))


_RING = "unnest([{{'s': 0, 'x': x1, 'y': y1}}, {{'s': 1, 'x': x2, 'y': y1}}, {{'s': 2, 'x': x2, 'y': y2}}, {{'s': 3, 'x': x1, 'y': y2}}, {{'s': 4, 'x': x1, 'y': y1}}])".replace("{{", "{").replace("}}", "}")


@_query(f"with {BOXES}, p as (select id, {_RING} as r from boxes) select id, r.s::int as seq, {_sql_r6('r.x')} as px, {_sql_r6('r.y')} as py from p")
def g3_box_polygon(spark, sf_dir):
    return _points(scenes.boxes(spark, sf_dir), geometry.box_polygon(F.col("bbox")))


_TURNED = "unnest([" + ", ".join(f"{{'s': {i}, 'u': {u}e0, 'v': {v}e0}}" for i, (u, v) in enumerate([(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)])) + "])"
_TX, _TY = "cx + w * r.u * cos(radians(a)) - h * r.v * sin(radians(a))", "cy + w * r.u * sin(radians(a)) + h * r.v * cos(radians(a))"


@_query(f"with {BOXES}, p as (select id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as w, (y2 - y1) / 2 as h, (id % 90)::double as a, {_TURNED} as r from boxes) select id, r.s::int as seq, {_sql_r6(_TX)} as px, {_sql_r6(_TY)} as py from p")
def g4_rotated_box_polygon(spark, sf_dir):
    b = F.col("bbox")
    return _points(scenes.boxes(spark, sf_dir), geometry.rotated_box_polygon((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], (b[3] - b[1]) / 2, (F.col("id") % 90).cast("double")))


@_query(f"with {BOXES}, p as (select id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as w, (y2 - y1) / 2 as h, (id % 90)::double as a, {_TURNED} as r from boxes), q as (select id, {_TX} as px, {_TY} as py from p) select id, {_sql_r6('min(px)')} as xmin, {_sql_r6('min(py)')} as ymin, {_sql_r6('max(px)')} as xmax, {_sql_r6('max(py)')} as ymax from q group by id")
def g5_polygon_bounds(spark, sf_dir):
    b = F.col("bbox")
    ring = geometry.rotated_box_polygon((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], (b[3] - b[1]) / 2, (F.col("id") % 90).cast("double"))
    rows = scenes.boxes(spark, sf_dir).select("id", geometry.polygon_bounds(ring).alias("b"))
    return rows.select("id", *[r6(F.col("b")[i]).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))])


@_query(f"with {BOXES}, p as (select id, {_RING} as r from boxes) select id, r.s::int as seq, {_sql_r6(_GX.format('r.x', 'r.y'))} as px, {_sql_r6(_GY.format('r.x', 'r.y'))} as py from p")
def g6_polygon_to_geo(spark, sf_dir):
    return _points(scenes.boxes(spark, sf_dir), geometry.to_geo(geometry.box_polygon(F.col("bbox")), affine.transform(T)))


@_query(f"with {BOXES}, p as (select id, {_RING} as r from boxes) select id, r.s::int as seq, {_sql_r6(_GX.format('r.x', 'r.y'))} as px, {_sql_r6(_GY.format('r.x', 'r.y'))} as py from p")
def g7_closed_geo_polygon(spark, sf_dir):
    """An open ring closes; a closed one stays."""
    open_ring = F.slice(geometry.box_polygon(F.col("bbox")), 1, F.when(F.col("id") % 2 == 0, 4).otherwise(5))
    return _points(scenes.boxes(spark, sf_dir), geometry.to_geo(geometry.closed(open_ring), affine.transform(T)))


_INTER = "(greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
_UNION = f"((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INTER})"


@_query(f"with {BOXES} select a.id as id, {_sql_r6(f'case when {_UNION} > 0 then {_INTER} / {_UNION} else 0 end')} as iou from boxes a join boxes b on b.id = a.id + 1")
def g8_iou(spark, sf_dir):
    rows = scenes.boxes(spark, sf_dir)
    other = rows.select((F.col("id") - 1).alias("o"), F.col("bbox").alias("c"))
    return rows.join(other, F.col("id") == F.col("o")).select("id", r6(geometry.iou(F.col("bbox"), F.col("c"))).alias("iou"))


@_query(f"with {BOXES} select id, {_sql_r6('(x2 - x1) * (y2 - y1) / 2')} as area from boxes")
def g9_shoelace_area(spark, sf_dir):
    b, h = F.col("bbox"), lambda i, j: (F.col("bbox")[i] + F.col("bbox")[j]) / 2
    p = geometry.point
    diamond = F.array(p(h(0, 2), b[1]), p(b[2], h(1, 3)), p(h(0, 2), b[3]), p(b[0], h(1, 3)), p(h(0, 2), b[1]))
    return scenes.boxes(spark, sf_dir).select("id", r6(geometry.shoelace_area(diamond)).alias("area"))


@_query("select p_partkey as id, " + ", ".join(f"{_sql_r6(f'({v}e0 + p_size)' + ('' if n in 'cf' else ' / 4e0'))} as {n}" for v, n in zip(T, "abcdef", strict=True)) + " from part")
def g10_scaled_transform(spark, sf_dir):
    t = F.struct(*[(F.lit(v) + F.col("p_size")).alias(n) for v, n in zip(T, "abcdef", strict=True)])
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), affine.scaled(t, 4).alias("t"))
    return rows.select("id", *[r6(f"t.{n}").alias(n) for n in "abcdef"])


def _pair(rows: DataFrame) -> DataFrame:
    """Pairs of scene descriptions that differ in ways told by the key."""
    k = F.col("p_partkey")

    def info(other: bool) -> Column:
        d = lambda m, v: F.when(k % m == 0, v).otherwise(0) if other else F.lit(0)
        t = F.struct(*[c.cast("double").alias(n) for n, c in zip("abcdef", (F.lit(2) + d(5, 1), F.lit(0), F.lit(100) + d(3, 7), F.lit(0), F.lit(-2), F.lit(200)), strict=True)])
        w, h = F.lit(60) + d(7, 4), F.lit(40)
        crs = F.when(k % 4 == 0, F.lit(None).cast("string") if other else F.lit("EPSG:4326")).otherwise(F.lit("EPSG:3857"))
        return F.struct(crs.alias("crs"), w.alias("width"), h.alias("height"), t.alias("transform"), affine.geo_bounds(t, w.cast("double"), h.cast("double")).alias("bounds"))

    return rows.select(k.alias("id"), info(False).alias("reference"), info(True).alias("candidate"))


_ISSUES = "list_filter([case when id % 4 = 0 then 'crs_mismatch' end, case when id % 7 = 0 then 'shape_mismatch' end, case when id % 5 = 0 or id % 3 = 0 then 'transform_mismatch' end, case when id % 5 = 0 or id % 3 = 0 or id % 7 = 0 then 'bounds_mismatch' end, case when id % 5 = 0 then 'resolution_mismatch' end], lambda i: i is not null)"


@_query(f"with p as (select p_partkey as id from part) select id, array_to_string({_ISSUES}, ',') as issues, len({_ISSUES}) = 0 as aligned from p")
def g11_pair_alignment(spark, sf_dir):
    rows = _pair(spark.read.parquet(f"{sf_dir}/part.parquet")).withColumn("i", raster_ops.alignment(F.col("reference"), F.col("candidate")))
    return rows.select("id", F.array_join("i", ",").alias("issues"), (F.size("i") == 0).alias("aligned"))


@_query(f"with p as (select p_partkey as id from part), q as (select id, {_ISSUES} as i from p) select id, case when len(i) = 0 then '' else array_to_string(list_transform(i, lambda v: 'alignment_' || v), ',') || ',simple_resampling_only_no_feature_registration' end as warnings from q")
def g12_alignment_warnings(spark, sf_dir):
    rows = _pair(spark.read.parquet(f"{sf_dir}/part.parquet"))
    return rows.select("id", F.array_join(raster_ops.alignment_warnings(raster_ops.alignment(F.col("reference"), F.col("candidate"))), ",").alias("warnings"))


_NEAREST = "select t.y as y, t.x as x, {0} from (select range // 70 as y, range % 70 as x from range(45 * 70)) t, (select max(vec_id) // 25 as last from embeddings) e join {1} s on s.y = round_even(t.y * (e.last::double / 44e0), 0)::bigint and s.x = round_even(t.x * (24e0 / 69e0), 0)::bigint"


@_query(f"with {VECTORS} " + _NEAREST.format("s.class_id", "vectors"))
def g13_nearest_resample(spark, sf_dir):
    return raster_ops.resample(scenes.vector_scene(spark, sf_dir).select("y", "x", "class_id"), scenes.vector_size(spark, sf_dir), (45, 70)).select("y", "x", "class_id")


@_query(f"with {VECTORS} " + _NEAREST.format(f"{_sql_r6('s.bands[1]')} as first, {_sql_r6('s.bands[3]')} as last, 3 as bands", "vectors"))
def g14_align_to_reference(spark, sf_dir):
    rows = raster_ops.resample(scenes.vector_scene(spark, sf_dir).select("y", "x", "bands"), scenes.vector_size(spark, sf_dir), (45, 70)).withColumn("bands", stitching.match_bands(F.col("bands"), 3))
    return rows.select("y", "x", r6(F.col("bands")[0]).alias("first"), r6(F.element_at("bands", -1)).alias("last"), F.size("bands").alias("bands"))


@_query(f"with {VECTORS} select y, x, 66 as n, {_sql_r6('bands[64]')} as last, {_sql_r6('bands[2]')} as second from vectors")
def g15_match_bands(spark, sf_dir):
    rows = scenes.vector_scene(spark, sf_dir).withColumn("m", stitching.match_bands(F.col("bands"), 66))
    return rows.select("y", "x", F.size("m").alias("n"), r6(F.element_at("m", -1)).alias("last"), r6(F.col("m")[1]).alias("second"))


@_query(f"with {SCENE} select s.y * 2 + d.range as y, s.x * 2 + e.range as x, s.red from scene s, range(2) d, range(2) e")
def g16_nearest_upscale(spark, sf_dir):
    return raster_ops.upscale(scenes.scene(spark, sf_dir).select("y", "x", "red"), 2)


# --- T: tiles, boxes, bands -----------------------------------------------------------------------

_GRID = """with a as (select (case when {w} <= {t} then 1 else ceil(({w} - {t})::double / {s})::bigint + 1 end) as nx, (case when {h} <= {t} then 1 else ceil(({h} - {t})::double / {s})::bigint + 1 end) as ny),
g as (select r.range as r, c.range as c, nx, ny from a, range(1000) r, range(1000) c where r.range < ny and c.range < nx)"""


@_query(_GRID.format(w=1000, h=700, t=128, s=96) + " select (r * nx + c)::int as tile_seq, printf('r%04d_c%04d', r, c) as tile_id, r::int as row, c::int as col, (c * 96)::int as x0, (r * 96)::int as y0, least(c * 96 + 128, 1000)::int as x1, least(r * 96 + 128, 700)::int as y1 from g")
def t1_shrinking_tiles(spark, sf_dir):
    return tiles.grid(spark, 1000, 700, 128, 32, edge="shrink")


@_query(_GRID.format(w=1000, h=700, t=128, s=96) + " select (r * nx + c)::int as tile_seq, printf('tile_%05d', r * nx + c) as tile_id, r::int as row, c::int as col, least(c * 96, 872)::int as x0, least(r * 96, 572)::int as y0, least(c * 96, 872)::int + 128 as x1, least(r * 96, 572)::int + 128 as y1 from g")
def t2_shifted_tiles(spark, sf_dir):
    return tiles.grid(spark, 1000, 700, 128, 32)


@_query("select 'super_resolution' as task, 256 as tile_size, 32 as overlap, 54::bigint as tile_count, (select string_agg(printf('r%04d_c%04d', range // 9, range % 9), ',' order by range) from range(20)) as windows, true as windows_truncated")
def t4_preflight(spark, sf_dir):
    return tiles.preflight(spark, 2048, 1200, "super_resolution")


_ASSIGN = """dims as (select 100 as w, ((select count(*) from events) + 99) // 100 as h), n as (select w, h, case when w <= 32 then 1 else ceil((w - 32)::double / 24)::bigint + 1 end as nx, case when h <= 32 then 1 else ceil((h - 32)::double / 24)::bigint + 1 end as ny from dims),
tile as (select r.range * nx + c.range as tile_seq, case when c.range = nx - 1 then greatest(0, w - 32) else c.range * 24 end as x0, case when r.range = ny - 1 then greatest(0, h - 32) else r.range * 24 end as y0 from n, range(2000) r, range(20) c where r.range < ny and c.range < nx)"""


def _tiled(spark: SparkSession, sf_dir: str, pixels: DataFrame) -> DataFrame:
    width, height = scenes.size(spark, sf_dir)
    return tiles.assign(pixels, width, height, 32, 8)


@_query(f"with {SCENE}, {_ASSIGN} select s.y, s.x, t.tile_seq::int as tile_seq, t.x0::int as tile_x0, t.y0::int as tile_y0 from scene s join tile t on s.x >= t.x0 and s.x < t.x0 + 32 and s.y >= t.y0 and s.y < t.y0 + 32")
def t5_pixel_tiles(spark, sf_dir):
    return _tiled(spark, sf_dir, scenes.scene(spark, sf_dir).select("y", "x"))


@_query(f"with {BOXES} select id, x1 + 100 as x1, y1 + 50 as y1, x2 + 100 as x2, y2 + 50 as y2 from boxes")
def t6_translate_box(spark, sf_dir):
    rows = scenes.boxes(spark, sf_dir).select("id", geometry.translate_box(F.col("bbox"), F.lit(100), F.lit(50)).alias("b"))
    return rows.select("id", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


_CLIP = "least(300e0, greatest(0e0, x1 - 20)) as x1, least(200e0, greatest(0e0, y1 - 20)) as y1, least(300e0, greatest(0e0, x2 - 20)) as x2, least(200e0, greatest(0e0, y2 - 20)) as y2"


@_query(f"with {BOXES}, c as (select id, {_CLIP} from boxes) select * from c where x2 > x1 and y2 > y1")
def t7_clip_box(spark, sf_dir):
    moved = geometry.translate_box(F.col("bbox"), F.lit(-20), F.lit(-20))
    rows = scenes.boxes(spark, sf_dir).select("id", geometry.clip_box(moved, F.lit(300), F.lit(200)).alias("b")).filter(~geometry.is_empty(F.col("b")))
    return rows.select("id", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@_query(f"with {BOXES} select id, score from boxes where score >= 0.25e0")
def t8_score_filter(spark, sf_dir):
    return scenes.boxes(spark, sf_dir).filter(F.col("score") >= 0.25).select("id", "score")


@_query(f"with {BOXES} select id, x1 <= 2 or y1 <= 2 or x2 >= 398 or y2 >= 298 as touches_image_edge from boxes")
def t9_touches_edge(spark, sf_dir):
    return scenes.boxes(spark, sf_dir).select("id", geometry.touches_edge(F.col("bbox"), F.lit(400), F.lit(300)).alias("touches_image_edge"))


@_query(f"with {BOXES} select id, greatest(0e0, x2 - x1) * greatest(0e0, y2 - y1) as area_pixels from boxes")
def t10_box_area(spark, sf_dir):
    return scenes.boxes(spark, sf_dir).select("id", geometry.box_area(F.col("bbox")).alias("area_pixels"))


@_query(f"with {SCENE} select y, x, (red >= 100e0)::int as mask from scene")
def t11_threshold_mask(spark, sf_dir):
    return scenes.scene(spark, sf_dir).select("y", "x", (F.col("red") >= 100).cast("int").alias("mask"))


@_query(f"with {SCENE}, i as (select {_sql_index('ndvi').replace('red', 'swir2')} as v from scene) select count(v) as n, {_sql_r6('avg(v)')} as mean from i")
def t12_band_map(spark, sf_dir):
    """A given map wins over the defaults: red is read from band 6."""
    numbers = indices.resolve_bands(6, {"RED": 6})
    indices.validate(["ndvi"], numbers, 6)
    found = {n: F.col(scenes.BANDS[i - 1]) for n, i in numbers.items()}
    return _rounded(scenes.scene(spark, sf_dir).select(indices.index("ndvi", found).alias("v")).agg(F.count("v").alias("n"), F.avg("v").alias("mean")))


@_query(f"with {SCENE} select y, x, nullif(green, 7e0) as green from scene")
def t13_nodata(spark, sf_dir):
    return scenes.scene(spark, sf_dir).select("y", "x", indices.without_nodata(F.col("green"), 7.0).alias("green"))


def queries() -> dict[str, Callable]:
    """Name -> query(spark, sf_dir)."""
    from . import results  # noqa: F401  registers its queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL with the same rows."""
    from . import results  # noqa: F401

    return dict(_SQL)


