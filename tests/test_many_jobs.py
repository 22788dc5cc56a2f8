"""Manifests of many jobs as a table, and models over tiles from SQL."""

import json
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.functions import tiles
from terraframe.operators import adapters, jobs
from terraframe.sources import scenes


def test_flags_of_ten_thousand_manifests(spark, tmp_path):
    rng, wanted, counts = np.random.default_rng(2), Counter(), {}
    for i in range(10_000):
        found = [{"code": f"c{rng.integers(5)}", "severity": ["info", "warning"][int(rng.integers(2))], "message": f"m{i}"} for _ in range(rng.integers(3))]
        task = ["detection", "change"][i % 2]
        body = {"job_id": f"j{i}", "task": task, "status": "success", "statistics": {"count": i, "by": {"class": [i % 7, "x"]}} if i % 10 else {"count": "none"}, "quality_flags": found}
        (tmp_path / f"j{i}.json").write_text(json.dumps(body))
        wanted.update((task, f["code"], f["severity"]) for f in found)
        counts[f"j{i}"] = i if i % 10 else None
    (tmp_path / "broken.json").write_text('{"job_id": ')
    (tmp_path / "other.txt").write_text("no record")
    table = jobs.JobStore(str(tmp_path)).table(spark).cache()
    assert table.count() == 10_001
    by_code = jobs.flags(table).groupBy("task", "code", "severity").count()
    assert {tuple(r)[:3]: r["count"] for r in by_code.collect()} == wanted
    table.createOrReplaceTempView("manifests")
    sql = spark.sql("""select f.code, count(*) as n from manifests lateral view explode(try_variant_get(body, '$.quality_flags', 'array<struct<code:string,severity:string>>')) t as f
        where variant_get(body, '$.task', 'string') = 'change' and f.severity = 'warning' group by f.code""")
    assert {r.code: r.n for r in sql.collect()} == {c: n for (t, c, s), n in wanted.items() if (t, s) == ("change", "warning")}
    got = jobs.values(table, n="$.statistics.count long", first="$.statistics.by.class[0] int").collect()
    assert {r.job_id: r.n for r in got if r.job_id} == counts and sum(r.job_id is None for r in got) == 1
    assert {r.first for r in got if r.job_id == "j25"} == {25 % 7}


def test_records_of_a_store(spark, tmp_path):
    store = jobs.JobStore(str(tmp_path / "jobs"))
    store.submit("detection", lambda folder: jobs.build_manifest("detection", folder, {}, {}, {}, {"count": 3}, [{"code": "a", "severity": "info", "message": "b"}]))
    with pytest.raises(RuntimeError):
        store.submit("change", lambda folder: (_ for _ in ()).throw(RuntimeError("broken")))
    rows = jobs.values(store.table(spark), n="$.statistics.count long").collect()
    assert sorted((r.task, r.status, r.n) for r in rows) == [("change", "failed", None), ("detection", "success", 3)]
    assert [r.code for r in jobs.flags(store.table(spark)).collect()] == ["a"]


def test_models_from_sql(spark, tmp_path):
    class Peaks(adapters.Adapter):
        """A box for each sample above 200; notes when it is loaded."""

        def __init__(self, folder):
            self.folder = folder

        def load(self):
            with open(os.path.join(self.folder, f"{os.getpid()}"), "a") as file:
                file.write("load ")

        def predict(self, tile, info):
            for y, x in zip(*np.nonzero(tile[0] > 200), strict=True):
                yield {"label": "peak", "score": float(tile[0, y, x]) / 255, "class_id": 2, "bbox": (x - 1, y - 1, x + 2, y + 2), "polygon": [(x, y), (x + 1, y), (x, y + 1)]}

    size = (50, 40)
    pixels = scenes.synthetic(spark, *size, 2).withColumn("b1", F.when((F.col("x") * 7 + F.col("y") * 3) % 97 == 0, 201 + F.col("x") % 50).otherwise(0))
    make = lambda: Peaks(str(tmp_path))
    wanted = adapters.detect(pixels, ["b1", "b2"], size, make, tile=16, overlap=4, score=0.85)
    adapters.register(spark, "detect_peaks", make, ["b1", "b2"], size)
    tiles.assign(pixels, *size, 16, 4).select("tile_seq", "tile_x0", "tile_y0", "y", "x", "b1", "b2").createOrReplaceTempView("tiles")
    found = spark.sql("select * from detect_peaks(table(tiles) partition by (tile_seq), 0.85)")
    assert found.schema == wanted.schema
    rows = sorted(map(str, found.collect()))
    assert rows == sorted(map(str, wanted.collect())) and len(rows) > 20
    assert spark.sql("select * from detect_peaks(table(select * from tiles where b1 < 0) partition by (tile_seq), 0)").count() == 0
    best = spark.sql("select label, count(*) as n, max(score) as best from detect_peaks(table(tiles) partition by (tile_seq), 0.9) group by label")
    assert best.collect()[0].n == sum(r.score >= 0.9 for r in wanted.collect())
    assert all(set(p.read_text().split()) == {"load"} for p in tmp_path.iterdir())
