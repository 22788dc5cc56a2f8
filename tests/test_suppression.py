"""Greedy suppression: piles of boxes, many sizes, in one task and by bands, against going through boxes by rank."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraframe.operators import nms
from terraframe.plans import registry

def order():
    return [F.desc("score"), F.asc("id")]


def frame(spark, boxes):
    return spark.createDataFrame(boxes, "raster_id string, id int, score double, bbox array<double>").repartition(3)


def overlap(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    union = area(a) + area(b) - w * h
    return w * h / union if union > 0 else 0.0


def plain(boxes, threshold):
    out = set()
    for key in {b[0] for b in boxes}:
        kept = []
        for _, i, _, box in sorted((b for b in boxes if b[0] == key), key=lambda b: (-b[2], b[1])):
            if box is None or all(overlap(box, k) < threshold for k in kept):
                kept += [box] if box else []
                out.add((key, i))
    return out


def mixed(n, seed=3):
    """Piles, scattered boxes of many sizes, thin ones, points, boxes that are absent and equal ones."""
    rng = np.random.default_rng(seed)
    boxes = []
    for i in range(n):
        x, y = (rng.uniform(-500, 500, 2) if i % 3 else rng.normal(100, 3, 2)).tolist()
        w, h = (2.0 ** rng.uniform(-2, 9, 2) if i % 5 else (40.0, 30.0)) if i % 7 else (2.0 ** rng.uniform(0, 8), 0.5)
        boxes.append((["a", "b", None][i % 11 % 3], i, float(rng.integers(0, 50)), [x, y, x + float(w), y + float(h)]))
    return [*boxes, ("a", n, 7.0, None), ("b", n + 1, 7.0, [3.0, 3.0, 3.0, 3.0]), ("a", n + 2, 60.0, [-1e5, -1e5, 1e5, 1e5]), ("c", n + 3, 1.0, None)]


@pytest.mark.parametrize(("held", "threshold"), [(1 << 16, 0.3), (1 << 16, 0.02), (40, 0.3), (40, 0.9), (1 << 16, 1.0)])
def test_suppression_equals_going_by_rank(spark, monkeypatch, held, threshold):
    monkeypatch.setattr(nms, "HELD", held)
    monkeypatch.setattr(nms, "BAND", 32)
    boxes = mixed(420)
    found = [(r.raster_id, r.id) for r in nms.suppress(frame(spark, boxes), threshold, order()).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(boxes, threshold)


def test_bands_of_a_task(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(nms, "BATCH", 7)
    monkeypatch.setattr(nms, "RUN", 8)
    boxes = [b for b in mixed(500, 5) if b[0] == "a" and b[3]]
    order = sorted(boxes, key=lambda b: (-b[2], b[1]))
    table = pa.table({"raster_id": ["a"] * len(order), "rank": list(range(1, len(order) + 1)), "bbox": [b[3] for b in order]})
    gone = set(nms._settle(table.take(pa.array(np.random.default_rng(1).permutation(len(order)))), 0.2)["rank"].to_pylist())
    kept = plain(boxes, 0.2)
    assert gone == {i + 1 for i, b in enumerate(order) if ("a", b[1]) not in kept}


@pytest.mark.parametrize("held", [1 << 16, 1000])
def test_a_pile_costs_its_kept_boxes(spark, monkeypatch, held):
    """20,000 boxes in one place: few are kept, and no pair of two suppressed ones is made."""
    monkeypatch.setattr(nms, "HELD", held)
    rng = np.random.default_rng(4)
    at = rng.normal(0, 4, (20_000, 2))
    pile = pd.DataFrame({"raster_id": "a", "id": np.arange(20_000), "score": rng.random(20_000), "bbox": np.concatenate([at, at + rng.uniform(40, 60, (20_000, 2))], axis=1).tolist()})
    df = spark.createDataFrame(pile, "raster_id string, id int, score double, bbox array<double>").repartition(4)
    nms.suppress(df.limit(50), 0.3, order()).count()
    made, own = [], nms.conflicts
    monkeypatch.setattr(nms, "conflicts", lambda *a, **k: made.append(out := nms.cut(own(*a, **k))) or out)
    began = time.time()
    kept = {r.id for r in nms.suppress(df, 0.3, order()).collect()}
    took = time.time() - began
    boxes = list(pile.itertuples(index=False, name=None))
    assert {("a", i) for i in kept} == plain(boxes, 0.3)
    if held < 20_000:
        assert sum(p.count() for p in made) < nms.BAND**2 + 20_000 * len(kept)
    else:
        assert took < 10


@pytest.mark.parametrize("threshold", [0.3, 1.0])
def test_copies_of_a_box_count_once(spark, monkeypatch, threshold):
    """Keys of more boxes than a task holds, of which few are different, go without joins of pairs; boxes that don't meet themselves all stay."""
    monkeypatch.setattr(nms, "HELD", 100)
    monkeypatch.setattr(nms, "conflicts", lambda *a, **k: pytest.fail("pairs of copies"))
    rng = np.random.default_rng(8)
    places = [(0.0, 0.0, 9.0, 9.0), (-0.0, 0.0, 9.0, 9.0), *((x, y, x + w, y + h) for x, y, w, h in rng.integers(1, 20, (40, 4)).astype(float).tolist())]
    boxes = [(["a", None][i % 2], i, float(rng.integers(0, 5)), list(places[rng.integers(len(places))])) for i in range(1500)]
    alone = [[3.0, 3.0, 3.0, 9.0], [9.0, 9.0, 3.0, 3.0], [0.0, 0.0, 1e200, 1e200], None]
    boxes += [(key, len(boxes) + i, 2.0, box) for i, (key, box) in enumerate((k, b) for k in ("a", None) for b in alone * 2)]
    found = [(r.raster_id, r.id) for r in nms.suppress(frame(spark, boxes), threshold, order()).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(boxes, threshold) and len(found) > 16


def of_copies(spark, monkeypatch, folder, name):
    """Rows of a query and of its SQL over a part table of 40 boxes in 30 copies, which are more than a task holds."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(nms, "HELD", 100)
    monkeypatch.setattr(nms, "conflicts", lambda *a, **k: pytest.fail("pairs of copies"))
    table = spark.range(1200).selectExpr("id % 40 + 6000 * (id div 40) as p_partkey", "concat('b', id % 3) as p_brand", "cast(5 + id % 40 as int) as p_size")
    table.write.parquet(f"{folder}/part.parquet")
    found = registry.queries()[name](spark, str(folder))
    with duckdb.connect() as own:
        own.execute(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
        wanted = own.execute(f"select {', '.join(found.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, found.collect())), sorted(wanted)


def test_merged_detections_of_copies(spark, monkeypatch, tmp_path):
    found, wanted = of_copies(spark, monkeypatch, tmp_path, "n2_merge_detections")
    assert found == wanted and 3 <= sum(r[1] for r in found) <= 40


def test_assembled_detections_of_copies(spark, monkeypatch, tmp_path):
    found, wanted = of_copies(spark, monkeypatch, tmp_path, "n3_detection_assembly")
    assert found == wanted and 3 <= len(found) <= 40


def every_box(spark, monkeypatch, folder, name):
    """Rows of a query over part with each of the 1,200 places in each of 50 sizes, 60,000 boxes, and 36,000 copies; ids, scores and boxes."""
    monkeypatch.setattr(nms, "conflicts", lambda *a, **k: pytest.fail("a task holds all different boxes"))
    k = np.arange(96_000)
    table = spark.range(len(k)).selectExpr("id as p_partkey", "concat('b', id % 3) as p_brand", "cast(1 + id div 1200 % 50 as int) as p_size")
    table.write.parquet(f"{folder}/part.parquet")
    place, side = np.stack([k * 37 % 400, k * 91 % 300], axis=1), (1 + k // 1200 % 50)[:, None]
    return registry.queries()[name](spark, str(folder)).collect(), k, k * 7919 % 1000 / 1000, np.concatenate([place, place + side], axis=1).astype(float)


def kept_by_rank(boxes, threshold):
    """Places in the order of ranks that are kept, each box held against all kept before it."""
    held, kept = np.empty((5, len(boxes))), []
    for i, (x0, y0, x1, y1) in enumerate(boxes.tolist()):
        a, area = held[:, : len(kept)], (x1 - x0) * (y1 - y0)
        inter = np.maximum(0, np.minimum(a[2], x1) - np.maximum(a[0], x0)) * np.maximum(0, np.minimum(a[3], y1) - np.maximum(a[1], y0))
        if not (inter >= threshold * (a[4] + area - inter)).any():
            held[:, len(kept)] = x0, y0, x1, y1, area
            kept.append(i)
    return np.array(kept)


def test_merged_detections_of_every_box(spark, monkeypatch, tmp_path):
    found, ids, score, boxes = every_box(spark, monkeypatch, tmp_path, "n2_merge_detections")
    assert len(np.unique(boxes, axis=0)) == 60_000 <= nms.HELD < len(ids)
    order = np.lexsort((ids, -score))
    kept = order[kept_by_rank(boxes[order], 0.5)]
    wanted = {(f"b{i}", int((kept % 3 == i).sum()), float(score[kept][kept % 3 == i].max())) for i in range(3)}
    assert len(kept) > 1000 and set(map(tuple, found)) == wanted and len(found) == 3


def test_assembled_detections_of_every_box(spark, monkeypatch, tmp_path):
    found, ids, score, boxes = every_box(spark, monkeypatch, tmp_path, "n3_detection_assembly")
    boxes = np.minimum(boxes + [10, 5, 10, 5], [400, 300, 400, 300])
    some = (score >= 0.2) & (boxes[:, :2] < boxes[:, 2:]).all(axis=1)
    ids, score, boxes = ids[some], score[some], boxes[some]
    assert len(np.unique(boxes, axis=0)) <= nms.HELD < len(ids)
    order = np.lexsort((ids, -score))
    kept = kept_by_rank(boxes[order], 0.5)
    sides = boxes[order[kept], 2:] - boxes[order[kept], :2]
    wanted = set(zip(ids[order[kept]].tolist(), (order[kept] + 1).tolist(), (kept + 1).tolist(), sides.prod(axis=1).tolist(), strict=True))
    assert len(kept) > 1000 and {(r.id, r.instance_id, r["rank"], r.area_pixels) for r in found} == wanted and len(found) == len(wanted)
