"""Collections of features by ranges of bytes: borders anywhere, strings that look like structure, both envelopes."""

import json
import random

import pytest

from terraframe.sources import features

ODD = ['a "quoted" {name}', "]}[{", "back\\slash\\\\", 'end\\"', "\\", "ü日本\U0001f642", "", '"features": [{']


def collection(n, envelope="features", first=True, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ring = [[rng.randrange(9), 0.5], [1e3, rng.random()], [2.0, 3.0], [rng.randrange(9), 0.5]]
        named = {"label": rng.choice(ODD), "score": round(rng.random(), 6), "class_id": i, "nested": {"features": [{"a": [1, {"b": "]"}]}]}}
        rows.append({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": named} if i % 3 else {"geometry": {"type": "Point", "coordinates": [1, 2]}, **named})
    more = {"type": "FeatureCollection", "crs": {"properties": {"name": "x{[\\", "list": [[1], {"y": 2}]}}, "bbox": [1, 2], "other": [{"label": "no feature"}]}
    return ({**{envelope: rows}, **more} if first else {**more, envelope: rows}), rows


def told(row):
    own = row.get("properties") or row
    ring = [(float(x), float(y)) for x, y in row["geometry"]["coordinates"][0]] if row["geometry"]["type"] == "Polygon" else []
    return own["label"], own["score"], own["class_id"], ring


@pytest.mark.parametrize(("size", "indent", "envelope", "first"), [(7, None, "features", True), (33, 1, "features", False), (64, None, "records", True), (1 << 20, 2, "records", False), (101, None, "features", False)])
def test_ranges_equal_the_whole(spark, tmp_path, size, indent, envelope, first):
    whole, rows = collection(12 if size < 50 else 60, envelope, first)
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps(whole, indent=indent, ensure_ascii=size % 2 == 0), encoding="utf-8")
    found = [(r.label, r.score, r.class_id, [(p.x, p.y) for p in r.ring]) for r in features.read_features(spark, str(path), size).collect()]
    assert found == [told(r) for r in rows]


@pytest.mark.parametrize("text", ["{}", "", "[]", "[[{}]]", '[{"features": [{"label": "x"}]}]', '{"features": []}', '{"features": null, "a": {"features": [{"label": "x"}]}}', '{"features": [], "records": [{"label": "x"}]}'])
def test_other_envelopes_have_no_features(spark, tmp_path, text):
    path = tmp_path / "f.json"
    path.write_text(text)
    assert features.read_features(spark, str(path), 5).collect() == []


def test_both_arrays(spark, tmp_path):
    path = tmp_path / "f.json"
    path.write_text('{"records": [{"label": "r"}], "features" : \n [{"label": "f"}, {"label": "g"}]}')
    assert [r.label for r in features.read_features(spark, str(path), 6).collect()] == ["f", "g"]
    path.write_text('{"features": null, "records": [{"label": "r"}]}')
    assert [r.label for r in features.read_features(spark, str(path), 6).collect()] == ["r"]


def test_a_large_file_is_read_in_many_tasks(spark, tmp_path):
    path, rows = tmp_path / "large.geojson", collection(500)[1]
    text = ",".join(json.dumps(r) for r in rows)
    with open(path, "w", encoding="utf-8") as file:
        file.write('{"type": "FeatureCollection", "features": [' + ",".join([text] * 300) + "]}")
    found = features.read_features(spark, str(path))
    assert path.stat().st_size > 2 * features.RANGE and found.rdd.getNumPartitions() == -(-path.stat().st_size // features.RANGE)
    assert found.count() == 150_000 and {r["n"] for r in found.groupBy("class_id").count().withColumnRenamed("count", "n").collect()} == {300}


def test_a_collection_written_by_tasks(spark, tmp_path):
    path, rows = tmp_path / "out.geojson", collection(300, seed=4)[1]
    table = spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)], "i long, feature string").repartition(7)
    features.write_collection(table.orderBy("i"), str(path), "EPSG:3857")
    whole = json.loads(path.read_text(encoding="utf-8"))
    assert whole["features"] == rows and whole["crs"]["properties"]["name"] == "EPSG:3857"
    assert [r.label for r in features.read_features(spark, str(path), 999).collect()] == [told(r)[0] for r in rows]
    features.write_collection(table.filter("i < 0"), str(path))
    assert json.loads(path.read_text()) == {"type": "FeatureCollection", "features": []}
    features.write_collection(table.repartition(40, "i").filter("i = 3"), str(path))  # most tasks have none
    assert json.loads(path.read_text())["features"] == [rows[3]] and [p.name for p in tmp_path.iterdir()] == ["out.geojson"]
