import json

import pytest

from terraframe import model
from terraframe.operators import change
from terraframe.sources import geoparquet, wkb


def test_replacements_in_a_circle_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "id long, keep long")
    assert {r["keep"] for r in change.resolve(chain).collect()} == {20}
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "id long, keep long")
    with pytest.raises(ValueError, match="circle"):
        change.resolve(circle)


ROAD = {"highway": "residential"}


def test_crossing_ways_get_a_node(spark):
    nodes = [(1, 0.0, 0.0, {}), (2, 0.002, 0.002, {}), (3, 0.0, 0.002, {}), (4, 0.002, 0.0, {}), (5, 0.0, 0.0005, {}), (6, 0.002, 0.0005, {}), (7, 0.0015, 0.0015, {}), (8, 0.003, 0.0015, {})]
    ways = [(1, [1, 2], ROAD), (2, [3, 4], ROAD), (3, [5, 6], ROAD), (4, [7, 8], ROAD), (5, [3, 4], {"waterway": "river"})]
    out = change.create_intersections(model.from_rows(spark, nodes, ways))
    refs = {r["id"]: list(r["refs"]) for r in out.ways.collect()}
    made = {r["id"]: (r["lon_e7"], r["lat_e7"], r["tags"]) for r in out.nodes.collect() if r["id"] > 8}
    assert sorted(x[:2] for x in made.values()) == [(5000, 5000), (10000, 10000), (15000, 5000)] and all(x[2] == {"crossing": "yes"} for x in made.values())
    by = {v[:2]: k for k, v in made.items()}
    a, b, c = by[5000, 5000], by[10000, 10000], by[15000, 5000]
    assert refs == {1: [1, a, b, 7, 2], 2: [3, b, c, 4], 3: [5, a, c, 6], 4: [7, 8], 5: [3, 4]}
    again = change.create_intersections(out)
    assert {r["id"]: list(r["refs"]) for r in again.ways.collect()} == refs


def test_merge_connects_base_and_patch(spark):
    base = model.from_rows(spark, [(1, 0.0, 0.0, {}), (2, 0.002, 0.002, {})], [(1, [1, 2], ROAD)])
    patch = model.from_rows(spark, [(13, 0.0, 0.002, {}), (14, 0.002, 0.0, {}), (15, 0.002, 0.002, {})], [(12, [13, 14, 15], ROAD)])
    out = change.merge(base, patch)
    refs = {r["id"]: list(r["refs"]) for r in out.ways.collect()}
    assert refs == {1: [1, 16, 15], 12: [13, 16, 14, 15]} and {r["id"] for r in out.nodes.collect()} == {1, 13, 14, 15, 16}
    assert {r["id"]: len(r["refs"]) for r in change.merge(base, patch, intersections=False).ways.collect()} == {1: 2, 12: 3}


SQUARE = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
HOLE = [[0.2, 0.2], [0.4, 0.2], [0.4, 0.4], [0.2, 0.2]]
SHAPES = [("Point", [2.0, 3.0], "node"), ("LineString", [[0.0, 0.0], [5.0, 5.0]], "way"), ("Polygon", [SQUARE], "way"), ("Polygon", [SQUARE, HOLE], "relation"), ("MultiLineString", [[[7.0, 7.0], [8.0, 8.0]], [[9.0, 9.0], [9.0, 8.0]]], "relation"), ("Polygon", [SQUARE, HOLE], "way")]


@pytest.mark.parametrize("form", ["wkb", "text"])
def test_geoparquet(spark, tmp_path, form):
    shape = lambda k, c: wkb.build(k, c) if form == "wkb" else json.dumps({"type": k, "coordinates": c})
    rows = [(100 + i, entity, {"name": f"n{i}", "none": None}, shape(k, c), "unread") for i, (k, c, entity) in enumerate(SHAPES)]
    rows.append((999, "node", None, b"bad" if form == "wkb" else "bad", None))
    path = str(tmp_path / "shapes.parquet")
    spark.createDataFrame(rows, f"osm long, type string, tags map<string,string>, geom {'binary' if form == 'wkb' else 'string'}, other string").coalesce(1).write.parquet(path)
    ds = geoparquet.read(spark, path, id_col="osm", geometry_col="geom")
    ways = {r["id"]: (list(r["refs"]), r["tags"]) for r in ds.ways.collect()}
    relations = {r["id"]: (r["members"], r["tags"]) for r in ds.relations.collect()}
    assert {r["id"] for r in ds.nodes.collect() if r["id"] > 0} == {100}
    assert {i for i in ways if i > 0} == {101, 102, 105} and set(relations) == {103, 104}
    assert ways[102][0][0] == ways[102][0][-1] and len(ways[102][0]) == 5 == len(ways[105][0]) and ways[102][1] == {"name": "n2", "area": "yes"}
    assert relations[103][1] == {"name": "n3", "type": "multipolygon"} and [m["role"] for m in relations[103][0]] == ["outer", "inner"]
    assert relations[104][1] == {"name": "n4", "type": "multilinestring"} and [ways[m["ref"]][1] for m in relations[104][0]] == [{}, {}]
    assert all(r["id"] != 999 for r in ds.nodes.collect())


def test_geoparquet_refuses_collections(spark, tmp_path):
    path = str(tmp_path / "points.parquet")
    spark.createDataFrame([(1, wkb.build("MultiPoint", [[1.0, 2.0]]))], "id long, geometry binary").write.parquet(path)
    with pytest.raises(Exception, match="not supported"):
        geoparquet.read_features(spark, path).collect()
