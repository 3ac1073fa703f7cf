"""Whole results of the map queries, by hand or against brute force."""

import inspect
import math

import pytest
from pyspark.sql import functions as F

from terraframe import model
from terraframe.operators import graph, tiles
from terraframe.plans import lookup, roads
from terraframe.sources import pbf


def test_tiles_draw_relations(spark):
    nodes = [(i, x, y, {}) for i, x, y in ((1, 0.001, 0.001), (2, 0.009, 0.001), (3, 0.009, 0.009), (4, 0.001, 0.009), (5, 0.004, 0.004), (6, 0.006, 0.004), (7, 0.005, 0.006))]
    ways = [(1, [1, 2, 3], {}), (2, [3, 4, 1], {}), (3, [5, 6, 7, 5], {}), (4, [1, 5], {"highway": "path"}), (5, [2, 6], {"highway": "path"})]
    relations = [(1, [("way", 1, "outer"), ("way", 2, "outer"), ("way", 3, "inner")], {"type": "multipolygon"}), (2, [("way", 4, "")], {"type": "route"}), (3, [("node", 1, ""), ("node", 3, "")], {"type": "multipoint"}), (4, [("node", 1, "")], {})]
    ds = model.from_rows(spark, nodes, ways, relations)
    got = {(r["layer"], r["id"]) for r in tiles.features(ds, 14).collect()}
    assert got == {("ways", 5), ("relations", 1), ("relations", 2), ("relations", 3)}
    rows = tiles.vector_tiles(ds, 14).collect()
    assert len(rows) == 1 and rows[0]["features"] == 4
    found = {}
    for number, layer in pbf.fields(rows[0]["tile"]):
        fields = list(pbf.fields(layer))
        name = next(v for k, v in fields if k == 1).decode()
        for feature in (dict(pbf.fields(v)) for k, v in fields if k == 2):
            found[name, feature[1] >> 1] = (feature[3], pbf.packed(feature[4]))
    assert {k: v[0] for k, v in found.items()} == {("ways", 5): 2, ("relations", 1): 3, ("relations", 2): 2, ("relations", 3): 1}
    commands = found["relations", 1][1]
    assert sum(c == 15 for c in commands) == 2 and commands[0] == 9 and found["relations", 3][1][0] == 1 | 2 << 3
    assert tiles.relation_parts(ds).where("id = 1").select(F.size("lines")).first()[0] == 2


def test_distances_are_final_or_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0, 1.0) for i in range(1, 6)], "src long, dst long, distance float, time float")
    with pytest.raises(ValueError, match="not final"):
        graph.distances(edges, 1, rounds=3)
    assert {r["node"]: r["cost"] for r in graph.distances(edges, 1, rounds=5).collect()} == {i: (i - 1) * 1000 for i in range(1, 7)}
    assert inspect.signature(graph.distances).parameters["rounds"].default is None


def test_nearest_ways(spark):
    lon, lat = 7.42, 43.74
    spots = {1: (0, 0), 2: (0.001, 0), 3: (-0.002, 0.0001), 4: (0, 0.003), 5: (0.004, 0.004)}
    nodes = [(k * 10 + i, lon + x + d, lat + y + d, {}) for k, (x, y) in spots.items() for i, d in ((0, -0.0001), (1, 0.0001))]
    ds = model.from_rows(spark, nodes, [(k, [k * 10, k * 10 + 1], {}) for k in spots])
    got = [(r["way_id"], r["meters"]) for r in lookup.knn_ways(ds).where("spot = 'inside'").collect()]

    def meters(x, y):
        x, y = math.radians(max(abs(x) - 0.0001, 0)), math.radians(max(abs(y) - 0.0001, 0))
        a = math.radians(lat)
        return 2 * 6371008.8 * math.asin(math.sqrt(math.sin(y / 2) ** 2 + math.cos(a) * math.cos(a + y) * math.sin(x / 2) ** 2))

    want = sorted((meters(*p), k) for k, p in spots.items())
    assert [k for k, _ in got] == [k for _, k in want] and got[0][1] == 0
    assert all(abs(a - b) < 0.5 for (_, a), (b, _) in zip(got, want))


def test_all_layers_and_strings(spark):
    nodes = [(i, i / 10, i / 10 * (i % 2), {"note": "n1"} if i == 1 else {}) for i in range(1, 4)]
    ways = [(1, [1, 2, 3, 1], {"building": "yes"}), (2, [1, 2, 3, 1], {"natural": "water"}), (3, [1, 2], {"highway": "primary"})]
    ds = model.from_rows(spark, nodes, ways, [(1, [("way", 1, "outer")], {"type": "multipolygon"})])
    got = {(r["layer"], r["kind"], r["n"]) for r in roads.layer_features(ds).collect()}
    assert {("buildings", "building", 1), ("water", "water", 1), ("streets", "primary", 1)} <= got
    want = sorted({"note", "n1", "building", "yes", "natural", "water", "highway", "primary", "type", "multipolygon", "outer"})
    assert sorted((r["code"], r["s"]) for r in lookup.string_table(ds).collect()) == list(enumerate(want, 1))
