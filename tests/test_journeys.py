"""Paths, edits, partial reads, archives and display, by hand."""

import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terraframe import model
from terraframe.functions import color
from terraframe.operators import change, extract, graph, labels
from terraframe.sources import files, geojson, gtfs

EDIT = "seq int, entity_type string, id long, op string, body string"


def test_a_path_in_stretches(spark):
    path = spark.createDataFrame([(1, 0, 10, None, None, 0.0), (1, 1, 11, 5, 10, 1.0), (1, 2, 12, 6, 11, 2.0), (1, 3, 13, 7, 12, 3.0), (2, 0, 10, None, None, 0.0)], graph.PATH)
    edges = spark.createDataFrame([(10, 11, 5, 1, 9.0, 9.0), (10, 11, 5, 0, 1.0, 2.0), (11, 12, 6, 0, 3.0, 4.0), (12, 13, 7, 0, 5.0, 6.0)], "src long, dst long, way_id long, seq int, distance float, time float")
    ways = spark.createDataFrame([(5, [], {"name": "A", "highway": "primary"}), (6, [], {"name": "A"}), (7, [], {"name": "", "highway": "service"})], model.WAY_SCHEMA)
    assert {tuple(r) for r in graph.statistics(path, edges).collect()} == {(1, 9.0, 12.0), (2, 0.0, 0.0)}
    got = [tuple(r) for r in graph.route_info(path, edges, ways).orderBy("query", "segment").collect()]
    assert got == [(1, 1, "A", "primary", [5, 6], 4.0, 6.0, None), (1, 2, "", "service", [7], 5.0, 6.0, 12)]
    marks = graph.marked_nodes(path, spark.createDataFrame([(12,)], "id long")).orderBy("query", "ord").collect()
    assert [tuple(r) for r in marks] == [(1, 1, 10), (1, 2, 11), (1, 3, 12), (1, 4, 13), (2, 1, 10)]


def test_edits_fold(spark):
    base = spark.createDataFrame([("node", i, f"n{i}") for i in range(1, 5)], "entity_type string, id long, body string")
    edits = [(1, 1, "modify", "a"), (2, 1, "modify", "b"), (3, 2, "modify", "c"), (4, 2, "delete", None), (5, 3, "delete", None), (6, 3, "create", "d"), (7, 3, "modify", "e"), (8, 9, "create", "f"), (9, 9, "delete", None)]
    got = change.fold(base, spark.createDataFrame([(s, "node", i, o, b) for s, i, o, b in edits], EDIT)).collect()
    assert {tuple(r)[1:] for r in got} == {(1, "modify", "b", "n1"), (2, "delete", "n2", "n2"), (3, "create", "e", None), (9, "delete", None, None)}
    for wrong in ([(1, "node", 7, "modify", "x")], [(1, "node", 1, "delete", None), (2, "node", 1, "modify", "x"), (3, "node", 1, "create", "y")]):
        with pytest.raises(PySparkException, match="cannot modify"):
            change.fold(base, spark.createDataFrame(wrong, EDIT)).collect()
    assert change.fold(base, spark.createDataFrame([], EDIT)).count() == 0


def test_summary(spark):
    stats = spark.createDataFrame([(1500, 1200, 300, 0), (0, 0, 0, 0)], "total long, node_changes long, way_changes long, relation_changes long")
    assert [r["summary"] for r in change.change_summary(stats).collect()] == ["Changeset summary:  total changes: 1,500,  node changes: 1,200,  way changes: 300", "Changeset is empty."]


def test_augmented_changes(spark):
    base = model.from_rows(spark, [(1, 0.0, 0.0, {}), (2, 1.0, 1.0, {})])
    patch = model.from_rows(spark, [(1, 0.5, 0.0, {}), (3, 2.0, 2.0, {})])
    every = change.direct_changes(base, patch).unionByName(change.deletions(base, patch))
    got = {r["section"]: r["xml"] for r in change.osc_rows(base, patch, every, augmented=True).collect()}
    assert got["create"].startswith('<node id="3"') and got["delete"].startswith('<old><node id="2"') and "<new>" not in got["delete"]
    assert got["modify"].startswith("<old><node") and got["modify"].count('<node id="1"') == 2 and got["modify"].endswith("</new>")


def test_partial_read(spark):
    ds = model.from_rows(spark, [(1, 0.1, 0.1, {}), (2, 0.2, 0.2, {"a": "b"}), (3, 5.0, 5.0, {})], [(1, [1, 3, 2, 3], {"highway": "path"}), (2, [3], {"highway": "path"}), (3, [1, 2], {})], [(1, [("way", 1, "x"), ("way", 3, ""), ("relation", 2, ""), ("node", 3, "")], {}), (2, [("way", 2, "")], {})])
    out = extract.ingest(ds, (0, 0, 1, 1), {"ways": [("highway", None)]})
    assert {r["id"] for r in out.nodes.collect()} == {1, 2}
    assert [(r["id"], r["refs"]) for r in out.ways.collect()] == [(1, [1, 2])]
    assert [(r["id"], [m["ref"] for m in r["members"]]) for r in out.relations.collect()] == [(1, [1])]
    whole = extract.ingest(ds, rules={"nodes": [("a", None)]}, accept={"ways": F.size("refs") > 1})
    assert whole.nodes.count() == 1 and {r["id"] for r in whole.ways.collect()} == {1, 3} and whole.relations.count() == 2


def test_files_by_name(spark, tmp_path):
    assert [files.kind_of(n) for n in ("a.GeoJSON", "a.json", "a.zip", "a.parquet", "a.osm.pbf", "a")] == ["geojson", "geojson", "shapefile", "geoparquet", "pbf", "pbf"]
    path = str(tmp_path / "feed.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("f/agency.txt", "agency_id\n1\n")
        z.writestr("f/stops.txt", '﻿stop_id,stop_name,stop_lat,stop_lon\n1,"A, ""B""",1.5,2.5\n\n2,C,,\n')
        z.writestr("f/routes.txt", "route_id,route_long_name,route_type\n7,R,3\n")
        z.writestr("f/trips.txt", "trip_id,route_id,shape_id\nt2,7,s\nt1,7,s\n")
        z.writestr("f/stop_times.txt", "trip_id\n")
        z.writestr("f/shapes.txt", "shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\ns,2,1,1\ns,1,0,0\n")
    assert gtfs.is_feed(gtfs.zip_names(spark, path)) and not gtfs.is_feed(["stops.txt"])
    out = files.read(spark, path)
    ways = out.ways.collect()
    assert len(ways) == 1 and len(ways[0]["refs"]) == 2 and ways[0]["tags"]["gtfs:trip_ids"] == "t1;t2"
    assert [r["tags"]["name"] for r in out.nodes.where("size(tags) > 0").collect()] == ['A, "B"']


def test_relations_as_geojson(spark):
    nodes = [(i, x, y, {}) for i, x, y in ((1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0), (4, 2.0, 2.0))]
    ways = [(1, [1, 2], {}), (2, [2, 3, 1], {}), (3, [3, 4], {})]
    relations = [(1, [("way", 1, "outer"), ("way", 2, "outer")], {"type": "multipolygon"}), (2, [("way", 1, ""), ("way", 3, "")], {"type": "route"}), (3, [("node", 4, ""), ("node", 9, "")], {"type": "multipoint"}), (4, [("way", 1, "outer")], {"type": "boundary"}), (5, [("node", 1, "")], {"a": "b"}), (6, [("way", 3, "")], {"type": "route"})]
    got = {r["id"]: json.loads(r["feature"]) for r in geojson.relation_features(model.from_rows(spark, nodes, ways, relations)).collect()}
    shape = {k: v["geometry"] for k, v in got.items()}
    assert shape[1] == {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]}
    assert shape[2] == {"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [1.0, 0.0]], [[1.0, 1.0], [2.0, 2.0]]]}
    assert shape[3] == {"type": "Point", "coordinates": [2.0, 2.0]} and shape[4] == {"type": "MultiPolygon", "coordinates": []}
    assert shape[5] == {"type": "GeometryCollection", "geometries": []} and shape[6]["type"] == "LineString"
    assert got[1]["properties"] == {"type": "multipolygon"}


def test_display(spark):
    pixels = lambda *p: F.array(*[F.struct(*[F.lit(v).cast("int").alias(c) for c, v in zip("rgba", x)]) for x in p])
    mixed = [color.composite(p) for p in (pixels((255, 0, 0, 255), (0, 0, 255, 128)), pixels((9, 9, 9, 0)), pixels((10, 20, 30, 255), (None, 1, 1, 255)))]
    lines = [F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p]) for p in ([(0, 0), (3, 4), (3, 10)], [(1, 2)])]
    r = spark.range(1).select(*[m.alias(f"m{i}") for i, m in enumerate(mixed)], labels.line_length(lines[0]).alias("n"), labels.line_midpoint(lines[0]).alias("p"), labels.line_midpoint(lines[1]).alias("q")).first()
    assert tuple(r["m0"]) == (187, 0, 188, 255) and tuple(r["m1"]) == (0, 0, 0, 0) and tuple(r["m2"]) == (10, 20, 30, 255)
    assert r["n"] == 11.0 and tuple(r["p"]) == (3.0, 4.5) and tuple(r["q"]) == (1.0, 2.0)
    c = spark.createDataFrame([("road", "A", 1, 5, "b"), ("road", "a", 1, 5, "a"), ("water", "A", 1, 1, "c"), ("place", "A", 2, 1, "d"), ("place", "A", 2, 1, "d")], "kind string, text string, priority int, length int, key string")
    assert [r["key"] for r in labels.in_order(labels.best_lines(c)).collect()] == ["d", "d", "a", "c"]
