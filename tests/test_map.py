"""Operators on small maps, and codecs by round trips."""

import itertools
import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from terraframe import model
from terraframe.functions import geo, layers, text
from terraframe.functions import tags as T
from terraframe.operators import change, extract, geometry, graph, joins, spatial, tiles
from terraframe.sources import geojson, gtfs, pbf, wkb


@pytest.fixture(scope="module")
def square(spark):
    """Four corners with a diagonal over the middle."""
    nodes = [(1, 0, 0, {}), (2, 0.01, 0, {}), (3, 0, 0.01, {}), (4, 0.01, 0.01, {}), (5, 0.005, 0.005, {})]
    ways = [(1, [1, 2], {"highway": "primary"}), (2, [1, 3], {"highway": "primary"}), (3, [3, 4], {"highway": "primary"}), (4, [2, 4], {"highway": "primary"}), (5, [1, 5, 4], {"highway": "secondary"})]
    return model.from_rows(spark, nodes, ways)


def test_routes(spark, square):
    queries = spark.createDataFrame([(0, 1, 4), (1, 4, 1), (2, 2, 2), (3, 1, 99)], "query long, start long, goal long")
    e = graph.edges(square)
    assert e.count() == 12
    for algorithm in ("dijkstra", "astar"):
        path = graph.route(square, e, queries, algorithm).orderBy("query", "seq").collect()
        assert [r["node"] for r in path if r["query"] == 0] == [1, 5, 4]
        assert [r["node"] for r in path if r["query"] == 2] == [2]
        assert not [r for r in path if r["query"] == 3]
    assert [r["node"] for r in graph.route(square, e, queries, "bidirectional").where("query = 0").orderBy("seq").collect()][::2][0] == 1
    cost = {r["node"]: r["cost"] for r in graph.distances(e, 1).collect()}
    assert set(cost) == {1, 2, 3, 4, 5} and abs(cost[4] / 1000 - 2 * cost[5] / 1000) < 1
    names = graph.route_segments(graph.route(square, e, queries, "dijkstra"), square.ways).where("query = 0").collect()
    assert [(r["name"], r["first"], r["last"]) for r in names] == [("secondary", 1, 2)]


def test_search_on_edge_lists():
    both = lambda es: {a: [(y, w, c) for x, y, w, c in es + [(y, x, w, c) for x, y, w, c in es] if x == a] for a in {n for x, y, *_ in es for n in (x, y)}}
    indirect = both([(1, 4, 9, 100), (1, 2, 1, 10), (2, 3, 2, 10), (3, 4, 3, 10)])
    assert graph.search(indirect, 1, 4)[-1] == (4, 3, 3, 30)
    assert graph.search(both([(1, 2, 1, 10), (2, 3, 2, 10)]), 1, 4) is None
    assert [p[0] for p in graph.meeting(indirect, 1, 4)] == [1, 4]


def test_snap(square):
    assert graph.snap(square, 0.0001, 0.0001, 100).collect()[0]["id"] == 1
    assert graph.snap(square, 1.0, 1.0, 100).count() == 0


def test_boxes_over_the_antimeridian(spark):
    ds = model.from_rows(spark, [(1, 179.9, 0, {}), (2, -179.9, 0, {}), (3, 0, 0, {}), (4, 160, 89.9, {}), (5, -20, 89.9, {})])
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(spatial.nodes_in_box(ds.nodes, (179, -1, -179, 1))) == [1, 2]
    assert ids(spatial.nodes_in_box(ds.nodes, (-1, 1, 1, -1))) == []
    assert ids(spatial.nodes_within(ds.nodes, 179.95, 0, 20)) == [1, 2]
    assert ids(spatial.nodes_within(ds.nodes, 70, 90, 20)) == [4, 5]
    assert ids(spatial.nodes_within(ds.nodes, 0, 0, math.inf)) == [1, 2, 3, 4, 5]
    assert ids(spatial.nodes_within(ds.nodes, 0, 0, -1)) == []
    with pytest.raises(ValueError):
        spatial.nodes_within(ds.nodes, 0, 91, 1)


def test_extracts(spark):
    ds = model.from_rows(spark, [(1, 0, 0, {"name": "inside-a"}), (2, 2, 0, {}), (3, 0.5, 0.5, {}), (4, 1.5, 0.5, {})], [(10, [1, 2], {"highway": "residential"}), (11, [3, 4], {"highway": "service"}), (12, [2, 4], {})], [(20, [("way", 10, "outer"), ("way", 12, "inner")], {"type": "multipolygon"}), (21, [("relation", 20, "")], {}), (22, [("way", 12, "")], {})])
    box = (-0.1, -0.1, 1, 1)
    got = {s: extract.extract(ds, box, s) for s in extract.STRATEGIES}
    ids = lambda df: sorted(r["id"] for r in df.collect())
    refs = lambda d: {r["id"]: list(r["refs"]) for r in d.ways.collect()}
    members = lambda d: {r["id"]: [m["ref"] for m in r["members"]] for r in d.relations.collect()}
    assert ids(got["simple"].nodes) == [1, 3] and refs(got["simple"]) == {10: [1], 11: [3]}
    assert members(got["simple"]) == {20: [10], 21: [20]}
    assert ids(got["complete_ways"].nodes) == [1, 2, 3, 4] and refs(got["complete_ways"]) == {10: [1, 2], 11: [3, 4]}
    assert members(got["smart"]) == {20: [10, 12], 21: [20]} and sorted(refs(got["smart"])) == [10, 11, 12]


def test_closure_ends_on_cycles(spark):
    ds = model.from_rows(spark, relations=[(1, [("relation", 2, ""), ("node", 1, "")], {}), (2, [("way", 10, ""), ("node", 2, ""), ("relation", 1, "")], {})])
    found = {(r["type"], r["ref"]) for r in joins.closure(ds).where("relation_id = 1").collect()}
    assert found == {("relation", 2), ("node", 1), ("way", 10), ("node", 2), ("relation", 1)}


def test_changes(spark):
    base = model.from_rows(spark, [(1, -120, 46, {"name": "one"}), (2, -120.01, 46.01, {}), (3, -120.02, 46.02, {})], [(10, [1, 2], {"highway": "primary"}), (11, [2, 3], {})])
    patch = model.from_rows(spark, [(1, -120, 46, {"name": "new"}), (2, -120.01, 46.01, {}), (4, -120.03, 46.03, {})], [(10, [1, 2, 2], {"highway": "primary"}), (12, [1, 2], {})])
    changes = change.direct_changes(base, patch)
    assert {(r["entity_type"], r["id"], r["change_type"]) for r in changes.collect()} == {("node", 1, "modify"), ("node", 4, "create"), ("way", 12, "create")}
    everything = changes.unionByName(change.deletions(base, patch))
    out = change.apply_changes(base, patch, everything)
    assert sorted((r["id"], dict(r["tags"])) for r in out.nodes.collect()) == [(1, {"name": "new"}), (2, {}), (4, {})]
    assert sorted(r["id"] for r in out.ways.collect()) == [10, 12]
    wrong = spark.createDataFrame([("node", 1, "create")], "entity_type string, id long, change_type string")
    with pytest.raises(Exception, match="contradicts"):
        change.apply_changes(base, patch, wrong).nodes.collect()
    xml = {r["id"]: r["xml"] for r in change.osc_rows(base, patch, changes).collect()}
    assert xml[1].startswith('<node id="1" lat="46.0000000" lon="-120.0000000"><tag k="name" v="new"/>')


def test_deduplicate(spark):
    ds = model.from_rows(spark, [(1, 0, 0, {}), (2, 0, 0, {"a": "b"}), (3, 0.1, 0, {}), (4, 0.000001, 0, {"ext:osm_version": "2"})], [(7, [1, 3], {}), (8, [2, 3], {"x": "y"})], [(5, [("way", 7, ""), ("way", 8, ""), ("node", 1, "")], {})])
    assert {(r["id"], r["keep"]) for r in change.node_replacements(ds).collect()} == {(1, 4), (2, 4)}
    out = change.deduplicate(ds)
    assert sorted(r["id"] for r in out.nodes.collect()) == [3, 4]
    assert {r["id"]: list(r["refs"]) for r in out.ways.collect()} == {8: [4, 3]}
    assert [(m["type"], m["ref"]) for m in out.relations.collect()[0]["members"]] == [("way", 8), ("node", 4)]


def test_crossings(spark):
    road = {"highway": "primary"}
    ds = model.from_rows(spark, [(1, 0, 0, {}), (2, 0.002, 0.002, {}), (3, 0, 0.002, {}), (4, 0.002, 0, {}), (5, 0.001, 0.0005, {}), (6, 0.001, 0.003, {})], [(1, [1, 2], road), (2, [3, 4], road), (3, [5, 6], {"highway": "primary", "bridge": "yes"})])
    got = [tuple(r) for r in change.crossings(ds, 5000).collect()]
    assert got == [(1, 2, 0, 0, 10000, 10000)]


def test_box_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(i, x := rng.randrange(1000), y := rng.randrange(1000), x + rng.randrange(200), y + rng.randrange(200)) for i in range(60)]
    boxes = spark.createDataFrame(rows, "k long, west long, south long, east long, north long")
    meet = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    got = [tuple(r) for r in spatial.box_pairs(boxes, "k", 150).collect()]
    assert len(got) == len(set(got)) and set(got) == meet


def test_rings_and_lines(spark):
    assert geometry.chain([[1, 2], [3, 2], [3, 1]], True) == [[1, 2, 3, 1]]
    assert geometry.chain([[1, 2], [4, 5]], True) == []
    assert geometry.chain([[2, 3], [1, 2], [9, 8]], False) == [[1, 2, 3], [9, 8]]
    nodes = [(i, i, i, {}) for i in range(1, 9)]
    ds = model.from_rows(spark, nodes, [(1, [1, 2, 3], {}), (2, [3, 4, 1], {}), (3, [5, 6, 7, 5], {})], [(1, [("way", 1, "outer"), ("way", 2, "Outer"), ("way", 3, "inner")], {"type": "multipolygon"}), (2, [("way", 1, ""), ("way", 2, "")], {"type": "route"}), (3, [("node", 1, "")], {"type": "multipoint"})])
    assert [(r["polygon"], r["ring"], r["role"], list(r["refs"])) for r in geometry.rings(ds).orderBy("ring").collect()] == [(0, 0, "outer", [1, 2, 3, 4, 1]), (0, 1, "inner", [5, 6, 7, 5])]
    assert {r["relation_id"]: (r["kind"], r["parts"]) for r in geometry.geometry_of(ds).collect()} == {1: ("area", 1), 2: ("line", 1), 3: ("point", 1)}


def test_columns(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert [one(text.hex_color(F.lit(x))) for x in ("#abc", "12345678", "zz", "ABCDEF")] == ["#AABBCC", "#12345678", None, "#ABCDEF"]
    assert [one(T.max_speed(F.lit(x))) for x in ("50", "50 km/h", "30 mph", "walk", "fast")] == [50, 50, 48, 5, None]
    assert one(geo.to_e7(F.lit(-0.00000025))) == -2 and one(text.number(F.lit(" 12.5m"))) == 12.5
    assert one(geo.unzigzag(geo.zigzag(F.lit(-7).cast("long")))) == -7
    assert one(geo.ring_area(F.array(*map(F.lit, (0.0, 2.0, 2.0, 0.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 2.0, 2.0, 0.0))))) == 4.0
    tags = F.create_map(F.lit("natural"), F.lit("water"), F.lit("water"), F.lit("sea"))
    assert [tuple(m) for m in one(layers.matches(tags, F.lit("Polygon")))] == [("water", "ocean")]
    assert one(layers.layer_mask(F.create_map(F.lit("highway"), F.lit("residential")), F.lit("LineString"))) == 64 + 128


def test_pbf_round_trip(spark, tmp_path):
    nodes = [(i, i / 7 - 3, 5 - i / 9, {"k": str(i)} if i % 3 else {}) for i in range(1, 200)]
    ds = model.from_rows(spark, nodes, [(3, [1, 2, 1], {"highway": "é"}), (9, [], {})], [(4, [("way", 3, "outer"), ("node", 1, ""), ("relation", 4, "x")], {"type": "site"})])
    path = str(tmp_path / "a.pbf")
    pbf.write(ds, path)
    back = pbf.read(spark, path)
    plain = lambda df: sorted(((r["id"], json.dumps(r.asDict(True), sort_keys=True)) for r in df.collect()))
    for a, b in ((ds.nodes, back.nodes), (ds.ways, back.ways), (ds.relations, back.relations)):
        assert plain(a.select(*b.columns)) == plain(b)
    data = open(path, "rb").read()
    for n in (1, 3, 5, len(data) - 1):
        with pytest.raises((ValueError, IndexError)):
            list(pbf.blobs(data[:n]))
    assert pbf.read_header(pbf.header_block("x")) == {"required_features": ["OsmSchema-V0.6"], "optional_features": ["DenseNodes"], "writing_program": "x"}


def test_wkb(spark):
    cases = [("Point", [1.0, 2.0]), ("LineString", [[0.0, 0.0], [1.0, 1.0]]), ("Polygon", [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]]), ("MultiPoint", [[1.0, 2.0], [3.0, 4.0]])]
    for kind, c in cases:
        assert wkb.parse(wkb.build(kind, c)) == (kind, c)
    assert wkb.parse(struct.pack(">BIIddd", 0, 1 | 0x20000000 | 0x80000000, 4326, 1.0, 2.0, 3.0)) == ("Point", [1.0, 2.0])
    df = spark.createDataFrame([(1, bytearray(wkb.build(*cases[0]))), (2, bytearray(b"xx")), (3, None)], "id long, geometry binary")
    assert sorted((r["id"], r["kind"]) for r in wkb.decode(df).collect()) == [(1, "Point"), (2, None), (3, None)]


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    hole = [[0.5, 0.2], [0.6, 0.2], [0.6, 0.3], [0.5, 0.2]]
    f = lambda g, c, **p: {"type": "Feature", "properties": p, "geometry": {"type": g, "coordinates": c}}
    data = {"type": "FeatureCollection", "features": [f("Point", [0, 0], name="p", n=None), f("LineString", [[0, 0], [2, 2]], highway="path"), f("Polygon", [ring], landuse="x"), f("Polygon", [ring, hole], a="b"), f("MultiPoint", [[5, 5]])]}
    (tmp_path / "a.json").write_text(json.dumps(data))
    ds = geojson.to_dataset(geojson.read_features(spark, str(tmp_path / "a.json")))
    nodes = {(r["lon_e7"] / 1e7, r["lat_e7"] / 1e7): (r["id"], dict(r["tags"])) for r in ds.nodes.collect()}
    assert len(nodes) == 7 and nodes[0, 0][1] == {"name": "p"}
    ways = sorted((dict(r["tags"]).get("highway", dict(r["tags"]).get("landuse", "")), len(r["refs"])) for r in ds.ways.collect())
    assert ways == [("", 4), ("", 4), ("path", 2), ("x", 4)]
    r = ds.relations.collect()
    assert len(r) == 1 and [m["role"] for m in r[0]["members"]] == ["outer", "inner"] and dict(r[0]["tags"]) == {"a": "b", "type": "multipolygon"}
    out = {r["id"]: json.loads(r["feature"])["geometry"]["type"] for r in geojson.features(ds).where("kind = 'way'").collect()}
    assert sorted(out.values()) == ["LineString", "Polygon", "Polygon", "Polygon"]


def test_gtfs(spark, tmp_path):
    files = {
        "stops.txt": "stop_id,stop_name,stop_lat,stop_lon,location_type,wheelchair_boarding\ns1,A,40.7128,-74.0060,0,1\ns2,B,40.7580,-73.9855,1,2\ns3,C,,,0,0\n",
        "routes.txt": "route_id,route_short_name,route_long_name,route_type,route_color\nr1,1,Downtown,3,FF0000\nr2,2,,0,\n",
        "trips.txt": "trip_id,route_id,service_id,shape_id\nt1,r1,w,x\nt2,r1,w,x\nt3,r2,w,x\nt4,r2,w,short\n",
        "shapes.txt": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nx,40.7,-74,2\nx,40.8,-74,10\nx,40.6,-74,1\nshort,1,1,1\n",
    }
    for name, t in files.items():
        (tmp_path / name).write_text(t)
    ds = gtfs.read(spark, str(tmp_path))
    ways = {(t := dict(r["tags"]))["ref:gtfs:route_id"]: (len(r["refs"]), t["gtfs:trip_ids"], t["gtfs:trip_count"], t.get("color")) for r in ds.ways.collect()}
    assert ways == {"r1": (3, "t1;t2", "2", "#FF0000"), "r2": (3, "t3", "1", None)}
    assert {dict(r["tags"]).get("ref"): dict(r["tags"]).get("wheelchair") for r in ds.nodes.collect() if r["tags"]} == {"s1": "yes", "s2": "no"}
    assert ds.nodes.count() == 5


def test_tile_encoding():
    assert tiles.clip_line([(-10, 5), (20, 5)], 0, 10) == [[(0.0, 5.0), (10.0, 5.0)]]
    assert tiles.clip_ring([(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)], 0, 10)[0] == tiles.clip_ring([(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)], 0, 10)[-1]
    layer = dict(pbf.fields(tiles.encode_tile({"a": [{"id": 1, "kind": 1, "parts": [[(25, 17)]], "properties": {"n": 5, "s": "x", "b": True, "f": 1.5, "z": None}}]})))[3]
    got = list(pbf.fields(layer))
    assert [v for k, v in got if k == 3] == [b"n", b"s", b"b", b"f"] and dict(got)[15] == 2
    feature = dict(pbf.fields(dict(got)[2]))
    assert pbf.packed(feature[4]) == [9, 50, 34]
