"""What whole tables need: no driver or task holds all of a map."""

import math

import pytest

from terraframe import model, registry
from terraframe.operators import change, graph, joins, spatial, tiles
from terraframe.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_not_broadcast(spark, sf):
    nodes = tables.nodes(spark, sf)
    assert "Broadcast" not in plan(spatial.node_pairs_within(nodes, nodes, 1.0))


def test_ranks_are_not_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr(change, "resolve", lambda step: step)
    assert "Broadcast" not in plan(change.node_replacements(tables.dataset(spark, sf)))


def test_replacements_are_not_broadcast(spark, sf, monkeypatch):
    plans = []

    def run(df):
        out = model.checkpointed(df)
        plans.append(plan(df))  # as it ran: sizes are known then
        return out

    monkeypatch.setattr(change, "checkpointed", run)
    ds = tables.dataset(spark, sf)
    out = run(change.replace_refs(ds.ways, change.node_replacements(ds)))
    assert out.count() == ds.ways.count() and len(plans) >= 3 and "Broadcast" not in "".join(plans)


def test_orders_are_not_broadcast(spark, sf):
    ds = tables.dataset(spark, sf)
    assert "Broadcast" not in plan(ds.ways)
    assert not [x for x in plan(ds.relations).splitlines() if "BroadcastHashJoin" in x and "custkey" in x]


def test_names_of_ways_are_not_broadcast(spark):
    ds = model.from_rows(spark, [(1, 7.4, 43.7, {}), (2, 7.5, 43.7, {})], [(1, [1, 2], {"highway": "primary"})])
    path = spark.createDataFrame([(1, 0, 1, None, None, 0.0), (1, 1, 2, 1, 1, 8.0)], graph.PATH)
    ways = model.checkpointed(ds.ways)
    assert "Broadcast" not in plan(graph.route_segments(path, ways.limit(10)))


@pytest.mark.parametrize("algorithm", graph.ALGORITHMS)
def test_paths_without_the_graph_in_one_place(spark, sf, algorithm, monkeypatch):
    monkeypatch.setattr(graph, "MAX_EDGES", 10, raising=False)
    monkeypatch.setattr(graph, "HELD", 3, raising=False)
    ds = tables.dataset(spark, sf)
    e = model.checkpointed(graph.edges(ds))
    adjacency = {}
    for r in sorted(e.collect(), key=lambda r: (r["src"], r["dst"], r["way_id"])):
        adjacency.setdefault(r["src"], []).append((r["dst"], r["way_id"], float(r["distance"])))
    queries = [(7, 10, 150), (7, 11, 11), (8, 12, 136), (9, 5, 10**9)]
    got = graph.route(ds, e, spark.createDataFrame(queries, "query long, start long, goal long"), algorithm).orderBy("query", "seq").collect()
    for query, start, goal in queries[2:]:
        path = [(r["node"], r["way"], r["prev"], r["cost"]) for r in got if r["query"] == query]
        want = (graph.meeting if algorithm == "bidirectional" else graph.search)(adjacency, start, goal) or []
        assert path == want if algorithm == "bidirectional" else [p[3] for p in path[-1:]] == [p[3] for p in want[-1:]]
        assert [p[2] for p in path[1:]] == [p[0] for p in path[:-1]]
    assert sum(r["query"] == 7 and r["node"] == 11 and r["cost"] == 0 and r["seq"] == 0 for r in got) == 1


def test_edges_do_not_broadcast_nodes(spark, sf):
    ds = tables.dataset(spark, sf)
    ways = ds.ways.limit(10)
    ways = model.Dataset(ds.nodes, model.checkpointed(ways), ds.relations)
    assert "Broadcast" not in plan(graph.edges(ways))


def test_no_task_gathers_the_lines_of_a_raster_tile(spark, sf):
    df = tiles.raster_tiles(tables.dataset(spark, sf), 13)
    assert "bit_or" in plan(df) and df.count() == 4
    few = model.from_rows(spark, [(1, 7.41, 43.73, {}), (2, 7.42, 43.73, {})], [(1, [1, 2], {}), (2, [1, 1], {})])
    many = model.Dataset(few.nodes, spark.range(2, 4000, 1, 20).selectExpr("id", "array(1L, 2L) as refs", "map('a', 'b') as tags"), few.relations)
    assert tiles.raster_tiles(few, 13).collect() == tiles.raster_tiles(many, 13).collect()


def test_a_vector_tile_is_written_from_sorted_rows(spark, sf):
    df = tiles.vector_tiles(tables.dataset(spark, sf), 14)
    assert "FlatMapGroupsInArrow" not in plan(df.select("tile")).split("MapInArrow join")[0] and len(df.select("x", "y").distinct().collect()) == df.count()


def test_segments_are_as_long_as_their_whole_differences_say(spark):
    spots = [(74000000, 437200000, 74000000, 437200003), (74000000, 437200000, 74000007, 437200000), (-1800000000, 0, 1799999998, 0)]
    got = joins.segment_length(spark.createDataFrame(spots, "ax int, ay int, bx int, by int")).collect()
    r = math.pi * 6371008.8 / 180
    for m, want in zip([x["meters"] for x in got], (3e-7 * r, 7e-7 * r * math.cos(math.radians(43.72)), 2e-7 * r)):
        assert abs(m / want - 1) < 1e-6
    assert abs(got[0]["meters"] / (3e-7 * r) - 1) < 1e-12


@pytest.mark.parametrize("algorithm", ["dijkstra", "astar"])
def test_a_round_of_a_search_has_no_plan_of_its_own(spark, algorithm, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "checkpointed", lambda df: plans.append(1) or model.checkpointed(df))
    monkeypatch.setattr(graph, "PART", 7, raising=False)
    monkeypatch.setattr(graph, "AT_ONCE", 2, raising=False)
    ds = model.from_rows(spark, [(i, 7.4 + i / 1e4, 43.7, {}) for i in range(14)], [(1, range(14), {"highway": "primary"})])
    queries = [(5, 0, 13), (6, 13, 0), (7, 3, 3), (8, 2, 99), (9, 4, 9)]
    got = graph.route(ds, graph.edges(ds), spark.createDataFrame(queries, "query long, start long, goal long"), algorithm).orderBy("query", "seq").collect()
    assert [r["node"] for r in got] == [*range(14), *range(13, -1, -1), 3, *range(4, 10)]
    assert [r["seq"] for r in got] == [*range(14), *range(14), 0, *range(6)] and len(plans) < 10


@pytest.mark.parametrize("name", ["route_info", "route_astar", "route_marks"])
def test_the_driver_gets_paths_and_not_the_graph(spark, sf, name, monkeypatch):
    rows = []

    def counted(kind, method, f):
        monkeypatch.setattr(kind, method, lambda self, *a, **b: rows.append(len(out := list(f(self, *a, **b)))) or (iter(out) if method == "toLocalIterator" else out))

    frame, rdd = type(spark.range(0)), type(spark.sparkContext.parallelize([0]))
    for kind in (frame, rdd):
        for method in ("collect", "toLocalIterator"):
            counted(kind, method, getattr(kind, method))
    made = registry.QUERIES[name](spark, sf)
    monkeypatch.undo()
    assert rows and sum(rows) < graph.edges(tables.dataset(spark, sf)).count() / 10 and made.count() > 0
