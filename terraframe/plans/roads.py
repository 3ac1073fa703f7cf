"""Road graphs, paths, tiles and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions import layers
from terraframe.model import Dataset
from terraframe.operators import geometry, graph, tiles
from terraframe.plans.base import query
from terraframe.plans.lookup import BOXES, CLOSURE

ROADS = """, road AS (SELECT id, refs, tags, coalesce(tags['oneway'] IN ('yes', '1'), false) AS one_way, CASE WHEN tags['maxspeed'] = '50' THEN 50 WHEN tags['maxspeed'] = '30 mph' THEN 48 WHEN tags['maxspeed'] = 'walk' THEN 5
  ELSE CASE tags['highway'] WHEN 'motorway' THEN 120 WHEN 'primary' THEN 80 WHEN 'residential' THEN 30 ELSE 20 END END AS kph FROM ways WHERE tags['highway'] IN ('motorway', 'primary', 'residential', 'service')),
seg AS (SELECT id AS way_id, one_way, kph, i - 1 AS seq, refs[i] AS a, refs[i + 1] AS b FROM (SELECT *, unnest(range(1, len(refs))) AS i FROM road)),
len AS (SELECT seg.*, 2 * 6371008.8 * atan2(sqrt(s), sqrt(1 - s)) AS meters FROM (SELECT seg.*, pow(sin(radians((y.lat_e7 - x.lat_e7) / 1e7) / 2), 2) + cos(radians(x.lat_e7 / 1e7)) * cos(radians(y.lat_e7 / 1e7)) * pow(sin(radians((y.lon_e7 - x.lon_e7) / 1e7) / 2), 2) AS s FROM seg JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b) seg),
edge AS (SELECT a AS src, b AS dst, way_id, seq, round(meters, 1) AS distance, round(meters / (kph / 3.6), 1) AS seconds FROM len UNION ALL SELECT b, a, way_id, seq, round(meters, 1), round(meters / (kph / 3.6), 1) FROM len WHERE NOT one_way)"""


_FLOAT = "round(CAST(CAST({} AS FLOAT) AS DOUBLE), 1)"
_EDGE = f"way_id, CAST(seq AS INTEGER) AS seq, {_FLOAT.format('meters')} AS distance, {_FLOAT.format('meters / (kph / 3.6)')} AS time FROM len"


@query(f"{ROADS} SELECT a AS src, b AS dst, {_EDGE} UNION ALL SELECT b, a, {_EDGE} WHERE NOT one_way")
def edges(ds: Dataset) -> DataFrame:
    exact = lambda c: F.round(F.col(c).cast("double"), 1).alias(c)
    return graph.edges(ds).select("src", "dst", "way_id", "seq", exact("distance"), exact("time"))


@query(f"{ROADS} SELECT src % 100 AS bucket, count(*) AS n, round(sum(distance) / 1000) AS km FROM edge GROUP BY 1")
def edge_totals(ds: Dataset) -> DataFrame:
    return graph.edges(ds).groupBy((F.col("src") % 100).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("distance").cast("double"), 1)) / 1000).alias("km"))


@query(f"{ROADS}, e AS (SELECT a AS id FROM len UNION ALL SELECT b FROM len) SELECT id, count(*) AS occurrences FROM e GROUP BY id")
def routable_nodes(ds: Dataset) -> DataFrame:
    return graph.routable(ds)


@query(f"{ROADS}, e AS (SELECT a AS id FROM len UNION ALL SELECT b FROM len) SELECT id FROM e GROUP BY id HAVING count(*) >= 2")
def intersections(ds: Dataset) -> DataFrame:
    return graph.routable(ds).where("occurrences >= 2").select("id")


@query(f"{ROADS}, d AS (SELECT id, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(lat_e7 / 1e7 - 43.74) / 2), 2) + cos(radians(43.74)) * cos(radians(lat_e7 / 1e7)) * pow(sin(radians(lon_e7 / 1e7 - 7.42) / 2), 2))) AS m FROM nodes WHERE id IN (SELECT a FROM len UNION SELECT b FROM len)) SELECT id, round(m, 2) AS meters FROM d WHERE m < 2000 ORDER BY m, id LIMIT 1")
def snap(ds: Dataset) -> DataFrame:
    """The nearest road node: one row is the feature."""
    return graph.snap(ds, 7.42, 43.74, 2000).select("id", F.round("meters", 2).alias("meters"))


@query(f"""{ROADS}, hop AS (SELECT DISTINCT src, dst FROM edge), r0 AS (SELECT 1 AS id), r1 AS (SELECT DISTINCT dst AS id FROM hop JOIN r0 ON src = id), r2 AS (SELECT DISTINCT dst AS id FROM hop JOIN r1 ON src = id)
SELECT count(*) AS n, min(id) AS lo, max(id) AS hi FROM (SELECT id FROM r0 UNION SELECT id FROM r1 UNION SELECT id FROM r2)""")
def two_hops(ds: Dataset) -> DataFrame:
    """Nodes at most two road segments from node 1."""
    e = graph.edges(ds).select("src", "dst").distinct()
    step = lambda df: df.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"))
    r0 = ds.nodes.sparkSession.createDataFrame([(1,)], "id long")
    r1 = step(r0).distinct()
    return r0.unionByName(r1).unionByName(step(r1)).distinct().agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


def _queries(ds: Dataset) -> DataFrame:
    return ds.nodes.sparkSession.createDataFrame([(i, 10 + i, 150 - 7 * i) for i in range(8)], "query long, start long, goal long")


_HOPS = """, ways_of AS MATERIALIZED (SELECT src, dst, min(CAST(floor(CAST(CAST(meters AS FLOAT) AS DOUBLE) * 1000 + 0.5) AS BIGINT)) AS w FROM (SELECT a AS src, b AS dst, meters FROM len UNION ALL SELECT b, a, meters FROM len WHERE NOT one_way) GROUP BY src, dst)"""
_SSSP = f"""{_HOPS}, best(node, cost) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT w.dst, min(best.cost + w.w) FROM best JOIN ways_of w ON w.src = best.node LEFT JOIN recurring.best r ON r.node = w.dst WHERE r.cost IS NULL OR best.cost + w.w < r.cost GROUP BY w.dst)"""


@query(f"{ROADS}{_SSSP} SELECT node, cost FROM best")
def route_sssp(ds: Dataset) -> DataFrame:
    return graph.distances(graph.edges(ds), 1)


def _paths(algorithm: str):
    @query(name=f"route_{algorithm}")
    def run(ds: Dataset) -> DataFrame:
        return graph.route(ds, graph.edges(ds), _queries(ds), algorithm, "distance")


for _a in graph.ALGORITHMS:
    _paths(_a)


_Q = ", ".join(f"({i}, {10 + i}, {150 - 7 * i})" for i in range(8))
_MANY = f"""{_HOPS}, q AS (SELECT CAST(query AS BIGINT) AS query, CAST(start AS BIGINT) AS start, CAST(goal AS BIGINT) AS goal FROM (VALUES {_Q}) v(query, start, goal)),
best(query, node, cost) USING KEY (query, node) AS (SELECT query, start, CAST(0 AS BIGINT) FROM q UNION SELECT best.query, w.dst, min(best.cost + w.w) FROM best JOIN ways_of w ON w.src = best.node LEFT JOIN recurring.best r ON r.node = w.dst AND r.query = best.query WHERE r.cost IS NULL OR best.cost + w.w < r.cost GROUP BY best.query, w.dst)"""


@query(f"{ROADS}{_MANY} SELECT query, round(cost / 1000) AS meters FROM best JOIN q USING (query) WHERE node = goal")
def route_stats(ds: Dataset) -> DataFrame:
    """Metres of least paths, added up from the edges that their steps take."""
    e = graph.edges(ds)
    return graph.statistics(graph.route(ds, e, _queries(ds), "dijkstra"), e).select("query", F.round("distance").alias("meters"))


@query()
def route_info(ds: Dataset) -> DataFrame:
    e = graph.edges(ds)
    out = graph.route_info(graph.route(ds, e, _queries(ds), "dijkstra"), e, ds.ways)
    return out.select("query", "segment", "name", "highway", F.array_join(F.transform("way_ids", lambda x: x.cast("string")), ",").alias("way_ids"), F.round("distance", 1).alias("distance"), F.round("time", 1).alias("time"), "turn")


@query()
def route_marks(ds: Dataset) -> DataFrame:
    e = graph.edges(ds)
    return graph.marked_nodes(graph.route(ds, e, _queries(ds), "dijkstra"), graph.routable(ds).where("occurrences >= 2"))


@query()
def route_segments(ds: Dataset) -> DataFrame:
    return graph.route_segments(graph.route(ds, graph.edges(ds), _queries(ds), "astar", "time"), ds.ways)


@query()
def relation_rings(ds: Dataset) -> DataFrame:
    return geometry.rings(ds)


@query()
def relation_lines(ds: Dataset) -> DataFrame:
    return geometry.lines(ds)


@query()
def relation_geometry(ds: Dataset) -> DataFrame:
    return geometry.geometry_of(ds)


LAYER = """, area AS (SELECT *, refs[1] = refs[len(refs)] AND len(refs) >= 3 AS closed FROM ways), lf AS (SELECT 'pois' AS layer, tags['amenity'] AS kind FROM nodes WHERE tags['amenity'] IS NOT NULL UNION ALL SELECT 'places', tags['place'] FROM nodes WHERE tags['place'] IS NOT NULL
UNION ALL SELECT layer, tags['highway'] FROM area, (VALUES ('streets'), ('street_labels')) v(layer) WHERE tags['highway'] IS NOT NULL AND NOT (closed AND cardinality(tags) = 0)
UNION ALL SELECT 'buildings', 'building' FROM area WHERE tags['building'] = 'yes' AND closed UNION ALL SELECT 'water', 'water' FROM area WHERE tags['natural'] = 'water' AND closed)"""


@query(f"{LAYER} SELECT layer, kind, count(*) AS n FROM lf GROUP BY layer, kind")
def layer_features(ds: Dataset) -> DataFrame:
    return tiles.layer_features(ds).groupBy("layer", "kind").agg(F.count("*").alias("n"))


@query("SELECT id, CAST(CASE WHEN tags['amenity'] IS NOT NULL THEN 512 ELSE 0 END + CASE WHEN tags['place'] IS NOT NULL THEN 1024 ELSE 0 END AS INTEGER) AS mask FROM nodes")
def layer_mask(ds: Dataset) -> DataFrame:
    return ds.nodes.select("id", layers.layer_mask(F.col("tags"), F.lit("Point")).alias("mask"))


@query("""SELECT m.ref AS id, CAST(bit_or(mask) AS INTEGER) AS mask FROM (SELECT unnest(members) AS m, CASE WHEN tags['building'] = 'yes' THEN 32 ELSE 0 END + CASE WHEN tags['natural'] = 'wood' THEN 8 ELSE 0 END AS mask
FROM relations WHERE tags['type'] IN ('multipolygon', 'boundary', 'site')) WHERE m.type = 'way' GROUP BY m.ref""")
def suppressed_ways(ds: Dataset) -> DataFrame:
    return tiles.suppressed(ds)


_Y = "(0.5 - ln((1 + sin(radians({c} / 1e7))) / (1 - sin(radians({c} / 1e7)))) / (4 * pi())) * 16384"


@query(f"""{CLOSURE}{BOXES}, f AS (SELECT CAST(floor((lon_e7 / 1e7 + 180) / 360 * 16384) AS INTEGER) AS x, CAST(floor({_Y.format(c='lat_e7')}) AS INTEGER) AS y, 'nodes' AS layer FROM nodes WHERE cardinality(tags) > 0
UNION ALL SELECT x, unnest(range(CAST(floor({_Y.format(c='north')}) AS INTEGER), CAST(floor({_Y.format(c='south')}) AS INTEGER) + 1)), 'ways' FROM (SELECT *, unnest(range(CAST(floor((west / 1e7 + 180) / 360 * 16384) AS INTEGER), CAST(floor((east / 1e7 + 180) / 360 * 16384) AS INTEGER) + 1)) AS x FROM b WHERE way_id NOT IN (SELECT ref FROM c WHERE type = 'way') AND way_id IN (SELECT id FROM ways WHERE cardinality(tags) > 0)))
SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, layer, count(*) AS n FROM f GROUP BY ALL""")
def tile_feature_counts(ds: Dataset) -> DataFrame:
    """Nodes, and ways outside relations; tile_layer_counts has the relations, too, whose rings SQL can't assemble."""
    return tiles.node_features(ds, 14).unionByName(tiles.way_features(ds, 14)).groupBy("x", "y", "layer").agg(F.count("*").alias("n"))


@query()
def tile_layer_counts(ds: Dataset) -> DataFrame:
    return tiles.features(ds, 14).groupBy("x", "y", "layer").agg(F.count("*").alias("n"))


@query()
def vector_tiles(ds: Dataset) -> DataFrame:
    return tiles.vector_tiles(ds, 14).select("z", "x", "y", "features", F.sha2("tile", 256).alias("tile_sha256"))


@query()
def raster_tiles(ds: Dataset) -> DataFrame:
    return tiles.raster_tiles(ds, 13).select("z", "x", "y", F.sha2("png", 256).alias("png_sha256"))
