"""Counts, lookups, predicates, members and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions import geo, layers, text
from terraframe.functions import tags as T
from terraframe.model import Dataset
from terraframe.operators import extract, geometry, joins, spatial
from terraframe.plans.base import query, tags_sql, tags_text

BOX = (7.41, 43.725, 7.43, 43.745)
E7 = "lon_e7 BETWEEN 74100000 AND 74300000 AND lat_e7 BETWEEN 437250000 AND 437450000"


@query("SELECT kind, count(*) AS n FROM (SELECT 'node' AS kind FROM nodes UNION ALL SELECT 'way' FROM ways UNION ALL SELECT 'relation' FROM relations) GROUP BY kind")
def count_by_kind(ds: Dataset) -> DataFrame:
    return ds.wide().groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT id, lon_e7, lat_e7, {tags_sql()} FROM nodes WHERE id IN (7, 77, 777)")
def node_by_id(ds: Dataset) -> DataFrame:
    return ds.nodes.where(F.col("id").isin(7, 77, 777)).selectExpr("id", "lon_e7", "lat_e7", tags_text())


@query("SELECT 'node' AS kind, id FROM nodes WHERE list_contains(map_keys(tags), 'name') UNION ALL SELECT 'way', id FROM ways WHERE list_contains(map_keys(tags), 'name') UNION ALL SELECT 'relation', id FROM relations WHERE list_contains(map_keys(tags), 'name')")
def tag_key_search(ds: Dataset) -> DataFrame:
    return ds.wide().where(T.has_key(F.col("tags"), "name")).select("kind", "id")


@query("SELECT 'node' AS kind, id FROM nodes WHERE tags['amenity'] = 'cafe' UNION ALL SELECT 'way', id FROM ways WHERE tags['amenity'] = 'cafe' UNION ALL SELECT 'relation', id FROM relations WHERE tags['amenity'] = 'cafe'")
def tag_value_search(ds: Dataset) -> DataFrame:
    return ds.wide().where(T.has_value(F.col("tags"), "amenity", "cafe")).select("kind", "id")


@query(f"SELECT id, {tags_sql()} FROM nodes WHERE cardinality(tags) > 0")
def tagged_nodes(ds: Dataset) -> DataFrame:
    return ds.nodes.where(F.size("tags") > 0).selectExpr("id", tags_text())


@query("SELECT CAST(cardinality(tags) AS INTEGER) AS n_tags, count(*) AS n FROM ways GROUP BY 1")
def tag_cardinality(ds: Dataset) -> DataFrame:
    return ds.ways.groupBy(F.size("tags").alias("n_tags")).agg(F.count("*").alias("n"))


WIDE = ", wide AS (SELECT 'node' AS kind, id, tags, 0 AS parts FROM nodes UNION ALL SELECT 'way', id, tags, len(refs) FROM ways UNION ALL SELECT 'relation', id, tags, len(members) FROM relations)"


@query(f"{WIDE} SELECT kind, key, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT kind, id, unnest(map_keys(tags)) AS key FROM wide) GROUP BY kind, key")
def tag_postings(ds: Dataset) -> DataFrame:
    keys = ds.wide().select("kind", "id", F.explode(F.map_keys("tags")).alias("key"))
    return keys.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"{WIDE} SELECT s, dense_rank() OVER (ORDER BY s) AS code FROM (SELECT unnest(map_keys(tags)) AS s FROM wide UNION SELECT unnest(map_values(tags)) FROM wide UNION SELECT m.role FROM (SELECT unnest(members) AS m FROM relations))")
def string_table(ds: Dataset) -> DataFrame:
    """Distinct tag keys and values of nodes, ways and relations, and member roles, with dense codes in their order. The
    distinct strings are range-partitioned; codes add up from the partitions' sizes."""
    from terraframe.operators.change import new_ids

    tags = ds.wide().select(F.explode(F.concat(F.map_keys("tags"), F.map_values("tags"))).alias("s"))
    roles = joins.members(ds).select(F.col("role").alias("s"))
    none = ds.nodes.sparkSession.createDataFrame([(0,)], "id long")
    return new_ids(tags.unionByName(roles).where("s is not null").distinct(), none, ["s"]).select("s", F.col("id").alias("code"))


@query("SELECT id FROM ways WHERE list_contains(map_keys(tags), 'highway') OR tags['public_transport'] = 'platform' OR tags['railway'] = 'platform' OR list_contains(map_keys(tags), 'park_ride')")
def transit_filter(ds: Dataset) -> DataFrame:
    return extract.filter_by_tags(ds, T.TRANSIT_EXTRACT).ways.select("id")


@query("SELECT id FROM nodes WHERE list_contains(map_keys(tags), 'place') OR tags['amenity'] = 'bank'")
def extract_tag_filter(ds: Dataset) -> DataFrame:
    return extract.filter_by_tags(ds, {"nodes": [(" place ", ""), ("amenity", "bank"), (" ", None)]}).nodes.select("id")


@query("""SELECT id, refs[1] = refs[len(refs)] AND len(refs) >= 3 AND (cardinality(tags) = 0 OR CASE WHEN list_contains(map_keys(tags), 'area') THEN tags['area'] <> 'no'
  ELSE coalesce(tags['building'] <> 'no', false) OR coalesce(tags['natural'] NOT IN ('no', 'coastline', 'cliff', 'ridge', 'arete', 'tree_row'), false) END) AS area
FROM (SELECT id, tags, list_append(refs, refs[1]) AS refs FROM ways)""")
def way_is_area(ds: Dataset) -> DataFrame:
    """Over ways closed by their first reference."""
    closed = F.concat("refs", F.slice("refs", 1, 1))
    return ds.ways.select("id", T.is_area(closed, F.col("tags")).alias("area"))


@query("SELECT id, CASE WHEN lower(tags['type']) IN ('multipolygon', 'boundary', 'site') THEN 'area' WHEN lower(tags['type']) IN ('route', 'waterway', 'multilinestring', 'canal') THEN 'line' WHEN lower(tags['type']) = 'multipoint' THEN 'point' WHEN len(list_filter(members, lambda m: m.type = 'relation')) > 0 THEN 'super' ELSE 'logic' END AS kind FROM relations")
def relation_kind(ds: Dataset) -> DataFrame:
    return ds.relations.select("id", T.relation_kind(F.col("tags"), F.col("members")).alias("kind"))


@query("SELECT id, count(*) FILTER (m.type = 'way') AS n_ways, count(*) FILTER (m.type = 'relation') AS n_relations, count(*) FILTER (m.role = 'outer') AS n_outer FROM (SELECT id, unnest(members) AS m FROM relations) GROUP BY id")
def relation_members(ds: Dataset) -> DataFrame:
    n = lambda f: F.size(F.filter("members", f)).cast("long")
    return ds.relations.select("id", n(lambda m: m["type"] == "way").alias("n_ways"), n(lambda m: m["type"] == "relation").alias("n_relations"), n(lambda m: m["role"] == "outer").alias("n_outer"))


@query("SELECT id AS relation_id, array_to_string([m.ref for m in members if m.type = 'way' and m.role = 'outer'], ',') AS outer_ways, array_to_string([m.ref for m in members if m.type = 'way' and m.role = 'inner'], ',') AS inner_ways FROM relations")
def members_by_role(ds: Dataset) -> DataFrame:
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return geometry.role_members(ds).select("relation_id", join("outer").alias("outer_ways"), join("inner").alias("inner_ways"))


@query("SELECT id FROM ways WHERE tags['highway'] IN ('motorway', 'primary', 'residential', 'service')")
def highway_filter(ds: Dataset) -> DataFrame:
    return ds.ways.where(T.vehicle_way(F.col("tags"))).select("id")


@query("SELECT id FROM ways WHERE tags['highway'] = 'footway'")
def pedestrian_filter(ds: Dataset) -> DataFrame:
    return ds.ways.where(T.foot_way(F.col("tags"))).select("id")


@query("SELECT a.id AS a, b.id AS b, a.tags['highway'] IS NOT NULL AND b.tags['highway'] IS NOT NULL AND a.tags['bridge'] IS NULL AND b.tags['bridge'] IS NULL AS connect FROM ways a JOIN ways b ON b.id = a.id + 1")
def ways_should_connect(ds: Dataset) -> DataFrame:
    a, b = ds.ways.select(F.col("id").alias("a"), F.col("tags").alias("at")), ds.ways.select(F.col("id").alias("b"), F.col("tags").alias("bt"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", T.should_connect(F.col("at"), F.col("bt")).alias("connect"))


@query(f"SELECT id, lon_e7, lat_e7 FROM nodes WHERE {E7}")
def bbox_nodes(ds: Dataset) -> DataFrame:
    return spatial.nodes_in_box(ds.nodes, BOX).select("id", "lon_e7", "lat_e7")


@query("SELECT id FROM nodes WHERE lat_e7 BETWEEN 437250000 AND 437450000 AND (lon_e7 >= 74300000 OR lon_e7 <= 74100000)")
def bbox_nodes_antimeridian(ds: Dataset) -> DataFrame:
    return spatial.nodes_in_box(ds.nodes, (7.43, 43.725, 7.41, 43.745)).select("id")


def _haversine(x: str, y: str, lon: float, lat: float) -> str:
    s = f"(pow(sin(radians({y} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({y})) * pow(sin(radians({x} - {lon}) / 2), 2))"
    return f"2 * 6371008.8 * atan2(sqrt({s}), sqrt(1 - {s}))"


_NODE = _haversine("lon_e7 / 1e7", "lat_e7 / 1e7", 7.42, 43.74)


@query(f"SELECT id, round({_NODE}, 3) AS meters FROM nodes WHERE {_NODE} <= 500")
def radius_nodes(ds: Dataset) -> DataFrame:
    return spatial.nodes_within(ds.nodes, 7.42, 43.74, 0.5).select("id", F.round("meters", 3).alias("meters"))


@query(f"SELECT id, round({_NODE}, 3) AS meters FROM nodes ORDER BY {_NODE}, id LIMIT 25")
def knn_nodes(ds: Dataset) -> DataFrame:
    """The 25 nearest nodes: a top-k report."""
    return spatial.nearest_nodes(ds.nodes, 7.42, 43.74, 25).select("id", F.round("meters", 3).alias("meters"))


@query("SELECT id, (CAST(lon_e7 AS BIGINT) - 74200000) * (CAST(lon_e7 AS BIGINT) - 74200000) + (CAST(lat_e7 AS BIGINT) - 437400000) * (CAST(lat_e7 AS BIGINT) - 437400000) AS d2 FROM nodes ORDER BY d2, id LIMIT 10")
def planar_knn(ds: Dataset) -> DataFrame:
    """The 10 nearest nodes on the plane: a top-k report."""
    return spatial.nearest_planar(ds.nodes, 7.42, 43.74, 10).select("id", "d2")


POINTS = ", r AS (SELECT id AS way_id, unnest(range(1, len(refs) + 1)) AS i, refs FROM ways), p AS (SELECT way_id, i, refs[i] AS ref, lon_e7, lat_e7 FROM r JOIN nodes n ON n.id = refs[i])"
BOXES = POINTS + ", b AS (SELECT way_id, min(lon_e7) AS west, min(lat_e7) AS south, max(lon_e7) AS east, max(lat_e7) AS north FROM p GROUP BY way_id)"


@query(f"{POINTS} SELECT way_id, string_agg(lon_e7 || ' ' || lat_e7, ',' ORDER BY i) AS line FROM p GROUP BY way_id")
def way_geometry(ds: Dataset) -> DataFrame:
    return joins.way_lines(ds).select("way_id", F.array_join(F.transform("line", lambda p: F.concat_ws(" ", p["lon_e7"], p["lat_e7"])), ",").alias("line"))


@query(f"{BOXES} SELECT * FROM b")
def way_bbox(ds: Dataset) -> DataFrame:
    return joins.way_boxes(ds)


@query(f"{BOXES} SELECT way_id FROM b WHERE west <= 74120000 AND east >= 74100000 AND south <= 437270000 AND north >= 437250000")
def ways_bbox_intersects(ds: Dataset) -> DataFrame:
    return spatial.boxes_meeting(joins.way_boxes(ds), (7.41, 43.725, 7.412, 43.727)).select("way_id")


def _box_distance(lon: float, lat: float) -> str:
    """SQL: metres from a point to a box west, south, east, north in 1e-7 degrees."""
    on = lambda x, y: _haversine(x, f"least(greatest({y}, south / 1e7), north / 1e7)", lon, lat)
    best = lambda x: f"degrees(atan2(tan(radians({lat})), cos(radians({x} - {lon}))))"
    edges = ", ".join(on(x, best(x)) for x in ("west / 1e7", "east / 1e7"))
    return f"CASE WHEN {lon} BETWEEN west / 1e7 AND east / 1e7 THEN {on(str(lon), str(lat))} ELSE least({edges}) END"


#: Points inside the map, beside it and off its corner.
SPOTS = {"inside": (7.42, 43.74), "beside": (7.3993, 43.731), "corner": (7.4451, 43.7601)}
_SPOTS = " UNION ALL ".join(f"(SELECT '{k}' AS spot, way_id, round(m, 1) AS meters FROM (SELECT way_id, {_box_distance(*p)} AS m FROM b) ORDER BY m, way_id LIMIT 20)" for k, p in SPOTS.items())


@query(f"{BOXES} {_SPOTS}")
def knn_ways(ds: Dataset) -> DataFrame:
    """The 20 ways that are nearest to each of three points by their boxes, of all ways: a top-k report."""
    boxes = joins.way_boxes(ds)
    near = [spatial.nearest_boxes(boxes, "way_id", *p, 20).select(F.lit(k).alias("spot"), "way_id", F.round("meters", 1).alias("meters")) for k, p in SPOTS.items()]
    return near[0].unionByName(near[1]).unionByName(near[2])


CLOSURE = ", m AS (SELECT id, unnest(members, max_depth := 2) FROM relations), c AS (SELECT id AS root, type, ref FROM m UNION SELECT c.root, m.type, m.ref FROM c JOIN m ON c.type = 'relation' AND m.id = c.ref)"


@query(f"{CLOSURE} SELECT root AS relation_id, type, count(*) AS n, CAST(sum(ref) AS BIGINT) AS total FROM c GROUP BY root, type")
def relation_closure(ds: Dataset) -> DataFrame:
    return joins.closure(ds).groupBy("relation_id", "type").agg(F.count("*").alias("n"), F.sum("ref").alias("total"))


@query(f"{CLOSURE}{BOXES} SELECT root AS relation_id, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM c JOIN b ON type = 'way' AND way_id = ref GROUP BY root")
def relation_bbox(ds: Dataset) -> DataFrame:
    return joins.relation_boxes(ds)


@query(f"{CLOSURE} SELECT DISTINCT ref AS id FROM c WHERE type = 'way'")
def relation_way_members(ds: Dataset) -> DataFrame:
    return joins.relation_way_ids(ds)


@query(f"{CLOSURE} SELECT id FROM ways WHERE id NOT IN (SELECT ref FROM c WHERE type = 'way')")
def ways_outside_relations(ds: Dataset) -> DataFrame:
    return ds.ways.join(joins.relation_way_ids(ds), "id", "left_anti").select("id")


@query("SELECT way_id, ref FROM (SELECT DISTINCT id AS way_id, unnest(refs) + 1 AS ref FROM ways) WHERE ref NOT IN (SELECT id FROM nodes)")
def missing_refs(ds: Dataset) -> DataFrame:
    """Over references moved by one, so that some have no node."""
    moved = Dataset(ds.nodes, ds.ways.withColumn("refs", F.transform("refs", lambda r: r + 1)), ds.relations)
    return joins.missing_refs(moved)


@query("SELECT id, CASE WHEN tags['maxspeed'] = '50' THEN 50 WHEN tags['maxspeed'] = '30 mph' THEN 48 WHEN tags['maxspeed'] = 'walk' THEN 5 ELSE CASE tags['highway'] WHEN 'motorway' THEN 120 WHEN 'primary' THEN 80 WHEN 'residential' THEN 30 WHEN 'footway' THEN 5 WHEN 'service' THEN 20 ELSE 50 END END AS kph FROM ways")
def speed_limit(ds: Dataset) -> DataFrame:
    return ds.ways.select("id", T.speed_limit(F.col("tags")).alias("kph"))


@query("SELECT id, CAST(floor((lon_e7 / 1e7 + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((0.5 - ln((1 + sin(radians(lat_e7 / 1e7))) / (1 - sin(radians(lat_e7 / 1e7)))) / (4 * pi())) * 4096) AS BIGINT) AS y FROM nodes")
def tile_of_node(ds: Dataset) -> DataFrame:
    return ds.nodes.select("id", F.floor(geo.tile_x(F.col("lon_e7") / 1e7, 12)).alias("x"), F.floor(geo.tile_y(F.col("lat_e7") / 1e7, 12)).alias("y"))


@query("SELECT v, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z, v AS back FROM (SELECT id - 1000 AS v FROM nodes)")
def zigzag(ds: Dataset) -> DataFrame:
    v = F.col("id") - 1000
    return ds.nodes.select(v.alias("v"), geo.zigzag(v).alias("z"), geo.unzigzag(geo.zigzag(v)).alias("back"))


@query("SELECT s, replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM (SELECT '<' || p_name || ' & \"' || p_brand || '''s\">' AS s FROM part)", views="")
def xml_escape(ds: Dataset) -> DataFrame:
    part = ds.nodes.sparkSession.read.parquet(f"{ds.name}/part.parquet")
    s = F.concat(F.lit("<"), "p_name", F.lit(' & "'), "p_brand", F.lit("'s\">"))
    return part.select(s.alias("s"), text.xml_escape(s).alias("escaped"))


@query("SELECT s, CASE WHEN regexp_matches(s, '^#?[0-9a-fA-F]{3,4}$') THEN '#' || upper(regexp_replace(replace(s, '#', ''), '(.)', '\\1\\1', 'g')) WHEN regexp_matches(s, '^#?([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$') THEN '#' || upper(replace(s, '#', '')) END AS color FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN '#' ELSE '' END || substr('a0F3c9e1', 1, CAST(p_partkey % 9 AS INTEGER)) AS s FROM part)", views="")
def hex_color(ds: Dataset) -> DataFrame:
    s = F.concat(F.when(F.col("id") % 2 == 0, "#").otherwise(""), F.substring(F.lit("a0F3c9e1"), F.lit(1), (F.col("id") % 9).cast("int")))
    return ds.nodes.select(s.alias("s")).select("s", text.hex_color(F.col("s")).alias("color"))


@query("SELECT way_id, array_to_string([refs[i] for i in range(1, len(refs) + 1) if i = len(refs) OR refs[i] <> refs[i + 1]], ',') AS refs FROM (SELECT id AS way_id, [r // 3 for r in refs] AS refs FROM ways)")
def adjacent_ref_dedup(ds: Dataset) -> DataFrame:
    """Over references divided by three, so that neighbours repeat."""
    refs = F.transform("refs", lambda r: F.floor(r / 3))
    return ds.ways.select(F.col("id").alias("way_id"), refs.alias("refs")).select("way_id", F.array_join(F.transform(T.without_repeats(F.col("refs")), lambda r: r.cast("string")), ",").alias("refs"))


@query("SELECT min(lon_e7) AS west, min(lat_e7) AS south, max(lon_e7) AS east, max(lat_e7) AS north, count(*) AS n FROM nodes")
def dataset_bbox(ds: Dataset) -> DataFrame:
    return ds.nodes.agg(F.min("lon_e7").alias("west"), F.min("lat_e7").alias("south"), F.max("lon_e7").alias("east"), F.max("lat_e7").alias("north"), F.count("*").alias("n"))


@query(f"{WIDE} SELECT kind, count(*) AS entities, CAST(sum(cardinality(tags)) AS BIGINT) AS tag_pairs, CAST(sum(parts) AS BIGINT) AS parts, CAST(max(parts) AS BIGINT) AS longest FROM wide GROUP BY kind")
def load_counters(ds: Dataset) -> DataFrame:
    """Of each kind: entities, tags, references or members, and the most of these in one."""
    parts = F.when(F.col("kind") == "way", F.size("refs")).when(F.col("kind") == "relation", F.size("members")).otherwise(0).cast("long")
    each = ds.wide().select("kind", F.size("tags").alias("tags"), parts.alias("parts"))
    return each.groupBy("kind").agg(F.count("*").alias("entities"), F.sum("tags").alias("tag_pairs"), F.sum("parts").alias("parts"), F.max("parts").alias("longest"))


@query(f"SELECT DISTINCT w.id FROM (SELECT id, unnest(refs) AS ref FROM ways) w JOIN nodes n ON n.id = w.ref WHERE {E7}")
def ways_touching_bbox(ds: Dataset) -> DataFrame:
    return extract.ways_touching(ds, spatial.nodes_in_box(ds.nodes, BOX))


IN = f", i AS (SELECT id FROM nodes WHERE {E7}), w AS (SELECT DISTINCT x.id FROM (SELECT id, unnest(refs) AS ref FROM ways) x JOIN i ON i.id = x.ref)"


def _summary(ds: Dataset) -> DataFrame:
    n = ds.nodes.select(F.lit("node").alias("kind"), "id", F.lit(0).alias("parts"))
    w = ds.ways.select(F.lit("way").alias("kind"), "id", F.size("refs").alias("parts"))
    return n.unionByName(w).unionByName(ds.relations.select(F.lit("relation").alias("kind"), "id", F.size("members").alias("parts")))


RELS = CLOSURE + ", h AS (SELECT DISTINCT root AS id FROM c WHERE type = 'way' AND ref IN (SELECT id FROM w)), k AS (SELECT relations.id, members, tags FROM relations JOIN h USING (id))"
CUT = "len([m for m in members if (m.type = 'way' AND m.ref IN (SELECT id FROM w)) OR (m.type = 'relation' AND m.ref IN (SELECT id FROM h))])"
_RELATION_PARTS = "SELECT 'relation', k.id, CAST(count(CASE WHEN (m.type = 'way' AND w.id IS NOT NULL) OR (m.type = 'relation' AND h.id IS NOT NULL) THEN 1 END) AS INTEGER) FROM (SELECT id, unnest(members) AS m FROM k) k LEFT JOIN w ON w.id = m.ref LEFT JOIN h ON h.id = m.ref GROUP BY k.id"


@query(f"{IN}{RELS} SELECT 'node' AS kind, id, 0 AS parts FROM i UNION ALL SELECT 'way', id, CAST(count(*) AS INTEGER) FROM (SELECT ways.id, unnest(refs) AS ref FROM ways JOIN w USING (id)) x WHERE ref IN (SELECT id FROM i) GROUP BY id UNION ALL {_RELATION_PARTS}")
def extract_simple(ds: Dataset) -> DataFrame:
    return _summary(extract.extract(ds, BOX, "simple"))


@query(f"{IN}{RELS} SELECT 'node' AS kind, id, 0 AS parts FROM (SELECT id FROM i UNION SELECT unnest(refs) FROM ways JOIN w USING (id)) UNION ALL SELECT 'way', id, CAST(len(refs) AS INTEGER) FROM ways JOIN w USING (id) UNION ALL {_RELATION_PARTS}")
def extract_complete_ways(ds: Dataset) -> DataFrame:
    return _summary(extract.extract(ds, BOX, "complete_ways"))


@query(f"""{IN}{RELS}, s AS (SELECT id, unnest(members) AS m FROM k WHERE tags['type'] = 'multipolygon'), v AS (SELECT id FROM w UNION SELECT m.ref FROM s WHERE m.type = 'way')
SELECT 'node' AS kind, id, 0 AS parts FROM (SELECT id FROM i UNION SELECT unnest(refs) FROM ways JOIN v USING (id)) UNION ALL SELECT 'way', id, CAST(len(refs) AS INTEGER) FROM ways JOIN v USING (id)
UNION ALL SELECT 'relation', k.id, CAST(count(CASE WHEN k.whole OR (m.type = 'way' AND w.id IS NOT NULL) OR (m.type = 'relation' AND h.id IS NOT NULL) THEN 1 END) AS INTEGER) FROM (SELECT id, coalesce(tags['type'] = 'multipolygon', false) AS whole, unnest(members) AS m FROM k) k LEFT JOIN w ON w.id = m.ref LEFT JOIN h ON h.id = m.ref GROUP BY k.id""")
def extract_smart(ds: Dataset) -> DataFrame:
    return _summary(extract.extract(ds, BOX, "smart"))


@query("SELECT id, tags['highway'] AS kind FROM ways WHERE tags['highway'] IN ('motorway', 'primary', 'residential', 'footway', 'service')")
def layer_streets(ds: Dataset) -> DataFrame:
    return ds.ways.withColumn("kind", layers.kinds(F.col("tags"))["streets"]).where("kind is not null").select("id", "kind")


@query("SELECT id, tags['amenity'] AS kind FROM nodes WHERE tags['amenity'] IN ('restaurant', 'cafe', 'bank', 'parking', 'fuel')")
def layer_pois(ds: Dataset) -> DataFrame:
    return ds.nodes.withColumn("kind", layers.kinds(F.col("tags"))["pois"]).where("kind is not null").select("id", "kind")


@query("SELECT id, tags['place'] AS kind, tags['name'] AS name, tags['population'] || '.0' AS population FROM nodes WHERE tags['place'] IS NOT NULL")
def layer_places(ds: Dataset) -> DataFrame:
    p = ds.nodes.withColumns({"kind": layers.kinds(F.col("tags"))["places"], "p": layers.properties(F.col("tags"), "places")})
    return p.where("kind is not null").select("id", "kind", F.col("p")["name"].alias("name"), F.col("p")["population"].alias("population"))


@query(f"""{CLOSURE}{BOXES} SELECT root AS relation_id FROM c JOIN b ON type = 'way' AND way_id = ref GROUP BY root HAVING min(west) <= 74120000 AND max(east) >= 74100000 AND min(south) <= 437270000 AND max(north) >= 437250000""")
def relations_bbox_intersects(ds: Dataset) -> DataFrame:
    return spatial.boxes_meeting(joins.relation_boxes(ds), (7.41, 43.725, 7.412, 43.727)).select("relation_id")


_VIEW = "SELECT way_id FROM b WHERE west <= {2} AND east >= {0} AND south <= {3} AND north >= {1}"


@query(f"{BOXES} {_VIEW.format(74010000, 437250000, 74020000, 437270000)} UNION {_VIEW.format(74015000, 437260000, 74030000, 437300000)}")
def viewport_ways(ds: Dataset) -> DataFrame:
    """Ways that meet any of a viewport's boxes, each once."""
    return spatial.boxes_meeting_any(joins.way_boxes(ds), [(7.401, 43.725, 7.402, 43.727), (7.4015, 43.726, 7.403, 43.73)]).select("way_id")


@query(f"""{IN}, iw AS (SELECT id, CAST(count(*) AS INTEGER) AS parts FROM (SELECT id, unnest(refs) AS ref FROM ways WHERE tags['highway'] = 'primary') x WHERE ref IN (SELECT id FROM i) GROUP BY id)
SELECT 'node' AS kind, id, 0 AS parts FROM i UNION ALL SELECT 'way', id, parts FROM iw UNION ALL SELECT 'relation', id, CAST(count(*) AS INTEGER) FROM (SELECT id, unnest(members, max_depth := 2) FROM relations WHERE tags['name'] IS NOT NULL AND id % 2 = 0) m WHERE type = 'way' AND ref IN (SELECT id FROM iw) GROUP BY id""")
def ingest_filter(ds: Dataset) -> DataFrame:
    return _summary(extract.ingest(ds, BOX, {"ways": [("highway", "primary")], "relations": [("name", None)]}, {"relations": F.col("id") % 2 == 0}))
