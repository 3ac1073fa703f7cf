"""Round trips through file formats, feeds, and the layer matchers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions import layers
from terraframe.model import Dataset, entity_texts, fingerprint
from terraframe.plans.base import query, tags_sql, tags_text
from terraframe.plans.lookup import POINTS
from terraframe.sources import geojson, gtfs, pbf
from terraframe.sources.tables import _pick, _tags, pick


_TEXTS = f"""SELECT 'node' AS kind, id, lon_e7 || ' ' || lat_e7 AS body, {tags_sql()} FROM nodes UNION ALL SELECT 'way', id, array_to_string(refs, ','), {tags_sql()} FROM ways
UNION ALL SELECT 'relation', id, array_to_string([m.type || ' ' || m.ref || ' ' || m.role for m in members], ','), {tags_sql()} FROM relations"""


@query(_TEXTS)
def pbf_round_trip(ds: Dataset) -> DataFrame:
    """All entities, encoded as PBF blobs and decoded again."""
    back = pbf.of_files(pbf.encoded(ds).select(F.col("blob").alias("content")))
    return entity_texts(back)


@query(f"SELECT count(*) AS entities, bit_xor(CAST('0x' || substr(md5(kind || '|' || id || '|' || body || '|' || tags), 1, 15) AS BIGINT)) AS hash FROM ({_TEXTS})")
def content_hash(ds: Dataset) -> DataFrame:
    return fingerprint(ds)


@query()
def geojson_relations(ds: Dataset) -> DataFrame:
    own = "struct<geometry:struct<type:string,coordinates:string>>"
    return geojson.relation_features(ds).select("id", F.from_json("feature", own).alias("f"), F.sha2("feature", 256).alias("feature_sha256")).select("id", F.col("f.geometry.type").alias("geometry"), F.length("f.geometry.coordinates").alias("n_chars"), "feature_sha256")


@query(f"""{POINTS}, s AS (SELECT way_id, count(*) AS points, CAST(sum(CAST(lon_e7 AS BIGINT) * i) AS BIGINT) AS lon, CAST(sum(CAST(lat_e7 AS BIGINT) * i) AS BIGINT) AS lat FROM p GROUP BY way_id)
SELECT 'node' AS kind, id, 'Point' AS geometry, CAST(1 AS BIGINT) AS points, CAST(lon_e7 AS BIGINT) AS lon, CAST(lat_e7 AS BIGINT) AS lat, {tags_sql()} FROM nodes
UNION ALL SELECT 'way', id, CASE WHEN refs[1] = refs[len(refs)] AND len(refs) >= 3 AND (tags['building'] = 'yes' OR tags['natural'] = 'water') THEN 'Polygon' ELSE 'LineString' END, points, lon, lat, {tags_sql()} FROM ways JOIN s ON way_id = id""")
def geojson_round_trip(ds: Dataset) -> DataFrame:
    """Nodes and ways as GeoJSON text, parsed again: sums of coordinates, each times its place."""
    own = "struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    f = geojson.features(ds).select("kind", F.from_json("feature", own).alias("f")).select("kind", F.col("f.id").cast("long").alias("id"), F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("c"), F.coalesce("f.properties", F.expr("cast(map() as map<string,string>)")).alias("tags"))
    line = F.when(F.col("geometry") == "Point", F.array(F.from_json("c", geojson.POINT))).when(F.col("geometry") == "Polygon", F.from_json("c", geojson.RINGS)[0]).otherwise(F.from_json("c", geojson.LINE))
    total = lambda k: F.aggregate(F.transform("line", lambda p, i: F.round(p[k] * 1e7).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return f.withColumn("line", line).select("kind", "id", "geometry", F.size("line").cast("long").alias("points"), total(0).alias("lon"), total(1).alias("lat"), F.expr(tags_text()))


@query("""WITH stops AS (SELECT s_suppkey AS k FROM supplier), shape AS (SELECT 's' || s_suppkey % 12 AS shape_id, count(*) AS points FROM supplier GROUP BY 1 HAVING count(*) >= 2),
trips AS (SELECT 's' || c_custkey % 12 AS shape_id, c_nationkey AS route_id, array_to_string(list('t' || c_custkey ORDER BY 't' || c_custkey), ';') AS ids, count(*) AS n FROM customer WHERE c_custkey % 12 <> 7 GROUP BY 1, 2)
SELECT 'way' AS kind, shape_id || '/' || n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'tram' WHEN 1 THEN 'subway' WHEN 2 THEN 'train' ELSE 'bus' END AS what, CAST(points AS BIGINT) AS parts, ids AS note FROM trips JOIN shape USING (shape_id) JOIN nation ON n_nationkey = route_id
UNION ALL SELECT 'node', 'Stop ' || s_suppkey, CASE s_suppkey % 3 WHEN 1 THEN 'station' WHEN 0 THEN 'platform' END, CAST(0 AS BIGINT), CASE WHEN s_suppkey % 3 = 2 THEN 'subway_entrance' END FROM supplier WHERE s_suppkey % 10 <> 4""", views="")
def gtfs_feed(ds: Dataset) -> DataFrame:
    """A feed of the star-schema tables: suppliers are stops and shape points, nations routes, customers trips."""
    spark = ds.nodes.sparkSession
    read = lambda t: spark.read.parquet(f"{ds.name}/{t}.parquet")
    s, c, n = F.col("s_suppkey"), F.col("c_custkey"), F.col("n_nationkey")
    text = lambda x: x.cast("string")
    lon, lat = text(7.4 + (s % 400) / 10000), text(43.72 + (s % 350) / 10000)
    stops = read("supplier").select(text(s).alias("stop_id"), F.concat(F.lit("Stop "), s).alias("stop_name"), lon.alias("stop_lon"), F.when(s % 10 != 4, lat).alias("stop_lat"), text(s % 3).alias("location_type"))
    shapes = read("supplier").select(F.concat(F.lit("s"), s % 12).alias("shape_id"), text(s).alias("shape_pt_sequence"), lon.alias("shape_pt_lon"), lat.alias("shape_pt_lat"))
    routes = read("nation").select(text(n).alias("route_id"), F.col("n_name").alias("route_long_name"), F.lit("").alias("route_short_name"), text(n % 4).alias("route_type"))
    trips = read("customer").select(F.concat(F.lit("t"), c).alias("trip_id"), text(F.col("c_nationkey")).alias("route_id"), F.when(c % 12 != 7, F.concat(F.lit("s"), c % 12)).otherwise("").alias("shape_id"))
    out = gtfs.to_dataset(stops, routes, trips, shapes)
    tag = lambda k: F.col("tags")[k]
    ways = out.ways.select(F.lit("way").alias("kind"), F.concat(tag("ref:gtfs:shape_id"), F.lit("/"), tag("name")).alias("name"), tag("route").alias("what"), F.size("refs").cast("long").alias("parts"), tag("gtfs:trip_ids").alias("note"))
    nodes = out.nodes.where("size(tags) > 0").select(F.lit("node").alias("kind"), tag("name").alias("name"), tag("public_transport").alias("what"), F.lit(0).cast("long").alias("parts"), tag("railway").alias("note"))
    return ways.unionByName(nodes)


#: Tags of the matchers' query: each part has a value of each key by its number modulo the first number.
MATCHED = {
    "waterway": (13, "river", "dam", "riverbank", "dock"),
    "landuse": (11, "reservoir", "cemetery", "forest", "farm"),
    "leisure": (7, "park", "swimming_pool"),
    "railway": (17, "rail", "station", "tram", "monorail"),
    "route": (19, "ferry", "bus", "train"),
    "aerialway": (23, "gondola", "goods"),
    "man_made": (5, "bridge", "pier", "tower"),
    "boundary": (3, "administrative", "protected_area"),
    "admin_level": (8, "2", "4", "8", "x"),
    "addr__housenumber": (9, "1", ""),
}
_MATCHED = ", ".join(f"{_pick('p_partkey', *v)} AS {k}" for k, v in MATCHED.items())


@query(f"""WITH t AS (SELECT p_partkey AS id, {_MATCHED} FROM part)
SELECT id, CASE WHEN waterway = 'riverbank' THEN 'river' WHEN waterway = 'dock' THEN 'dock' WHEN landuse = 'reservoir' THEN 'reservoir' WHEN leisure = 'swimming_pool' THEN 'swimming_pool' END AS water,
  CASE WHEN waterway IN ('river', 'dam') THEN waterway END AS water_lines, CASE WHEN landuse IN ('cemetery', 'forest') THEN landuse END AS land,
  CASE WHEN leisure IS NOT NULL THEN leisure WHEN railway = 'station' THEN 'railway_station' WHEN landuse = 'cemetery' THEN 'cemetery' END AS sites,
  CASE WHEN leisure IS NOT NULL THEN leisure WHEN man_made = 'tower' THEN 'tower' WHEN railway = 'station' THEN 'railway_station' END AS pois,
  CASE WHEN boundary = 'protected_area' THEN boundary WHEN boundary = 'administrative' THEN CASE admin_level WHEN '2' THEN 'national' WHEN '4' THEN 'regional' WHEN '8' THEN 'local' ELSE 'administrative' END END AS boundary,
  CASE WHEN addr__housenumber = '1' THEN 'address' END AS addresses,
  CASE WHEN railway = 'rail' THEN 'railway' WHEN railway IN ('tram', 'monorail') THEN railway WHEN route = 'bus' THEN 'bus' WHEN route = 'train' THEN 'railway' END AS public_transport,
  CASE WHEN aerialway = 'gondola' THEN aerialway END AS aerialways, CASE WHEN route = 'ferry' THEN route END AS ferries, CASE WHEN man_made = 'bridge' THEN man_made END AS bridges,
  CASE WHEN waterway = 'dam' THEN waterway END AS dams, CASE WHEN man_made = 'pier' THEN man_made END AS piers FROM t""", views="")
def layer_kinds(ds: Dataset) -> DataFrame:
    """The kinds that the matchers give, over parts with tags of many layers."""
    tagged = ds.nodes.select("id", _tags(**{k: pick(F.col("id"), *v) for k, v in MATCHED.items()}).alias("tags"))
    kind = layers.kinds(F.col("tags"))
    return tagged.select("id", *[kind[k].alias(k) for k in ("water", "water_lines", "land", "sites", "pois", "boundary", "addresses", "public_transport", "aerialways", "ferries", "bridges", "dams", "piers")])
