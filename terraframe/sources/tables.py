"""The star-schema tables as a map: parts are nodes, orders with their line items ways (those of buildings and water closed),
customers, nations and regions nested relations; an order in seven is in no relation. The same arithmetic is in VIEWS for
DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.model import Dataset


def _tags(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k.replace("__", ":")), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def pick(c: Column, n: int, *values: str | None) -> Column:
    """The c mod n-th of values; null beyond."""
    m, out = F.pmod(c, F.lit(n)), F.lit(None).cast("string")
    for i, v in enumerate(values):
        if v is not None:
            out = F.when(m == i, F.lit(v)).otherwise(out)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    k = i - F.when(i % 10 == 9, 1).otherwise(0)
    place = pick(i, 40, "city", None, None, None, None, "town", None, None, None, None, "village")
    tags = _tags(
        amenity=pick(i, 8, "restaurant", "cafe", "bank", "parking", "fuel"),
        brand=F.when(i % 2 == 0, F.col("p_brand")),
        place=place,
        name=F.when(place.isNotNull(), F.concat(F.lit("Place "), i)),
        population=F.when(place.isNotNull(), F.col("p_size") * 1000),
        ext__osm_version=F.when(i % 5 == 0, F.col("p_size") % 3),
    )
    return p.select(i.alias("id"), (F.lit(74000000) + (k * 7919) % 400000).cast("int").alias("lon_e7"), (F.lit(437200000) + (k * 104729) % 350000).cast("int").alias("lat_e7"), tags.alias("tags"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    refs = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x")).select("l_orderkey", F.transform("x", lambda x: x["l_partkey"]).alias("refs"))
    i, p = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    road = i % 11 != 0
    highway = F.when(p == "1", "motorway").when(p == "2", "primary").when(p == "3", "residential").when(p == "4", "footway").otherwise("service")
    tags = _tags(
        highway=F.when(road, highway),
        oneway=F.when(road & (F.col("o_orderstatus") == "F"), "yes"),
        maxspeed=F.when(road, pick(i, 4, "50", "30 mph", "walk")),
        name=F.when(road, F.concat(F.lit("Street "), F.col("o_custkey"))),
        building=F.when(i % 22 == 0, "yes"),
        natural=F.when(i % 22 == 11, "water"),
        bridge=F.when(i % 37 == 0, "yes"),
        layer=F.when(i % 37 == 0, "1"),
        ext__osm_version=F.when(i % 5 == 0, i % 3),
    )
    closed = F.when(road, F.col("refs")).otherwise(F.concat("refs", F.slice("refs", 1, 1)))
    # all orders on one side: the size of compressed files doesn't tell whether they can be broadcast
    return o.join(refs.hint("merge"), F.col("l_orderkey") == i).select(i.alias("id"), closed.alias("refs"), tags.alias("tags"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    member = lambda kind, ref, role: F.array_sort(F.collect_list(F.struct(F.lit(kind).alias("type"), ref.cast("long").alias("ref"), role.alias("role"))))
    role = F.when(F.col("o_orderkey") % 2 == 0, "outer").otherwise("inner")
    held = read("orders").where("o_orderkey % 7 <> 3")
    c = read("customer").join(held.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_mktsegment").agg(member("way", F.col("o_orderkey"), role).alias("members"))
    m = F.col("c_mktsegment")
    kind = F.when(m == "BUILDING", "multipolygon").when(m == "AUTOMOBILE", "route").when(m == "MACHINERY", "multipoint").when(m == "FURNITURE", "boundary")
    c = c.select((F.col("c_custkey") + 1000).alias("id"), "members", _tags(type=kind, name=F.concat(F.lit("Customer "), "c_custkey"), building=F.when(m == "BUILDING", "yes"), natural=F.when(m == "FURNITURE", "wood")).alias("tags"))
    n = read("nation").join(read("customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(member("relation", F.col("c_custkey") + 1000, F.lit("")).alias("members"))
    n = n.select((F.col("n_nationkey") + 100).cast("long").alias("id"), "members", _tags(type=F.lit("collection"), name=F.col("n_name")).alias("tags"))
    r = read("region").join(read("nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(member("relation", F.col("n_nationkey") + 100, F.lit("")).alias("members"))
    r = r.select((F.col("r_regionkey") + 1).cast("long").alias("id"), "members", _tags(name=F.col("r_name")).alias("tags"))
    return c.unionByName(n).unionByName(r)


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(nodes(spark, sf_dir), ways(spark, sf_dir), relations(spark, sf_dir), sf_dir)


def part_of(ds: Dataset, remainder: int) -> Dataset:
    """Two overlapping versions of a map for comparing and merging: of each entity kind, those whose id has another
    remainder modulo 3; in version 1, every fifth has another name."""

    def cut(df: DataFrame) -> DataFrame:
        kept = df.where(F.col("id") % 3 != remainder)
        if remainder != 1:
            return kept
        renamed = F.map_concat(F.map_filter("tags", lambda k, _: k != "name"), F.create_map(F.lit("name"), F.concat(F.lit("New "), F.col("id").cast("string"))))
        return kept.withColumn("tags", F.when(F.col("id") % 5 == 0, renamed).otherwise(F.col("tags")))

    return Dataset(cut(ds.nodes), cut(ds.ways), cut(ds.relations), f"{ds.name}#{remainder}")


def _map(**values: str) -> str:
    pairs = ", ".join(f"{{'k': '{k.replace('__', ':')}', 'v': CAST({v} AS VARCHAR)}}" for k, v in values.items())
    return f"map_from_entries(list_filter([{pairs}], lambda e: e.v IS NOT NULL))"


def _pick(c: str, n: int, *values: str | None) -> str:
    return "CASE " + " ".join(f"WHEN {c} % {n} = {i} THEN '{v}'" for i, v in enumerate(values) if v) + " END"


_PLACE = _pick("p_partkey", 40, "city", None, None, None, None, "town", None, None, None, None, "village")
_ROAD = "o_orderkey % 11 <> 0"
#: DuckDB: WITH nodes, ways and relations as above.
VIEWS = f"""WITH RECURSIVE nodes AS (SELECT p_partkey AS id, CAST(74000000 + (k * 7919) % 400000 AS INTEGER) AS lon_e7, CAST(437200000 + (k * 104729) % 350000 AS INTEGER) AS lat_e7,
  {_map(amenity=_pick("p_partkey", 8, "restaurant", "cafe", "bank", "parking", "fuel"), brand="CASE WHEN p_partkey % 2 = 0 THEN p_brand END", place=_PLACE, name=f"CASE WHEN {_PLACE} IS NOT NULL THEN 'Place ' || p_partkey END", population=f"CASE WHEN {_PLACE} IS NOT NULL THEN p_size * 1000 END", ext__osm_version="CASE WHEN p_partkey % 5 = 0 THEN p_size % 3 END")} AS tags
  FROM (SELECT *, p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END AS k FROM part)),
way_refs AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS refs FROM lineitem GROUP BY l_orderkey),
ways AS (SELECT o_orderkey AS id, CASE WHEN {_ROAD} THEN refs ELSE list_append(refs, refs[1]) END AS refs,
  {_map(highway=f"CASE WHEN {_ROAD} THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'primary' WHEN '3' THEN 'residential' WHEN '4' THEN 'footway' ELSE 'service' END END", oneway=f"CASE WHEN {_ROAD} AND o_orderstatus = 'F' THEN 'yes' END", maxspeed=f"CASE WHEN {_ROAD} THEN {_pick('o_orderkey', 4, '50', '30 mph', 'walk')} END", name=f"CASE WHEN {_ROAD} THEN 'Street ' || o_custkey END", building="CASE WHEN o_orderkey % 22 = 0 THEN 'yes' END", natural="CASE WHEN o_orderkey % 22 = 11 THEN 'water' END", bridge="CASE WHEN o_orderkey % 37 = 0 THEN 'yes' END", layer="CASE WHEN o_orderkey % 37 = 0 THEN '1' END", ext__osm_version="CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 END")} AS tags
  FROM orders JOIN way_refs ON l_orderkey = o_orderkey),
relations AS (
  SELECT c_custkey + 1000 AS id, list({{'type': 'way', 'ref': o_orderkey, 'role': CASE WHEN o_orderkey % 2 = 0 THEN 'outer' ELSE 'inner' END}} ORDER BY o_orderkey) AS members,
    {_map(type="CASE c_mktsegment WHEN 'BUILDING' THEN 'multipolygon' WHEN 'AUTOMOBILE' THEN 'route' WHEN 'MACHINERY' THEN 'multipoint' WHEN 'FURNITURE' THEN 'boundary' END", name="'Customer ' || c_custkey", building="CASE c_mktsegment WHEN 'BUILDING' THEN 'yes' END", natural="CASE c_mktsegment WHEN 'FURNITURE' THEN 'wood' END")} AS tags
  FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderkey % 7 <> 3 GROUP BY c_custkey, c_mktsegment
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), list({{'type': 'relation', 'ref': c_custkey + 1000, 'role': ''}} ORDER BY c_custkey), {_map(type="'collection'", name="n_name")}
  FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name
  UNION ALL SELECT CAST(r_regionkey + 1 AS BIGINT), list({{'type': 'relation', 'ref': CAST(n_nationkey + 100 AS BIGINT), 'role': ''}} ORDER BY n_nationkey), {_map(name="r_name")}
  FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name)"""


def _cut(name: str, remainder: int) -> str:
    new = "CASE WHEN id % 5 = 0 THEN map_from_entries(list_concat(list_filter(map_entries(tags), lambda e: e.key <> 'name'), [{'key': 'name', 'value': 'New ' || id}])) ELSE tags END AS tags"
    return f"SELECT * {'REPLACE (' + new + ')' if remainder == 1 else ''} FROM {name} WHERE id % 3 <> {remainder}"


#: The same, with base_ and patch_ versions (part_of 2 and 1).
VERSIONS = VIEWS + "".join(f", {v}_{n} AS ({_cut(n, r)})" for v, r in (("base", 2), ("patch", 1)) for n in ("nodes", "ways", "relations"))
