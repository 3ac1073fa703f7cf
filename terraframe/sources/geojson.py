"""GeoJSON: features to entities, entities to features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.functions.text import feature_id
from terraframe.model import MEMBER, Dataset
from terraframe.operators import joins

FEATURE = "struct<type:string,id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
POINT, LINE, RINGS, MULTI = "array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, tags, kind, coordinates as JSON text) of FeatureCollections, in file order."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.from_json("value", f"struct<features:array<{FEATURE}>>").alias("c")).select(F.posexplode("c.features").alias("ord", "f"))
    tags = F.map_filter("f.properties", lambda _, v: v.isNotNull())
    return rows.select("ord", feature_id(F.col("f.id")).alias("id"), F.coalesce(tags, F.expr("cast(map() as map<string,string>)")).alias("tags"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def _e7(c):
    return F.floor(c * 1e7 + 0.5).cast("int")


def to_dataset(features: DataFrame) -> Dataset:
    """Points become nodes, lines ways, polygons closed ways with area=yes, or with holes (and MultiPolygons) relations of
    the type multipolygon, MultiLineStrings relations of the type multilinestring. Vertices at one place share a node. New
    ids are negative, by the order of features: a feature's own id stays where it has one. MultiPoints are left out; a ring
    that isn't closed raises."""
    f = features.persist()
    points = f.where("kind = 'Point'").select("ord", "id", "tags", F.from_json("coordinates", POINT).alias("p"))
    lines = f.where("kind = 'LineString'").select("ord", F.lit(0).alias("part"), F.lit(None).cast("string").alias("role"), F.from_json("coordinates", LINE).alias("line"))
    many = f.where("kind = 'MultiLineString'").select("ord", F.posexplode(F.from_json("coordinates", RINGS)).alias("part", "line"), F.lit("").alias("role"))
    polygons = f.where("kind = 'Polygon'").select("ord", F.array(F.from_json("coordinates", RINGS)).alias("polys")).unionByName(f.where("kind = 'MultiPolygon'").select("ord", F.from_json("coordinates", MULTI).alias("polys")))
    rings = polygons.select("ord", F.posexplode("polys").alias("poly", "rings")).select("ord", "poly", F.posexplode("rings").alias("ring", "line"))
    open_ = F.element_at("line", 1) != F.element_at("line", -1)
    rings = rings.where(F.when(open_, F.raise_error(F.lit("a ring is not closed")).cast("boolean")).otherwise(True))
    rings = rings.select("ord", (F.col("poly") * 100_000 + F.col("ring")).alias("part"), F.when(F.col("ring") == 0, "outer").otherwise("inner").alias("role"), "line")
    parts = lines.unionByName(many).unionByName(rings).select("ord", "part", "role", F.posexplode("line").alias("pos", "p"))
    vertices = parts.select("ord", "part", "role", "pos", _e7(F.get("p", F.lit(0))).alias("lon_e7"), _e7(F.get("p", F.lit(1))).alias("lat_e7"))
    at = points.select("ord", "id", "tags", _e7(F.get("p", F.lit(0))).alias("lon_e7"), _e7(F.get("p", F.lit(1))).alias("lat_e7"))
    named = at.groupBy("lon_e7", "lat_e7").agg(F.min_by(F.struct("id", "tags"), "ord").alias("t"), F.min("ord").alias("o"))
    spots = vertices.groupBy("lon_e7", "lat_e7").agg(F.min(F.struct("ord", "part", "pos")).alias("v")).join(named, ["lon_e7", "lat_e7"], "full")
    key = F.struct(F.coalesce("o", F.col("v.ord")).alias("o"), F.coalesce("v.part", F.lit(-1)).alias("part"), F.coalesce("v.pos", F.lit(-1)).alias("pos"))
    from terraframe.operators.change import new_ids

    none = f.sparkSession.createDataFrame([(0,)], "id long")
    numbered = new_ids(spots.withColumn("k", key).select("lon_e7", "lat_e7", "t", F.col("k.o").alias("ko"), F.col("k.part").alias("kp"), F.col("k.pos").alias("ks")), none, ["ko", "kp", "ks"])
    nodes = numbered.select(F.coalesce("t.id", -F.col("id")).alias("id"), "lon_e7", "lat_e7", F.coalesce("t.tags", F.expr("cast(map() as map<string,string>)")).alias("tags")).persist()
    refs = vertices.join(nodes.select(F.col("id").alias("ref"), "lon_e7", "lat_e7"), ["lon_e7", "lat_e7"]).groupBy("ord", "part", "role").agg(F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("x")).select("ord", "part", "role", F.transform("x", lambda x: x["ref"]).alias("refs"))
    ways = new_ids(refs, none, ["ord", "part"]).withColumnRenamed("id", "n").join(f.select("ord", F.col("id").alias("own"), "tags", "kind"), "ord")
    single = ways.groupBy("ord").agg(F.count("*").alias("parts"))
    ways = ways.join(single, "ord").withColumn("whole", (F.col("kind") == "LineString") | ((F.col("kind") == "Polygon") & (F.col("parts") == 1))).persist()
    area = F.create_map(F.lit("area"), F.lit("yes"))
    tags = F.when(F.col("kind") == "MultiLineString", F.expr("cast(map() as map<string,string>)")).when(~F.col("whole"), area).when(F.col("kind") == "Polygon", F.map_concat(F.map_filter("tags", lambda k, _: k != "area"), area)).otherwise(F.col("tags"))
    out_ways = ways.select(F.when(F.col("whole"), F.coalesce("own", -F.col("n"))).otherwise(-F.col("n")).alias("id"), "refs", tags.alias("tags"))
    member = F.struct(F.lit("way").alias("type"), (-F.col("n")).alias("ref"), "role")
    groups = ways.where("not whole").groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("part", member.alias("m")))).alias("x"), F.first("own").alias("own"), F.first("tags").alias("tags"), F.first("kind").alias("kind"))
    kind = F.create_map(F.lit("type"), F.when(F.col("kind") == "MultiLineString", "multilinestring").otherwise("multipolygon"))
    relations = new_ids(groups, none, ["ord"]).select(F.coalesce("own", -F.col("id")).alias("id"), F.transform("x", lambda x: x["m"]).cast(f"array<{MEMBER}>").alias("members"), F.map_concat(F.map_filter("tags", lambda k, _: k != "type"), kind).alias("tags"))
    return Dataset(nodes, out_ways, relations)


def features(ds: Dataset) -> DataFrame:
    """(kind, id, feature): nodes and ways as GeoJSON text; ways that are areas as polygons."""
    from terraframe.functions import tags as T

    coordinate = lambda x, y: F.array(x / 1e7, y / 1e7)
    text = lambda kind, geometry, coordinates: F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"), F.struct(geometry.alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.col("tags").alias("properties")))
    n = ds.nodes.select(F.lit("node").alias("kind"), "id", text("node", F.lit("Point"), coordinate(F.col("lon_e7"), F.col("lat_e7"))).alias("feature"))
    lines = joins.way_lines(ds).withColumnRenamed("way_id", "id").join(ds.ways, "id").withColumn("c", F.transform("line", lambda p: coordinate(p["lon_e7"], p["lat_e7"])))
    area = T.is_area(F.col("refs"), F.col("tags"))
    w = lines.select(F.lit("way").alias("kind"), "id", F.when(area, text("way", F.lit("Polygon"), F.array("c"))).otherwise(text("way", F.lit("LineString"), F.col("c"))).alias("feature"))
    return n.unionByName(w)


def relation_features(ds: Dataset) -> DataFrame:
    """(kind, id, feature): relations as GeoJSON text. Areas are polygons, lines and points what they are, Multi unless there
    is one part, and empty without any; other relations are empty collections."""
    from terraframe.functions import tags as T
    from terraframe.operators import geometry

    at = ds.nodes.select(F.col("id").alias("ref"), F.array(F.col("lon_e7") / 1e7, F.col("lat_e7") / 1e7).alias("c"))

    def gathered(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("x")).select(*keys, F.transform("x", lambda x: x[value]).alias("c"))

    def drawn(df: DataFrame, keys: list[str]) -> DataFrame:
        return gathered(df.select(*keys, F.posexplode("refs").alias("pos", "ref")).join(at, "ref"), keys, "pos", "c")

    polygons = gathered(gathered(drawn(geometry.rings(ds), ["relation_id", "polygon", "ring"]), ["relation_id", "polygon"], "ring", "c"), ["relation_id"], "polygon", "c")
    lines = gathered(drawn(geometry.lines(ds), ["relation_id", "line"]), ["relation_id"], "line", "c")
    points = gathered(joins.members(ds).where("type = 'node'").join(at, "ref"), ["relation_id"], "pos", "c")
    r = ds.relations.withColumn("kind", T.relation_kind(F.col("tags"), F.col("members")))
    for name, df in (("polygons", polygons), ("lines", lines), ("points", points)):
        r = r.join(df.select(F.col("relation_id").alias("id"), F.col("c").alias(name)), "id", "left")

    def text(kind: str, **parts: Column) -> Column:
        body = F.struct(F.lit(kind).alias("type"), *[c.alias(k) for k, c in parts.items()])
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"), body.alias("geometry"), F.col("tags").alias("properties")))

    def parts(name: str, single: str) -> Column:
        none = F.array().cast("array<string>")
        return F.when(F.col(name).isNull(), text(f"Multi{single}", coordinates=none)).when(F.size(name) == 1, text(single, coordinates=F.get(name, F.lit(0)))).otherwise(text(f"Multi{single}", coordinates=F.col(name)))

    kind = F.col("kind")
    feature = F.when(kind == "area", parts("polygons", "Polygon")).when(kind == "line", parts("lines", "LineString")).when(kind == "point", parts("points", "Point")).otherwise(text("GeometryCollection", geometries=F.array().cast("array<string>")))
    return r.select(F.lit("relation").alias("kind"), "id", feature.alias("feature"))
