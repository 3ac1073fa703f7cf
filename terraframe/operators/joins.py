"""References to coordinates, boxes, members and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions import geo
from terraframe.model import Dataset, checkpointed

MAX_DEPTH = 10


def way_points(ds: Dataset, ways: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(way_id, pos, ref, lon_e7, lat_e7): the ways' references with their nodes' coordinates. References without a node
    go; with strict they stay, with null coordinates. References are joined by a shuffle on the node id: the size of
    compressed files doesn't tell whether all nodes can be broadcast."""
    refs = (ds.ways if ways is None else ways).select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "ref"))
    points = ds.nodes.select(F.col("id").alias("ref"), "lon_e7", "lat_e7").hint("merge")
    return refs.join(points, "ref", "left" if strict else "inner").select("way_id", "pos", "ref", "lon_e7", "lat_e7")


def way_lines(ds: Dataset, ways: DataFrame | None = None) -> DataFrame:
    """(way_id, line): coordinates in the order of the references."""
    points = way_points(ds, ways).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon_e7", "lat_e7"))).alias("p"))
    return points.select("way_id", F.transform("p", lambda p: F.struct(p["lon_e7"].alias("lon_e7"), p["lat_e7"].alias("lat_e7"))).alias("line"))


def missing_refs(ds: Dataset) -> DataFrame:
    """(way_id, ref) of references without a node."""
    refs = ds.ways.select(F.col("id").alias("way_id"), F.explode("refs").alias("ref")).distinct()
    return refs.join(ds.nodes.select(F.col("id").alias("ref")), "ref", "left_anti").select("way_id", "ref")


def _box(group: str, df: DataFrame) -> DataFrame:
    return df.groupBy(group).agg(F.min("lon_e7").alias("west"), F.min("lat_e7").alias("south"), F.max("lon_e7").alias("east"), F.max("lat_e7").alias("north"))


def way_boxes(ds: Dataset, ways: DataFrame | None = None) -> DataFrame:
    """(way_id, west, south, east, north) in 1e-7 degrees over all references that have a node."""
    return _box("way_id", way_points(ds, ways))


def members(ds: Dataset) -> DataFrame:
    """(relation_id, pos, type, ref, role)."""
    return ds.relations.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("pos", "m")).select("relation_id", "pos", "m.*")


def closure(ds: Dataset, depth: int = MAX_DEPTH) -> DataFrame:
    """(relation_id, type, ref): all direct and nested members, each once; a relation may be its own descendant. Nesting
    is followed down to depth levels; one join a level, which ends early where nothing new is found."""
    m = members(ds).select("relation_id", "type", "ref").distinct()
    nested = m.where("type = 'relation'").select(F.col("relation_id").alias("root"), F.col("ref").alias("at"))
    steps = m.where("type = 'relation'").select(F.col("relation_id").alias("at"), F.col("ref").alias("next"))
    found = frontier = checkpointed(nested)
    for _ in range(depth - 1):
        frontier = checkpointed(frontier.join(steps, "at").select("root", F.col("next").alias("at")).distinct().join(found, ["root", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    own = m.select(F.col("relation_id").alias("at"), "type", "ref")
    below = found.join(own, "at").select(F.col("root").alias("relation_id"), "type", "ref")
    return m.unionByName(below).distinct()


def relation_boxes(ds: Dataset) -> DataFrame:
    """(relation_id, box) over the nodes, and the nodes of the ways, of the whole closure."""
    c = closure(ds)
    direct = c.where("type = 'node'").select("relation_id", "ref")
    by_way = c.where("type = 'way'").select("relation_id", F.col("ref").alias("way_id")).join(ds.ways.select(F.col("id").alias("way_id"), F.explode("refs").alias("ref")), "way_id").select("relation_id", "ref")
    points = direct.unionByName(by_way).distinct().join(ds.nodes.select(F.col("id").alias("ref"), "lon_e7", "lat_e7"), "ref")
    return _box("relation_id", points)


def relation_way_ids(ds: Dataset) -> DataFrame:
    """Ids of all ways that some relation has, nested or not."""
    return closure(ds).where("type = 'way'").select(F.col("ref").alias("id")).distinct()


def relation_points(ds: Dataset) -> DataFrame:
    """(relation_id, pos, ref, lon_e7, lat_e7) of node members that have coordinates."""
    m = members(ds).where("type = 'node'")
    return m.join(ds.nodes.select(F.col("id").alias("ref"), "lon_e7", "lat_e7"), "ref").select("relation_id", "pos", "ref", "lon_e7", "lat_e7")


def segments(ds: Dataset, ways: DataFrame | None = None, **carried: Column) -> DataFrame:
    """(way_id, pos, a, b, coordinates of both, carried): neighbouring references with their coordinates; segments with a
    missing end go. Both ends come from one pass over the references; carried columns of the way come along, so that no join
    has to fetch them. As in way_points, nodes aren't broadcast."""
    w = (ds.ways if ways is None else ways).select(F.col("id").alias("way_id"), *[c.alias(k) for k, c in carried.items()], F.posexplode(F.arrays_zip(F.col("refs").alias("a"), F.slice("refs", F.lit(2), F.size("refs")).alias("b"))).alias("pos", "s")).select("way_id", "pos", F.col("s.a").alias("a"), F.col("s.b").alias("b"), *carried).where("b is not null")
    n = ds.nodes
    a = n.select(F.col("id").alias("a"), F.col("lon_e7").alias("ax"), F.col("lat_e7").alias("ay"))
    b = n.select(F.col("id").alias("b"), F.col("lon_e7").alias("bx"), F.col("lat_e7").alias("by"))
    return w.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("way_id", "pos", "a", "b", "ax", "ay", "bx", "by", *carried)


def segment_length(s: DataFrame) -> DataFrame:
    return s.withColumn("meters", geo.haversine_e7(*(F.col(c) for c in ("ax", "ay", "bx", "by"))))
