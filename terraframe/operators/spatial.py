"""Searches by place: boxes, radius, nearest neighbours, and joins on a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions import geo
from terraframe.functions.tags import any_of
from terraframe.model import Dataset
from terraframe.operators import joins

Box = tuple[float, float, float, float]


def nodes_in_box(nodes: DataFrame, box: Box, tagged_only: bool = False) -> DataFrame:
    """Nodes inside a box in degrees, edges included; one whose west is east of its east crosses the antimeridian."""
    found = nodes.where(geo.in_box(F.col("lon_e7"), F.col("lat_e7"), box))
    return found.where(F.size("tags") > 0) if tagged_only else found


def nodes_within(nodes: DataFrame, lon: float, lat: float, km: float) -> DataFrame:
    """Nodes within km of a point, with their distance in metres as ``meters``. A box that holds the circle filters first,
    on bare columns."""
    if not (math.isfinite(lon) and math.isfinite(lat)) or abs(lat) > 90:
        raise ValueError("the point is off the globe")
    meters = geo.haversine_m(F.lit(geo.normalize_lon(lon)), F.lit(lat), F.col("lon_e7") / 1e7, F.col("lat_e7") / 1e7)
    if math.isnan(km) or km < 0:
        return nodes.withColumn("meters", meters).where(F.lit(False))
    near = nodes if math.isinf(km) else nodes.where(geo.in_box(F.col("lon_e7"), F.col("lat_e7"), geo.radius_box(geo.normalize_lon(lon), lat, km)))
    return near.withColumn("meters", meters).where(F.col("meters") <= km * 1000 + 1e-9)


def nearest_nodes(nodes: DataFrame, lon: float, lat: float, k: int, km: float = math.inf) -> DataFrame:
    """The k nearest nodes within km, by distance, then id."""
    return nodes_within(nodes, lon, lat, km).orderBy("meters", "id").limit(k)


def nearest_planar(nodes: DataFrame, lon: float, lat: float, k: int) -> DataFrame:
    """The k nearest nodes by squared distance in 1e-7 degrees, as whole numbers."""
    dx, dy = F.col("lon_e7").cast("long") - round(lon * 1e7), F.col("lat_e7").cast("long") - round(lat * 1e7)
    return nodes.withColumn("d2", dx * dx + dy * dy).orderBy("d2", "id").limit(k)


def boxes_meeting(boxes: DataFrame, box: Box) -> DataFrame:
    """Rows (west, south, east, north in 1e-7 degrees) whose box meets a box in degrees."""
    return boxes.where(_meets(box))


def boxes_meeting_any(boxes: DataFrame, views: list[Box]) -> DataFrame:
    """Rows whose box meets any of some boxes, each once: one scan, no union."""
    return boxes.where(any_of([_meets(v) for v in views]))


def _meets(box: Box) -> Column:
    w, s, e, n = geo.box_bounds_e7(box)
    return ((F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s) & (F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north")))


def box_distances(boxes: DataFrame, lon: float, lat: float) -> DataFrame:
    """boxes with their distance from a point as ``meters``, 0 inside; inverted boxes go."""
    c = [F.col(x) / 1e7 for x in ("west", "south", "east", "north")]
    return boxes.where(geo.valid_box(tuple(c))).withColumn("meters", geo.point_box_distance_m(lon, lat, *c))


def nearest_boxes(boxes: DataFrame, key: str, lon: float, lat: float, k: int, km: float = math.inf) -> DataFrame:
    """The k boxes nearest to a point within km, by distance, then key."""
    return box_distances(boxes, lon, lat).where(F.col("meters") <= km * 1000).orderBy("meters", key).limit(k)


def cells(x: Column, y: Column, width: int, height: int) -> Column:
    """The nine cells around a point."""
    around = [F.struct((F.floor(x / width) + i).alias("cx"), (F.floor(y / height) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return F.array(*around)


def node_pairs_within(left: DataFrame, right: DataFrame, meters: float, max_lat: float = 85.0) -> DataFrame:
    """(a, b, meters) with a < b: pairs of nodes of left and right within a distance. An equi-join on grid cells as large as
    the distance; max_lat bounds how far apart two nodes' longitudes can be. Neither side is broadcast: an estimate from the
    size of compressed files doesn't tell how many nodes there are, nor that each has nine cells."""
    unit = 1e7 / (math.pi * geo.EARTH_RADIUS_M / 180)
    height = math.ceil(meters * unit * 1.01)
    width = math.ceil(height / math.cos(math.radians(max_lat)))
    a = left.select(F.col("id").alias("a"), F.col("lon_e7").alias("ax"), F.col("lat_e7").alias("ay"), F.explode(cells(F.col("lon_e7"), F.col("lat_e7"), width, height)).alias("cell"))
    b = right.select(F.col("id").alias("b"), F.col("lon_e7").alias("bx"), F.col("lat_e7").alias("by"), F.struct(F.floor(F.col("lon_e7") / width).alias("cx"), F.floor(F.col("lat_e7") / height).alias("cy")).alias("cell"))
    d = geo.haversine_m(*(F.col(c) / 1e7 for c in ("ax", "ay", "bx", "by")))
    pairs = a.join(b.hint("merge"), "cell").where("a <> b").withColumn("meters", d).where(F.col("meters") <= meters)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "meters").dropDuplicates(["a", "b"])


def box_pairs(boxes: DataFrame, key: str, cell_e7: int) -> DataFrame:
    """(a, b) with a < b: rows whose boxes meet. Boxes are dealt to the grid cells that they touch; a pair counts in the
    cell that holds the south-west corner of its overlap, so no duplicates are made."""
    spread = boxes.select(F.col(key).alias("k"), "west", "south", "east", "north", F.explode(F.sequence(F.floor(F.col("west") / cell_e7), F.floor(F.col("east") / cell_e7))).alias("cx"))
    spread = spread.withColumn("cy", F.explode(F.sequence(F.floor(F.col("south") / cell_e7), F.floor(F.col("north") / cell_e7))))
    a, b = spread.alias("a"), spread.alias("b")
    meet = "a.k < b.k and a.west <= b.east and b.west <= a.east and a.south <= b.north and b.south <= a.north"
    own = f"floor(greatest(a.west, b.west) / {cell_e7}) = a.cx and floor(greatest(a.south, b.south) / {cell_e7}) = a.cy"
    return a.join(b, (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))).where(f"{meet} and {own}").select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))


def segment_crossings(ds: Dataset, ways: DataFrame, cell_e7: int, connectable: Column | None = None) -> DataFrame:
    """(a, b, pos_a, pos_b, x, y): points where segments of different ways cross or touch, by exact whole-number orientation
    of their ends; segments on one line, and those that share an end's place, don't count. connectable: a condition over tags a_tags and b_tags."""
    s = joins.segments(ds, ways).join(ways.select(F.col("id").alias("way_id"), "tags"), "way_id")
    box = s.select("way_id", "pos", "tags", *(F.col(c).cast("long").alias(c) for c in ("ax", "ay", "bx", "by"))).withColumns({"w": F.least("ax", "bx"), "e": F.greatest("ax", "bx"), "s": F.least("ay", "by"), "n": F.greatest("ay", "by")})
    grid = box.withColumn("cx", F.explode(F.sequence(F.floor(F.col("w") / cell_e7), F.floor(F.col("e") / cell_e7)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("s") / cell_e7), F.floor(F.col("n") / cell_e7))))
    p, q = grid.alias("p"), grid.alias("q")
    pairs = p.join(q, (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy"))).where(
        "p.way_id < q.way_id and p.w <= q.e and q.w <= p.e and p.s <= q.n and q.s <= p.n "
        f"and floor(greatest(p.w, q.w) / {cell_e7}) = p.cx and floor(greatest(p.s, q.s) / {cell_e7}) = p.cy"
    )
    if connectable is not None:
        pairs = pairs.withColumns({"a_tags": F.col("p.tags"), "b_tags": F.col("q.tags")}).where(connectable)
    big = lambda e: F.expr(e.replace("L(", "cast(").replace(")L", " as decimal(20,0))"))
    turn = lambda a, b, c: big(f"sign(L({b}x - {a}x)L * L({c}y - {a}y)L - L({b}y - {a}y)L * L({c}x - {a}x)L)")
    d1, d2, d3, d4 = turn("p.a", "p.b", "q.a"), turn("p.a", "p.b", "q.b"), turn("q.a", "q.b", "p.a"), turn("q.a", "q.b", "p.b")
    apart = "not (p.ax = q.ax and p.ay = q.ay or p.ax = q.bx and p.ay = q.by or p.bx = q.ax and p.by = q.ay or p.bx = q.bx and p.by = q.by)"
    hit = pairs.where(apart).where((d1 * d2 <= 0) & (d3 * d4 <= 0) & ((d1 != 0) | (d2 != 0)))
    u = "((q.ax - p.ax) * cast(q.by - q.ay as double) - (q.ay - p.ay) * cast(q.bx - q.ax as double)) / ((p.bx - p.ax) * cast(q.by - q.ay as double) - (p.by - p.ay) * cast(q.bx - q.ax as double))"
    return hit.withColumn("u", F.expr(u)).selectExpr("p.way_id as a", "q.way_id as b", "p.pos as pos_a", "q.pos as pos_b", "cast(floor(p.ax + u * (p.bx - p.ax) + 0.5) as bigint) as x", "cast(floor(p.ay + u * (p.by - p.ay) + 0.5) as bigint) as y")
