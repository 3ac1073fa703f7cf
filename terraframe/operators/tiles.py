"""Tiles: which features they hold, and their bytes."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions import geo, layers
from terraframe.functions import tags as T
from terraframe.model import Dataset
from terraframe.operators import geometry, joins

EXTENT, BUFFER = 4096, 64


def node_tiles(nodes: DataFrame, zoom: int) -> DataFrame:
    """nodes with the tile (z, x, y) that holds them, and their pixel in it."""
    lon, lat = F.col("lon_e7") / 1e7, F.col("lat_e7") / 1e7
    px, py = geo.tile_pixel(lon, lat, zoom, EXTENT)
    return nodes.withColumns({"z": F.lit(zoom), "x": F.floor(geo.tile_x(lon, zoom)).cast("int"), "y": F.floor(geo.tile_y(lat, zoom)).cast("int"), "px": px, "py": py})


def box_tiles(boxes: DataFrame, zoom: int) -> DataFrame:
    """boxes, once for each tile that they meet."""
    deg = lambda c: F.col(c) / 1e7
    top = (1 << zoom) - 1
    tile = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(top)).cast("int")
    xs = F.sequence(tile(geo.tile_x(deg("west"), zoom)), tile(geo.tile_x(deg("east"), zoom)))
    ys = F.sequence(tile(geo.tile_y(deg("north"), zoom)), tile(geo.tile_y(deg("south"), zoom)))
    return boxes.withColumn("z", F.lit(zoom)).withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))


def drawn_ways(ds: Dataset) -> DataFrame:
    """Tagged ways that no relation has."""
    return ds.ways.where(F.size("tags") > 0).join(joins.relation_way_ids(ds), "id", "left_anti")


def relation_parts(ds: Dataset) -> DataFrame:
    """(id, part, kind, lines): a row for each polygon (kind 3; its rings, the outer one first) and each line (kind 2) of a
    relation; lines are (ring, line) in order. References without a node go, and so does a polygon without its outer ring."""
    refs = geometry.rings(ds).select("relation_id", F.lit(3).alias("kind"), F.col("polygon").alias("part"), "ring", "refs")
    refs = refs.unionByName(geometry.lines(ds).select("relation_id", F.lit(2).alias("kind"), F.col("line").alias("part"), F.lit(0).alias("ring"), "refs"))
    key = ["relation_id", "kind", "part"]
    points = refs.select(*key, "ring", F.posexplode("refs").alias("pos", "ref")).join(ds.nodes.select(F.col("id").alias("ref"), "lon_e7", "lat_e7"), "ref")
    line = points.groupBy(*key, "ring").agg(F.array_sort(F.collect_list(F.struct("pos", "lon_e7", "lat_e7"))).alias("p"))
    line = line.select(*key, "ring", F.transform("p", lambda p: F.struct(p["lon_e7"].alias("lon_e7"), p["lat_e7"].alias("lat_e7"))).alias("line"))
    parts = line.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ring", "line"))).alias("lines")).where("lines[0].ring = 0")
    return parts.select(F.col("relation_id").alias("id"), "part", "kind", "lines")


def relation_tiles(ds: Dataset, zoom: int) -> DataFrame:
    """(z, x, y, id, part, kind, lines): relation_parts by the tiles that their boxes meet, and the points of point relations
    (kind 1, one line) by the tiles that hold them."""
    ends = lambda c, f: f(F.transform(F.flatten(F.col("lines.line")), lambda p: p[c]))
    box = {"west": ends("lon_e7", F.array_min), "east": ends("lon_e7", F.array_max), "south": ends("lat_e7", F.array_min), "north": ends("lat_e7", F.array_max)}
    names = ["z", "x", "y", "id", "part", "kind", "lines"]
    drawn = box_tiles(relation_parts(ds).withColumns(box), zoom).select(*names)
    kind = ds.relations.where(T.relation_kind(F.col("tags"), F.col("members")) == "point").select(F.col("id").alias("relation_id"))
    held = node_tiles(joins.relation_points(ds).join(kind, "relation_id", "left_semi"), zoom).groupBy("z", "x", "y", "relation_id")
    points = held.agg(F.array_sort(F.collect_list(F.struct("pos", "lon_e7", "lat_e7"))).alias("p")).withColumn("line", F.transform("p", lambda p: F.struct(p["lon_e7"].alias("lon_e7"), p["lat_e7"].alias("lat_e7"))))
    points = points.select("z", "x", "y", F.col("relation_id").alias("id"), F.lit(0).alias("part"), F.lit(1).alias("kind"), F.array(F.struct(F.lit(0).alias("ring"), "line")).alias("lines"))
    return drawn.unionByName(points)


def node_features(ds: Dataset, zoom: int) -> DataFrame:
    """(z, x, y, layer, id) of tagged nodes."""
    return node_tiles(ds.nodes.where(F.size("tags") > 0), zoom).select("z", "x", "y", F.lit("nodes").alias("layer"), "id")


def way_features(ds: Dataset, zoom: int) -> DataFrame:
    """(z, x, y, layer, id) of tagged ways outside relations, by the tiles that their boxes meet."""
    return box_tiles(joins.way_boxes(ds, drawn_ways(ds)), zoom).select("z", "x", "y", F.lit("ways").alias("layer"), F.col("way_id").alias("id"))


def relation_features(ds: Dataset, zoom: int) -> DataFrame:
    """(z, x, y, layer, id) of area, line and point relations, by the tiles that their parts' boxes meet."""
    return relation_tiles(ds, zoom).select("z", "x", "y", F.lit("relations").alias("layer"), "id").distinct()


def features(ds: Dataset, zoom: int) -> DataFrame:
    """All three of them."""
    return node_features(ds, zoom).unionByName(way_features(ds, zoom)).unionByName(relation_features(ds, zoom))


def geometry_type(ways: DataFrame) -> DataFrame:
    return ways.withColumn("geometry", F.when(T.is_area(F.col("refs"), F.col("tags")), "Polygon").otherwise("LineString"))


def layer_features(ds: Dataset) -> DataFrame:
    """(entity_type, id, layer, kind) of nodes and ways in all layers that take them."""
    n = ds.nodes.select(F.lit("node").alias("entity_type"), "id", F.explode(layers.matches(F.col("tags"), F.lit("Point"))).alias("m"))
    w = geometry_type(ds.ways).select(F.lit("way").alias("entity_type"), "id", F.explode(layers.matches(F.col("tags"), F.col("geometry"))).alias("m"))
    return n.unionByName(w).select("entity_type", "id", "m.*")


def suppressed(ds: Dataset) -> DataFrame:
    """(id, mask): layers in which an area relation stands for the way, as bits."""
    area = ds.relations.where(T.relation_kind(F.col("tags"), F.col("members")) == "area").select(F.col("id").alias("relation_id"), layers.layer_mask(F.col("tags"), F.lit("Polygon")).alias("mask"))
    members = joins.members(ds).where("type = 'way'").join(area, "relation_id")
    return members.groupBy(F.col("ref").alias("id")).agg(F.bit_or("mask").alias("mask"))


# Vector tiles (MVT 2).


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zig(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _commands(parts: list[list[tuple[int, int]]], kind: int) -> list[int]:
    out, x, y = [], 0, 0
    if kind == 1:
        points = [p for part in parts for p in part]
        out.append(1 | len(points) << 3)
        for px, py in points:
            out += [_zig(px - x) & (1 << 64) - 1, _zig(py - y) & (1 << 64) - 1]
            x, y = px, py
        return out
    for part in parts:
        body = part[:-1] if kind == 3 else part
        out.append(1 | 1 << 3)
        for i, (px, py) in enumerate(body):
            if i == 1:
                out.append(2 | (len(body) - 1) << 3)
            out += [_zig(px - x) & (1 << 64) - 1, _zig(py - y) & (1 << 64) - 1]
            x, y = px, py
        if kind == 3:
            out.append(7 | 1 << 3)
    return out


def _value(v) -> bytes:
    if isinstance(v, bool):
        return _varint(7 << 3) + _varint(int(v))
    if isinstance(v, int):
        return _varint(6 << 3) + _varint(_zig(v) & (1 << 64) - 1) if v < 0 else _varint(5 << 3) + _varint(v)
    if isinstance(v, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


class Layer:
    """One layer, written feature by feature."""

    def __init__(self, name: str, extent: int = EXTENT):
        self.name, self.extent, self.count = name, extent, 0
        self.keys: dict[str, int] = {}
        self.values: dict[tuple, int] = {}
        self.body = bytearray()

    def add(self, i: int, kind: int, properties: dict, shape: bytes) -> None:
        """A feature; kind is 1 point, 2 line, 3 polygon, shape its commands."""
        tags = b""
        for k, v in properties.items():
            if v is None:
                continue
            tags += _varint(self.keys.setdefault(k, len(self.keys))) + _varint(self.values.setdefault((type(v).__name__, v), len(self.values)))
        self.body += _field(2, _varint(1 << 3) + _varint(_zig(i) & (1 << 64) - 1) + _field(2, tags) + _varint(3 << 3) + _varint(kind) + _field(4, shape))
        self.count += 1

    def parts(self) -> list[bytes | bytearray]:
        head = _varint(15 << 3) + _varint(2) + _field(1, self.name.encode())
        rest = bytearray()
        for k in self.keys:
            rest += _field(3, k.encode())
        for _, v in self.values:
            rest += _field(4, _value(v))
        return [head, self.body, rest + _varint(5 << 3) + _varint(self.extent)]

    def chunks(self) -> list[bytes | bytearray]:
        """The layer as a field of a tile; nothing without features."""
        parts = self.parts()
        return [_varint(3 << 3 | 2) + _varint(sum(map(len, parts))), *parts] if self.count else []


def encode_layer(name: str, items: list[dict], extent: int = EXTENT) -> bytes:
    """One layer; items have id, kind (1 point, 2 line, 3 polygon), parts of points, and properties."""
    layer = Layer(name, extent)
    for f in items:
        layer.add(f["id"], f["kind"], f["properties"], b"".join(map(_varint, _commands(f["parts"], f["kind"]))))
    return b"".join(layer.parts())


def encode_tile(named: dict[str, list[dict]]) -> bytes:
    return b"".join(_field(3, encode_layer(n, items)) for n, items in named.items() if items)


def clip_line(points: list[tuple[float, float]], lo: float, hi: float) -> list[list[tuple[float, float]]]:
    """The pieces of a line inside the square from lo to hi (Liang-Barsky on each segment)."""
    out: list[list[tuple[float, float]]] = []
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        a, b, dx, dy = 0.0, 1.0, x1 - x0, y1 - y0
        for p, q in ((-dx, x0 - lo), (dx, hi - x0), (-dy, y0 - lo), (dy, hi - y0)):
            if p == 0:
                if q < 0:
                    a = 2.0
            elif p < 0:
                a = max(a, q / p)
            else:
                b = min(b, q / p)
        if a > b:
            continue
        start, end = (x0 + a * dx, y0 + a * dy), (x0 + b * dx, y0 + b * dy)
        if out and out[-1][-1] == start:
            out[-1].append(end)
        else:
            out.append([start, end])
    return out


def clip_ring(points: list[tuple[float, float]], lo: float, hi: float) -> list[tuple[float, float]]:
    """A ring cut to the square from lo to hi, edge by edge (Sutherland-Hodgman); closed, or empty."""
    ring = points[:-1] if points and points[0] == points[-1] else list(points)
    for axis, bound, sign in ((0, lo, 1), (0, hi, -1), (1, lo, 1), (1, hi, -1)):
        out = []
        for i, p in enumerate(ring):
            q = ring[i - 1]
            inside, was = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if inside != was:
                t = (bound - q[axis]) / (p[axis] - q[axis])
                out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if inside:
                out.append(p)
        ring = out
    return ring + ring[:1]


def _rounded(points) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in points:
        p = (math.floor(x + 0.5), math.floor(y + 0.5))
        if not out or out[-1] != p:
            out.append(p)
    return out


def _in_tile(lon: int, lat: int, z: int, x: int, y: int) -> tuple[float, float]:
    s = math.sin(math.radians(lat / 1e7))
    n = 1 << z
    return ((lon / 1e7 + 180) / 360 * n - x) * EXTENT, ((0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * n - y) * EXTENT


def _polygon(rings: list[tuple[int, list]]) -> list[list[tuple[int, int]]]:
    """Rings (ring, points) clipped and wound, the outer one (0) against the inner ones; empty without the outer one."""
    out: list[list[tuple[int, int]]] = []
    for number, points in rings:
        ring = _rounded(clip_ring(points, -BUFFER, EXTENT + BUFFER))
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
        if len(ring) >= 4 and area:
            out.append(ring if (area < 0) == (number == 0) else ring[::-1])
        elif number == 0:
            return []
    return out


def vector_tiles(ds: Dataset, zoom: int) -> DataFrame:
    """(z, x, y, features, tile): the bytes of each tile that holds something, with layers ways, nodes and relations. A
    relation is a feature for each of its polygons and lines, and one for its points in the tile. Features are drawn row by
    row and sorted by tile; a task holds the bytes of the tile that it writes, not its features."""
    one = lambda c: F.array(F.struct(F.lit(0).alias("ring"), c.alias("line")))
    names = ["z", "x", "y", "layer", "id", "part", "kind", "tags", "lines"]
    n = node_tiles(ds.nodes.where(F.size("tags") > 0), zoom).select("z", "x", "y", F.lit("nodes").alias("layer"), "id", F.lit(0).alias("part"), F.lit(1).alias("kind"), "tags", one(F.array(F.struct("lon_e7", "lat_e7"))).alias("lines"))
    ways = geometry_type(drawn_ways(ds))
    lines = joins.way_lines(ds, ways).withColumnRenamed("way_id", "id").join(ways.select("id", "tags", F.when(F.col("geometry") == "Polygon", 3).otherwise(2).alias("kind")), "id")
    ends = lambda c, f: f(F.transform("line", lambda p: p[c]))
    w = box_tiles(lines.withColumns({"west": ends("lon_e7", F.array_min), "east": ends("lon_e7", F.array_max), "south": ends("lat_e7", F.array_min), "north": ends("lat_e7", F.array_max)}), zoom).select("z", "x", "y", F.lit("ways").alias("layer"), "id", F.lit(0).alias("part"), "kind", "tags", one(F.col("line")).alias("lines"))
    r = relation_tiles(ds, zoom).join(ds.relations.select("id", "tags"), "id").withColumn("layer", F.lit("relations")).select(*names)

    def draw(batches):
        for b in batches:
            shapes = []
            for r in b.select(["z", "x", "y", "kind", "lines"]).to_pylist():
                lines = [(p["ring"], [_in_tile(q["lon_e7"], q["lat_e7"], r["z"], r["x"], r["y"]) for q in p["line"]]) for p in r["lines"]]
                if r["kind"] == 1:
                    parts = [_rounded(points) for _, points in lines]
                elif r["kind"] == 2:
                    parts = [p for _, points in lines for piece in clip_line(points, -BUFFER, EXTENT + BUFFER) if len(p := _rounded(piece)) >= 2]
                else:
                    parts = _polygon(lines)
                shapes.append(b"".join(map(_varint, _commands(parts, r["kind"]))) if parts else None)
            kept = b.select(["z", "x", "y", "layer", "id", "part", "kind", "tags"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(shapes, pa.binary())], names=[*kept.schema.names, "shape"])

    def join(batches):
        at, open_layers = None, {}

        def tile():
            out = pa.array([b"".join(p for n in ("ways", "nodes", "relations") for p in open_layers[n].chunks())], pa.binary())
            z, x, y = (pa.array([v], pa.int32()) for v in at)
            return pa.RecordBatch.from_arrays([z, x, y, pa.array([sum(v.count for v in open_layers.values())], pa.int64()), out], names=["z", "x", "y", "features", "tile"])

        for b in batches:
            for z, x, y, layer, i, kind, tags, shape in zip(*(b.column(c).to_pylist() for c in ("z", "x", "y", "layer", "id", "kind", "tags", "shape"))):
                if at != (z, x, y):
                    if at is not None:
                        yield tile()
                    at, open_layers = (z, x, y), {n: Layer(n) for n in ("ways", "nodes", "relations")}
                if shape is not None:
                    open_layers[layer].add(i, kind, dict(tags or ()), shape)
        if at is not None:
            yield tile()

    place = "z int, x int, y int"
    drawn = n.unionByName(w).unionByName(r).mapInArrow(draw, f"{place}, layer string, id long, part int, kind int, tags map<string,string>, shape binary")
    return drawn.repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", "kind", "id", "part").mapInArrow(join, f"{place}, features long, tile binary")


def raster_tiles(ds: Dataset, zoom: int, size: int = 256, color: tuple[int, int, int, int] = (60, 60, 60, 255)) -> DataFrame:
    """(z, x, y, png): ways drawn as one-pixel lines on tiles of size pixels, as PNG. Each task draws its rows on tiles of its
    own, in bits; those of all tasks are combined by an aggregate, so none gathers the lines of a tile."""
    lines = joins.way_lines(ds)
    ends = lambda c, f: f(F.transform("line", lambda p: p[c]))
    w = box_tiles(lines.withColumns({"west": ends("lon_e7", F.array_min), "east": ends("lon_e7", F.array_max), "south": ends("lat_e7", F.array_min), "north": ends("lat_e7", F.array_max)}), zoom).select("z", "x", "y", "line")

    def draw(batches):
        own: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            for at, *segments in _segments(b, size):
                _draw(own.setdefault(at, np.zeros((size, size), bool)), *segments)
            if len(own) > OPEN_TILES:
                yield words(own)
                own = {}
        yield words(own)

    def words(own):
        at, word, bits = [], [], []
        for tile, drawn in own.items():
            packed = np.packbits(np.pad(drawn.ravel(), (0, -drawn.size % 64)), bitorder="little").view("<i8")
            used = np.union1d(np.flatnonzero(packed), [0])  # a tile without a pixel has its row, too
            at += [tile] * len(used)
            word.append(used)
            bits.append(packed[used])
        z, x, y = zip(*at) if at else ((), (), ())
        flat = lambda a: np.concatenate([np.zeros(0, np.int64), *a])
        return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in (z, x, y)), pa.array(flat(word), pa.int32()), pa.array(flat(bits), pa.int64())], names=["z", "x", "y", "word", "bits"])

    def run(t: pa.Table) -> pa.Table:
        z, x, y = (t.column(c)[0].as_py() for c in "zxy")
        packed = np.zeros(-(-size * size // 64), "<i8")
        packed[t.column("word").to_numpy()] = t.column("bits").to_numpy()
        pixels = np.zeros((size, size, 4), np.uint8)
        pixels[np.unpackbits(packed.view(np.uint8), bitorder="little")[: size * size].reshape(size, size).astype(bool)] = color
        return pa.table({"z": pa.array([z], pa.int32()), "x": pa.array([x], pa.int32()), "y": pa.array([y], pa.int32()), "png": pa.array([png(pixels)], pa.binary())})

    drawn = w.mapInArrow(draw, "z int, x int, y int, word int, bits long").groupBy("z", "x", "y", "word").agg(F.bit_or("bits").alias("bits"))
    return drawn.groupBy("z", "x", "y").applyInArrow(run, "z int, x int, y int, png binary")


#: Tiles that a task draws on at once, and pixels that it places at once.
OPEN_TILES, PIXELS = 256, 1 << 20


def _segments(b: pa.RecordBatch, size: int):
    """(tile, x0, y0, x1, y1) for each tile of a batch (z, x, y, line): its lines' segments, in pixels, clipped as by clip_line."""
    z, x, y = (b.column(c).to_numpy() for c in ("z", "x", "y"))
    line = b.column("line")
    count, points = line.value_lengths().to_numpy(), line.flatten()
    row = np.repeat(np.arange(len(count)), count)
    n = np.exp2(z)[row]
    s = np.sin(np.radians(points.field("lat_e7").to_numpy() / 1e7))
    px = ((points.field("lon_e7").to_numpy() / 1e7 + 180) / 360 * n - x[row]) * EXTENT * size / EXTENT
    py = ((0.5 - np.log((1 + s) / (1 - s)) / (4 * math.pi)) * n - y[row]) * EXTENT * size / EXTENT
    first = np.flatnonzero(row[1:] == row[:-1])
    x0, y0, x1, y1, row = px[first], py[first], px[first + 1], py[first + 1], row[first]
    dx, dy, lo, hi = x1 - x0, y1 - y0, 0, size - 1
    a, e = np.zeros(len(row)), np.ones(len(row))
    for p, q in ((-dx, x0 - lo), (dx, hi - x0), (-dy, y0 - lo), (dy, hi - y0)):
        t = q / np.where(p == 0, 1, p)
        a = np.where(p < 0, np.maximum(a, t), np.where((p == 0) & (q < 0), 2.0, a))
        e = np.where(p > 0, np.minimum(e, t), e)
    clipped = np.stack([x0 + a * dx, y0 + a * dy, x0 + e * dx, y0 + e * dy])
    tiles, of = np.unique(np.stack([z, x, y], axis=1), axis=0, return_inverse=True)
    of = np.where(a <= e, of.ravel()[row], -1)
    for i, tile in enumerate(tiles.tolist()):
        yield tuple(tile), *clipped[:, of == i]


def _draw(drawn: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> None:
    """Sets the pixels of segments. One whose box, and a pixel around it, is set already changes nothing and is left out."""
    top = len(drawn) - 1
    sums = np.pad(drawn.cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32), ((1, 0), (1, 0)))
    edge = lambda v, more: np.clip(np.round(v) + more, 0, top).astype(int)
    west, east, north, south = edge(np.minimum(x0, x1), -1), edge(np.maximum(x0, x1), 1) + 1, edge(np.minimum(y0, y1), -1), edge(np.maximum(y0, y1), 1) + 1
    fresh = sums[south, east] - sums[north, east] - sums[south, west] + sums[north, west] < (east - west) * (south - north)
    x0, y0, x1, y1 = x0[fresh], y0[fresh], x1[fresh], y1[fresh]
    n = np.maximum(np.abs(x1 - x0), np.abs(y1 - y0)).astype(int) + 1
    step = max(1, PIXELS // (top + 3))
    for at in range(0, len(n), step):
        part = slice(at, at + step)
        of = np.repeat(np.arange(len(n[part])), n[part] + 1)
        last = np.cumsum(n[part] + 1) - 1
        i = np.arange(len(of)) - (last - n[part])[of]
        xs, ys = ((i * ((q - p) / n[part])[of] + p[of]) for p, q in ((x0[part], x1[part]), (y0[part], y1[part])))
        xs[last], ys[last] = x1[part], y1[part]
        drawn[np.clip(np.round(ys), 0, top).astype(int), np.clip(np.round(xs), 0, top).astype(int)] = True


def png(pixels: np.ndarray) -> bytes:
    """An RGBA array (height, width, 4) as a PNG file."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 4)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
