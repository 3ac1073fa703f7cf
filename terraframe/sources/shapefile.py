"""Shapefiles (.shp with .dbf, zipped or not) as GeoJSON-like features."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.model import Dataset
from terraframe.sources import geojson

SCHEMA = "ord long, id long, tags map<string,string>, kind string, coordinates string"
_ARROW = pa.schema([("ord", pa.int64()), ("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("kind", pa.string()), ("coordinates", pa.string())])


def _area(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def shapes(data: bytes) -> Iterator[tuple[str | None, list]]:
    """(kind, coordinates) of the records of a .shp file; (None, []) for null and unknown shapes. Rings are closed where
    they aren't; clockwise rings begin a polygon, the others are its holes."""
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        record = data[at + 8 : at + 8 + 2 * words]
        if len(record) < 2 * words:
            raise ValueError("the shapefile is cut off")
        at += 8 + 2 * words
        kind = struct.unpack_from("<i", record)[0] % 10
        if kind == 1:
            yield "Point", list(struct.unpack_from("<2d", record, 4))
        elif kind == 8:
            (n,) = struct.unpack_from("<i", record, 36)
            yield "MultiPoint", [list(struct.unpack_from("<2d", record, 40 + 16 * i)) for i in range(n)]
        elif kind in (3, 5):
            parts, n = struct.unpack_from("<2i", record, 36)
            starts = [*struct.unpack_from(f"<{parts}i", record, 44), n]
            points = [list(struct.unpack_from("<2d", record, 44 + 4 * parts + 16 * i)) for i in range(n)]
            lines = [points[a:b] for a, b in zip(starts, starts[1:])]
            if kind == 3:
                lines = [x for x in lines if len(x) >= 2]
                yield ("LineString", lines[0]) if len(lines) == 1 else ("MultiLineString", lines)
                continue
            polygons: list[list] = []
            for ring in lines:
                ring = ring if ring[:1] == ring[-1:] else ring + ring[:1]
                if len(ring) < 4:
                    continue
                if _area(ring) <= 0 or not polygons:
                    polygons.append([ring])
                else:
                    polygons[-1].append(ring)
            yield ("Polygon", polygons[0]) if len(polygons) == 1 else ("MultiPolygon", polygons) if polygons else (None, [])
        else:
            yield None, []


def attributes(data: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """The rows of a .dbf file as text; empty cells are left out."""
    rows, head, size = struct.unpack_from("<IHH", data, 4)
    columns, at = [], 32
    while data[at] != 13:
        columns.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    for i in range(rows):
        at, out = head + i * size + 1, {}
        for name, width in columns:
            cell = data[at : at + width].decode(encoding, "replace").strip(" \0")
            at += width
            if cell:
                out[name] = cell
        yield out


def _members(content: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    if content[:2] != b"PK":
        yield content, None
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {n.lower(): n for n in z.namelist()}
        for low, name in sorted(names.items()):
            if low.endswith(".shp"):
                table = names.get(low[:-4] + ".dbf")
                yield z.read(name), z.read(table) if table else None


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA of all layers of zipped or bare shapefiles. MultiPoints become points, MultiLineStrings lines; short and
    empty shapes are left out."""

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                rows, n = [], 0
                for shp, dbf in _members(content):
                    table = list(attributes(dbf)) if dbf else []
                    for i, (kind, c) in enumerate(shapes(shp)):
                        tags = list(table[i].items()) if i < len(table) else []
                        single = {"MultiPoint": "Point", "MultiLineString": "LineString"}.get(kind or "")
                        for part in c if single else [c]:
                            if kind and part:
                                rows.append({"ord": n, "id": None, "tags": tags, "kind": single or kind, "coordinates": json.dumps(part)})
                                n += 1
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> Dataset:
    return geojson.to_dataset(read_features(spark, path).withColumn("tags", F.coalesce("tags", F.expr("cast(map() as map<string,string>)"))))
