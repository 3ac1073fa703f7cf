"""Well-known binary geometries."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
SCHEMA = "id long, kind string, coordinates string"


def parse(data: bytes) -> tuple[str, list]:
    """(kind, coordinates nested as in GeoJSON); either byte order, an SRID is skipped, Z and M are read and dropped."""
    out, at = _geometry(data, 0)
    return out


def _geometry(data: bytes, at: int) -> tuple[tuple[str, list], int]:
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    kind = KINDS.get(code & 0xFFFF)
    if kind is None:
        raise ValueError(f"unknown geometry type {code & 0xFFFF}")

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at += 4
        return n

    def point() -> list:
        nonlocal at
        p = list(struct.unpack_from(f"{order}2d", data, at))
        at += 8 * dims
        return p

    line = lambda: [point() for _ in range(count())]
    if kind == "Point":
        return (kind, point()), at
    if kind == "LineString":
        return (kind, line()), at
    if kind == "Polygon":
        return (kind, [line() for _ in range(count())]), at
    parts = []
    for _ in range(count()):
        part, at = _geometry(data, at)
        parts.append(part if kind == "GeometryCollection" else part[1])
    return (kind, parts), at


def build(kind: str, coordinates: list) -> bytes:
    """Little-endian bytes of a geometry."""
    code = {v: k for k, v in KINDS.items()}[kind]
    head = struct.pack("<BI", 1, code)
    line = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<2d", *p) for p in ps)
    if kind == "Point":
        return head + struct.pack("<2d", *coordinates)
    if kind == "LineString":
        return head + line(coordinates)
    if kind == "Polygon":
        return head + struct.pack("<I", len(coordinates)) + b"".join(map(line, coordinates))
    single = kind.removeprefix("Multi")
    return head + struct.pack("<I", len(coordinates)) + b"".join(build(single, c) for c in coordinates)


def decode(df: DataFrame, id_col: str = "id", column: str = "geometry") -> DataFrame:
    """(id, kind, coordinates as JSON text); null where the bytes are no geometry."""
    import json

    def run(batches):
        for b in batches:
            kinds, texts = [], []
            for v in b.column(1).to_pylist():
                try:
                    kind, c = parse(v)
                    kinds.append(kind)
                    texts.append(json.dumps(c))
                except (ValueError, IndexError, TypeError, struct.error):
                    kinds.append(None)
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["id", "kind", "coordinates"])

    return df.selectExpr(f"cast({id_col} as bigint) AS id", column).mapInArrow(run, SCHEMA)
