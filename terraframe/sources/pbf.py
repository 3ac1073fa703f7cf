"""PBF map files: read in parallel, blob by blob, and written."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.model import Dataset

# Fixed values of the format.
MAX_HEADER, MAX_BLOB = 64 * 1024, 32 * 1024 * 1024
MEMBER_TYPES = ("node", "way", "relation")
BLOCK_ENTITIES = 8000
ENTITY = "kind string, id long, lon_e7 int, lat_e7 int, refs array<long>, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"
_TYPES = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lon_e7", pa.int32()), ("lat_e7", pa.int32()), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))), ("tags", pa.map_(pa.string(), pa.string()))])


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
        elif key & 7 == 2:
            n, at = _varint(data, at)
            if at + n > len(data):
                raise ValueError("a field is cut off")
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


def packed(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = _varint(data, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v if v < 1 << 63 else v - (1 << 64))
    return out


def summed(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def blobs(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(type, offset, size) of the blobs of a file; the bytes themselves aren't read here."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("the file is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        if not 0 < n <= MAX_HEADER or at + 4 + n > len(data):
            raise ValueError("a blob header has a wrong size")
        head = dict(fields(data[at + 4 : at + 4 + n]))
        size = head.get(3, 0)
        at += 4 + n
        if not 0 < size <= MAX_BLOB or at + size > len(data):
            raise ValueError("a blob has a wrong size")
        yield head[1].decode(), at, size
        at += size


def inflate(blob: bytes) -> bytes:
    f = dict(fields(blob))
    if 1 in f:
        return f[1]
    if 3 not in f:
        raise ValueError("only zlib compression is supported")
    raw = zlib.decompressobj().decompress(f[3], MAX_BLOB)
    if len(raw) != f.get(2, len(raw)):
        raise ValueError("a blob's size differs from what it declares")
    return raw


def read_header(block: bytes) -> dict:
    out: dict = {"required_features": [], "optional_features": []}
    for n, v in fields(block):
        if n == 1:
            box = {k: (x >> 1) ^ -(x & 1) for k, x in fields(v)}
            out["bbox"] = tuple(box.get(k, 0) / 1e9 for k in (1, 4, 2, 3))
        elif n in (4, 5):
            out["required_features" if n == 4 else "optional_features"].append(v.decode())
        elif n in (16, 17):
            out["writing_program" if n == 16 else "source"] = v.decode()
    return out


def _tags(strings: list[str], keys: list[int], values: list[int]) -> dict[str, str]:
    return {strings[k]: strings[v] for k, v in zip(keys, values) if strings[k] and strings[v]}


def entities(block: bytes) -> Iterator[dict]:
    """The entities of a primitive block. Tags with an empty key or value are left out."""
    groups, strings, step, lat0, lon0 = [], [], 100, 0, 0
    for n, v in fields(block):
        if n == 1:
            strings = [s.decode() for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            step = v
        elif n == 19:
            lat0 = v
        elif n == 20:
            lon0 = v
    e7 = lambda v, off: (off + step * v + 50) // 100
    for g in groups:
        for n, v in fields(g):
            f: dict = {}
            for k, x in fields(v):
                f[k] = x
            if n == 1:
                zig = lambda x: (x >> 1) ^ -(x & 1)
                yield {"kind": "node", "id": zig(f[1]), "lat_e7": e7(zig(f[8]), lat0), "lon_e7": e7(zig(f[9]), lon0), "tags": _tags(strings, packed(f.get(2, b"")), packed(f.get(3, b"")))}
            elif n == 2:
                kv, at = packed(f.get(10, b"")), 0
                for i, y, x in zip(summed(packed(f[1], True)), summed(packed(f[8], True)), summed(packed(f[9], True))):
                    tags = {}
                    while at < len(kv) and kv[at]:
                        if strings[kv[at]] and strings[kv[at + 1]]:
                            tags[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    yield {"kind": "node", "id": i, "lat_e7": e7(y, lat0), "lon_e7": e7(x, lon0), "tags": tags}
            elif n == 3:
                yield {"kind": "way", "id": f[1], "refs": summed(packed(f.get(8, b""), True)), "tags": _tags(strings, packed(f.get(2, b"")), packed(f.get(3, b"")))}
            elif n == 4:
                refs, roles, kinds = summed(packed(f.get(9, b""), True)), packed(f.get(8, b"")), packed(f.get(10, b""))
                members = [{"type": MEMBER_TYPES[k], "ref": r, "role": strings[s]} for r, s, k in zip(refs, roles, kinds)]
                yield {"kind": "relation", "id": f[1], "members": members, "tags": _tags(strings, packed(f.get(2, b"")), packed(f.get(3, b"")))}


def _file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read(spark: SparkSession, path: str) -> Dataset:
    """The dataset in PBF files."""
    return of_files(_file(spark, path), path)


def of_files(files: DataFrame, name: str = "") -> Dataset:
    """The dataset in files, or in pieces of files of whole blobs (content). Blobs are split off where the files are, dealt
    out, and decoded where they land; entities may come in any order and nodes dense or not."""

    def split(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                for kind, at, size in blobs(content):
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([content[at : at + size]], pa.binary())], names=["kind", "blob"])

    def decode(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                rows = [{"refs": None, "members": None, "lon_e7": None, "lat_e7": None, **e, "tags": list(e["tags"].items())} for e in entities(inflate(blob))]
                yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)

    parts = files.select("content").mapInArrow(split, "kind string, blob binary")
    found = parts.where("kind = 'OSMData'").select("blob").repartition(files.sparkSession.sparkContext.defaultParallelism).mapInArrow(decode, ENTITY)
    pick = lambda kind, *columns: found.where(F.col("kind") == kind).select(*columns)
    return Dataset(pick("node", "id", "lon_e7", "lat_e7", "tags"), pick("way", "id", "refs", "tags"), pick("relation", "id", "members", "tags"), name)


def _put(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _sub(number: int, data: bytes) -> bytes:
    return _put(number << 3 | 2) + _put(len(data)) + data


def _pack(values: list[int], signed: bool = False) -> bytes:
    return b"".join(_put((v << 1) ^ (v >> 63) if signed else v) for v in values)


def _steps(values: list[int]) -> list[int]:
    return [b - a for a, b in zip([0, *values], values)]


def encode_block(rows: list[dict]) -> bytes:
    """A primitive block of entities of one kind."""
    strings: dict[str, int] = {"": 0}
    s = lambda x: strings.setdefault(x, len(strings))
    if rows[0]["kind"] == "node":
        kv = [x for r in rows for x in [*(y for k, v in sorted(r["tags"].items()) for y in (s(k), s(v))), 0]]
        body = _sub(1, _pack(_steps([r["id"] for r in rows]), True)) + _sub(8, _pack(_steps([r["lat_e7"] for r in rows]), True)) + _sub(9, _pack(_steps([r["lon_e7"] for r in rows]), True)) + _sub(10, _pack(kv))
        group = _sub(2, body)
    else:
        group = b""
        for r in rows:
            tags = sorted(r["tags"].items())
            body = _put(1 << 3) + _put(r["id"]) + _sub(2, _pack([s(k) for k, _ in tags])) + _sub(3, _pack([s(v) for _, v in tags]))
            if r["kind"] == "way":
                group += _sub(3, body + _sub(8, _pack(_steps(r["refs"]), True)))
            else:
                m = r["members"]
                group += _sub(4, body + _sub(8, _pack([s(x["role"] or "") for x in m])) + _sub(9, _pack(_steps([x["ref"] for x in m]), True)) + _sub(10, _pack([MEMBER_TYPES.index(x["type"]) for x in m])))
    return _sub(1, b"".join(_sub(1, x.encode()) for x in strings)) + _sub(2, group)


def frame(kind: str, block: bytes) -> bytes:
    """A block as a compressed blob with its header."""
    blob = _put(2 << 3) + _put(len(block)) + _sub(3, zlib.compress(block))
    if len(block) > MAX_BLOB:
        raise ValueError("a block is too large")
    head = _sub(1, kind.encode()) + _put(3 << 3) + _put(len(blob))
    return struct.pack(">I", len(head)) + head + blob


def header_block(program: str = "terraframe") -> bytes:
    return _sub(4, b"OsmSchema-V0.6") + _sub(5, b"DenseNodes") + _sub(16, program.encode())


def encoded(ds: Dataset) -> DataFrame:
    """(o, first_id, blob): framed blobs, nodes before ways before relations, by id; each task writes its own range."""
    wide = None
    for o, (kind, df) in enumerate((("node", ds.nodes), ("way", ds.ways), ("relation", ds.relations))):
        row = df.select(F.lit(o).alias("o"), F.lit(kind).alias("kind"), *df.columns)
        wide = row if wide is None else wide.unionByName(row, allowMissingColumns=True)
    wide = wide.select("o", "kind", "id", "lon_e7", "lat_e7", "refs", "members", "tags").repartitionByRange("o", "id").sortWithinPartitions("o", "id")

    def run(batches):
        rows: list[dict] = []

        def flush():
            blob = frame("OSMData", encode_block(rows))
            return pa.RecordBatch.from_arrays([pa.array([rows[0]["o"]], pa.int32()), pa.array([rows[0]["id"]], pa.int64()), pa.array([blob], pa.binary())], names=["o", "first_id", "blob"])

        for b in batches:
            for r in b.to_pylist():
                r["tags"] = dict(r["tags"] or ())
                if rows and (rows[0]["kind"] != r["kind"] or len(rows) == BLOCK_ENTITIES):
                    yield flush()
                    rows = []
                rows.append(r)
        if rows:
            yield flush()

    return wide.mapInArrow(run, "o int, first_id long, blob binary")


def write(ds: Dataset, path: str) -> None:
    """One PBF file on the driver's disk; blobs come to the driver one at a time."""
    with open(path, "wb") as out:
        out.write(frame("OSMHeader", header_block()))
        for r in encoded(ds).orderBy("o", "first_id").toLocalIterator():
            out.write(r["blob"])


