import io
import struct
import zipfile

import pytest

from terraframe.sources import shapefile


def shp(records):
    body = b"".join(struct.pack(">2i", i + 1, len(r) // 2) + r for i, r in enumerate(records))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + b"\0" * 72 + body


def poly(kind, parts):
    points = [p for part in parts for p in part]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    return struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def dbf(rows):
    head = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 + 1, 11) + b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 + b"\r"
    return head + b"".join(b" " + r.encode().ljust(10) for r in rows)


RECORDS = [struct.pack("<i2d", 1, 1.0, 2.0), poly(3, [[(0, 0), (1, 1)]]), poly(5, [[(0, 0), (0, 1), (1, 1), (1, 0)], [(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.2)]]), struct.pack("<i", 0), poly(3, [[(0, 0), (2, 2)], [(5, 5), (6, 6)]])]


def test_shapes_and_rows():
    got = list(shapefile.shapes(shp(RECORDS)))
    assert [k for k, _ in got] == ["Point", "LineString", "Polygon", None, "MultiLineString"]
    assert len(got[2][1]) == 2 and got[2][1][0][0] == got[2][1][0][-1]
    assert list(shapefile.attributes(dbf(["a", ""]))) == [{"name": "a"}, {}]
    for bad in (b"", shp(RECORDS)[:-3]):
        with pytest.raises(ValueError):
            list(shapefile.shapes(bad))


def test_read(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("l/x.shp", shp(RECORDS))
        z.writestr("l/x.dbf", dbf(["p", "l", "poly", "none", "two"]))
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    ds = shapefile.read(spark, str(tmp_path / "x.zip"))
    assert {dict(r["tags"]).get("name") for r in ds.nodes.collect()} == {None, "p"}
    assert sorted(dict(r["tags"]).get("name", "") for r in ds.ways.collect()) == ["", "", "l", "two", "two"]
    assert [dict(r["tags"]) for r in ds.relations.collect()] == [{"name": "poly", "type": "multipolygon"}]
