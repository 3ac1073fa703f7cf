"""Rings and lines of relations, assembled for each relation by itself."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions import tags as T
from terraframe.model import Dataset
from terraframe.operators import joins

RINGS = "relation_id long, polygon int, ring int, role string, refs array<long>"
LINES = "relation_id long, line int, role string, refs array<long>"


def chain(ways: list[list[int]], closed_only: bool) -> list[list[int]]:
    """Ways joined at shared ends, in member order, reversed where needed: each chain grows at its end, then at its start.
    A joint's vertex stays once."""
    left = [w for w in ways if len(w) >= 2]
    out = []
    while left:
        at = list(left.pop(0))
        for front in (False, True):
            while at[0] != at[-1]:
                end = at[0] if front else at[-1]
                k = next((k for k, w in enumerate(left) if end in (w[0], w[-1])), None)
                if k is None:
                    break
                w = left.pop(k)
                if front:
                    at = (w if w[-1] == end else w[::-1])[:-1] + at
                else:
                    at += (w if w[0] == end else w[::-1])[1:]
        if not closed_only or at[0] == at[-1] and len(at) >= 4:
            out.append(at)
    return out


def _member_ways(ds: Dataset, kind: str) -> DataFrame:
    r = ds.relations.where(T.relation_kind(F.col("tags"), F.col("members")) == kind).select(F.col("id").alias("relation_id"), F.posexplode("members").alias("pos", "m"))
    r = r.where("m.type = 'way'").select("relation_id", "pos", F.lower(F.coalesce("m.role", F.lit(""))).alias("role"), F.col("m.ref").alias("id"))
    return r.join(ds.ways.select("id", "refs"), "id").select("relation_id", "pos", "role", "refs")


def rings(ds: Dataset) -> DataFrame:
    """RINGS of area relations: one polygon for each closed outer ring, with all inner rings after it. Chains that don't
    close are left out. A relation is assembled in one task; its members bound the work."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["pos"])
        by = {role: chain([r["refs"] for r in rows if r["role"] == role], True) for role in ("outer", "inner")}
        out = [(rows[0]["relation_id"], p, k, "outer" if not k else "inner", ring) for p, outer in enumerate(by["outer"]) for k, ring in enumerate([outer, *by["inner"]])]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else [()] * 5, types)], names=["relation_id", "polygon", "ring", "role", "refs"])

    return _member_ways(ds, "area").groupBy("relation_id").applyInArrow(run, RINGS)


def lines(ds: Dataset) -> DataFrame:
    """LINES of line relations: member ways chained within each role."""

    def run(t: pa.Table) -> pa.Table:
        by = defaultdict(list)
        for r in sorted(t.to_pylist(), key=lambda r: r["pos"]):
            by[r["role"]].append(r["refs"])
        out, i = [], 0
        for role, ways in by.items():
            for line in chain(ways, False):
                out.append((t.column("relation_id")[0].as_py(), i, role, line))
                i += 1
        types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else [()] * 4, types)], names=["relation_id", "line", "role", "refs"])

    return _member_ways(ds, "line").groupBy("relation_id").applyInArrow(run, LINES)


def role_members(ds: Dataset) -> DataFrame:
    """(relation_id, outer, inner): way members by role, others left out."""
    pick = lambda role: F.transform(F.filter("members", lambda m: (m["type"] == "way") & (F.lower(m["role"]) == role)), lambda m: m["ref"])
    return ds.relations.select(F.col("id").alias("relation_id"), pick("outer").alias("outer"), pick("inner").alias("inner"))


def geometry_of(ds: Dataset) -> DataFrame:
    """(relation_id, kind, parts): how many polygons, lines or points a relation is made of."""
    kinds = ds.relations.select(F.col("id").alias("relation_id"), T.relation_kind(F.col("tags"), F.col("members")).alias("kind"))
    polygons = rings(ds).groupBy("relation_id").agg(F.countDistinct("polygon").alias("parts"))
    chains = lines(ds).groupBy("relation_id").agg(F.count("*").alias("parts"))
    points = joins.relation_points(ds).join(kinds.where("kind = 'point'"), "relation_id").groupBy("relation_id").agg(F.count("*").alias("parts"))
    return kinds.join(polygons.unionByName(chains).unionByName(points), "relation_id", "left").select("relation_id", "kind", F.coalesce("parts", F.lit(0)).cast("long").alias("parts"))
