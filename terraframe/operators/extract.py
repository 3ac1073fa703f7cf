"""Regional extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions import tags as T
from terraframe.model import Dataset, checkpointed
from terraframe.operators import joins, spatial

STRATEGIES = ("simple", "complete_ways", "smart")


def filter_by_tags(ds: Dataset, rules: dict[str, list[tuple[str, str | None]]]) -> Dataset:
    """Entities that match their kind's rules."""
    cut = lambda df, k: df.where(T.matches_rules(F.col("tags"), rules.get(k, [])))
    return Dataset(cut(ds.nodes, "nodes"), cut(ds.ways, "ways"), cut(ds.relations, "relations"), ds.name, ds.header)


def ways_touching(ds: Dataset, node_ids: DataFrame) -> DataFrame:
    """Ids of ways with a reference among node_ids."""
    refs = ds.ways.select("id", F.explode("refs").alias("ref"))
    return refs.join(node_ids.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()


def extract(ds: Dataset, box: spatial.Box, strategy: str = "simple") -> Dataset:
    """The part of ds inside a box in degrees.

    simple: nodes inside, ways with a node inside, cut to these nodes, relations with a member (nested or not) among them,
    cut to their members that are. complete_ways: ways keep all nodes. smart: multipolygons keep all members, too."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    inside = spatial.nodes_in_box(ds.nodes, box)
    way_ids = ways_touching(ds, inside)
    ways = ds.ways.join(way_ids, "id", "left_semi")
    if strategy == "simple":
        kept = ways.select("id", F.posexplode("refs").alias("pos", "ref")).join(inside.select(F.col("id").alias("ref")), "ref", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("x"))
        ways = ways.join(kept, "id").select("id", F.transform("x", lambda x: x["ref"]).alias("refs"), "tags")
        node_ids = inside.select("id")
    else:
        node_ids = inside.select("id").unionByName(ways.select(F.explode("refs").alias("id"))).distinct()
    node_ids, way_ids, found = (checkpointed(df) for df in (node_ids, way_ids, joins.closure(ds)))
    hit = found.where("type = 'node'").join(node_ids.select(F.col("id").alias("ref")), "ref", "left_semi").select("relation_id")
    hit = hit.unionByName(found.where("type = 'way'").join(way_ids.select(F.col("id").alias("ref")), "ref", "left_semi").select("relation_id")).distinct()
    hit = checkpointed(hit)
    relations = ds.relations.join(hit.select(F.col("relation_id").alias("id")), "id", "left_semi")
    whole = relations.where(F.coalesce(F.lower(T.tag(F.col("tags"), "type")) == "multipolygon", F.lit(False))) if strategy == "smart" else None
    present = node_ids.select(F.lit("node").alias("type"), F.col("id").alias("ref")).unionByName(way_ids.select(F.lit("way").alias("type"), F.col("id").alias("ref"))).unionByName(hit.select(F.lit("relation").alias("type"), F.col("relation_id").alias("ref")))
    cut = _members_among(relations, present)
    if whole is not None:
        cut = cut.join(whole.select("id"), "id", "left_anti").unionByName(whole)
        more = found.join(whole.select(F.col("id").alias("relation_id")), "relation_id", "left_semi").select("type", "ref").distinct()
        way_ids = checkpointed(way_ids.unionByName(more.where("type = 'way'").select(F.col("ref").alias("id"))).distinct())
        ways = ds.ways.join(way_ids, "id", "left_semi")
        node_ids = node_ids.unionByName(more.where("type = 'node'").select(F.col("ref").alias("id"))).unionByName(ways.select(F.explode("refs").alias("id"))).distinct()
        nested = more.where("type = 'relation'").select(F.col("ref").alias("id")).distinct().join(cut.select("id"), "id", "left_anti")
        cut = cut.unionByName(ds.relations.join(nested, "id", "left_semi"))
    return Dataset(ds.nodes.join(node_ids, "id", "left_semi"), ways, cut, ds.name, ds.header | {"bbox": box})


def _members_among(relations: DataFrame, present: DataFrame) -> DataFrame:
    m = relations.select("id", F.posexplode("members").alias("pos", "m")).select("id", "pos", "m.*").join(present, ["type", "ref"], "left_semi")
    kept = m.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("type", "ref", "role").alias("m")))).alias("x"))
    return relations.join(kept, "id", "left").select("id", F.coalesce(F.transform("x", lambda x: x["m"]), F.array().cast("array<struct<type:string,ref:bigint,role:string>>")).alias("members"), "tags")


def ingest(ds: Dataset, box: spatial.Box | None = None, rules: dict[str, list[tuple[str, str | None]]] | None = None, accept: dict[str, Column] | None = None) -> Dataset:
    """The part of ds that is taken while it is read. With a box, nodes are those inside, ways keep their references to nodes
    taken, relations their node and way members taken, and those left with none go. Then the rules of a kind's tags
    hold, then its condition in accept, on the entity as it is by then."""

    def cut(df: DataFrame, kind: str) -> DataFrame:
        df = df.where(T.matches_rules(F.col("tags"), (rules or {}).get(kind, [])))
        return df.where(accept[kind]) if accept and kind in accept else df

    nodes = cut(ds.nodes if box is None else spatial.nodes_in_box(ds.nodes, box), "nodes")
    ways, relations = ds.ways, ds.relations
    if box is not None:
        refs = ways.select("id", F.posexplode("refs").alias("pos", "ref")).join(nodes.select(F.col("id").alias("ref")), "ref", "left_semi")
        kept = refs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "ref"))).alias("x"))
        ways = ways.join(kept, "id").select("id", F.transform("x", lambda x: x["ref"]).alias("refs"), "tags")
    ways = cut(ways, "ways")
    if box is not None:
        ways = checkpointed(ways)
        present = nodes.select(F.lit("node").alias("type"), F.col("id").alias("ref")).unionByName(ways.select(F.lit("way").alias("type"), F.col("id").alias("ref")))
        relations = _members_among(relations, present).where(F.size("members") > 0)
    return Dataset(nodes, ways, cut(relations, "relations"), ds.name, ds.header if box is None else ds.header | {"bbox": box})
