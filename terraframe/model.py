"""Datasets of map entities as three DataFrames."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "id long, lon_e7 int, lat_e7 int, tags map<string,string>"
WAY_SCHEMA = "id long, refs array<long>, tags map<string,string>"
MEMBER = "struct<type:string,ref:long,role:string>"
RELATION_SCHEMA = f"id long, members array<{MEMBER}>, tags map<string,string>"


@dataclass(frozen=True)
class Dataset:
    """Nodes, ways and relations of one map, and the header of the file that they come from."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    name: str = ""
    header: dict = field(default_factory=dict)

    def views(self, prefix: str = "") -> None:
        """Registers the frames as temporary views."""
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.ways.createOrReplaceTempView(f"{prefix}ways")
        self.relations.createOrReplaceTempView(f"{prefix}relations")

    def wide(self) -> DataFrame:
        """All entities in one frame: kind, id, lat, lon, tags, refs, members."""
        n = self.nodes.select(F.lit("node").alias("kind"), "id", (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"), "tags")
        w = self.ways.select(F.lit("way").alias("kind"), "id", "tags", "refs")
        r = self.relations.select(F.lit("relation").alias("kind"), "id", "tags", "members")
        return n.unionByName(w, allowMissingColumns=True).unionByName(r, allowMissingColumns=True)

    def persist(self) -> Dataset:
        return Dataset(self.nodes.persist(), self.ways.persist(), self.relations.persist(), self.name, self.header)


def empty(spark: SparkSession) -> Dataset:
    return Dataset(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], WAY_SCHEMA), spark.createDataFrame([], RELATION_SCHEMA))


def from_rows(spark: SparkSession, nodes=(), ways=(), relations=(), name: str = "") -> Dataset:
    """A dataset of plain rows: (id, lon, lat, tags), (id, refs, tags), (id, [(type, ref, role)], tags)."""
    e7 = lambda x: int(x * 1e7 + (0.5 if x >= 0 else -0.5))
    return Dataset(
        spark.createDataFrame([(i, e7(x), e7(y), t) for i, x, y, t in nodes], NODE_SCHEMA),
        spark.createDataFrame([(i, list(r), t) for i, r, t in ways], WAY_SCHEMA),
        spark.createDataFrame([(i, [tuple(m) for m in ms], t) for i, ms, t in relations], RELATION_SCHEMA),
        name,
    )


def shared_folder(spark: SparkSession) -> None:
    """Keeps the folder that spark.checkpoint.dir names. Where none is set, a temporary one serves a local master; on a
    cluster, whose machines don't share such a folder, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def entity_texts(ds: Dataset) -> DataFrame:
    """(kind, id, body, tags): all of each entity as text."""
    text = lambda c: F.array_join(c, ",")
    tags = F.expr("array_join(transform(array_sort(map_entries(tags)), e -> concat(e.key, '=', e.value)), ';')").alias("tags")
    n = ds.nodes.select(F.lit("node").alias("kind"), "id", F.concat_ws(" ", "lon_e7", "lat_e7").alias("body"), tags)
    w = ds.ways.select(F.lit("way").alias("kind"), "id", text(F.transform("refs", lambda r: r.cast("string"))).alias("body"), tags)
    r = ds.relations.select(F.lit("relation").alias("kind"), "id", text(F.transform("members", lambda m: F.concat_ws(" ", m["type"], m["ref"].cast("string"), m["role"]))).alias("body"), tags)
    return n.unionByName(w).unionByName(r)


def fingerprint(ds: Dataset) -> DataFrame:
    """One row (entities, hash): the number of entities, and 60 bits of each one's digest, combined whatever their order."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "kind", F.col("id").cast("string"), "body", "tags")), 1, 15), 16, 10).cast("long")
    return entity_texts(ds).agg(F.count("*").alias("entities"), F.bit_xor(digest).alias("hash"))
