"""GTFS feeds as maps: stops are nodes, the shapes of routes ways."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.functions.text import hex_color
from terraframe.model import Dataset

# Fixed values of the format.
ROUTE_TYPES = {"0": "tram", "1": "subway", "2": "train", "3": "bus", "4": "ferry", "5": "tram", "6": "aerialway", "7": "funicular", "11": "trolleybus", "12": "train"}
NEEDED = ("agency.txt", "stops.txt", "routes.txt", "trips.txt", "stop_times.txt")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of an unpacked feed; all columns are text."""
    return spark.read.csv(f"{folder}/{name}", header=True, quote='"', escape='"')


def _column(df: DataFrame, name: str) -> Column:
    return F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _tags(pairs: list[tuple[str, Column]]) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def stop_tags(stops: DataFrame) -> Column:
    c = lambda name: _column(stops, name)
    kind = F.coalesce(c("location_type"), F.lit("0"))
    wheelchair = F.when(c("wheelchair_boarding") == "1", "yes").when(c("wheelchair_boarding") == "2", "no")
    return _tags([
        ("public_transport", F.when(kind == "1", "station").when(kind != "2", "platform")), ("railway", F.when(kind == "2", "subway_entrance")),
        ("name", c("stop_name")), ("ref", c("stop_id")), ("ref:gtfs:stop_code", c("stop_code")), ("description", c("stop_desc")),
        ("website", c("stop_url")), ("ref:platform", c("platform_code")), ("wheelchair", wheelchair),
    ])


def route_kind(route_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ROUTE_TYPES.items() for x in kv])
    return F.coalesce(table[route_type], F.lit("bus"))


def route_tags(routes: DataFrame) -> Column:
    c = lambda name: _column(routes, name)
    return _tags([
        ("route", route_kind(c("route_type"))), ("name", F.coalesce(c("route_long_name"), c("route_short_name"))), ("ref", c("route_short_name")),
        ("ref:gtfs:route_id", c("route_id")), ("description", c("route_desc")), ("website", c("route_url")), ("color", hex_color(c("route_color"))),
        ("text_color", hex_color(c("route_text_color"))), ("gtfs:route_type", c("route_type")),
    ])


def to_dataset(stops: DataFrame, routes: DataFrame, trips: DataFrame, shapes: DataFrame) -> Dataset:
    """One way for each shape and route, with the ids (sorted) and number of its trips. Stops without coordinates, and
    shapes of less than two points, are left out. New ids are negative."""
    from terraframe.operators.change import new_ids

    spark = stops.sparkSession
    none = spark.createDataFrame([(0,)], "id long")
    e7 = lambda c: F.floor(c.try_cast("double") * 1e7 + 0.5).cast("int")
    at = stops.select("stop_id", e7(F.col("stop_lon")).alias("lon_e7"), e7(F.col("stop_lat")).alias("lat_e7"), stop_tags(stops).alias("tags")).where("lon_e7 is not null and lat_e7 is not null")
    points = shapes.select("shape_id", F.col("shape_pt_sequence").try_cast("int").alias("seq"), e7(F.col("shape_pt_lon")).alias("lon_e7"), e7(F.col("shape_pt_lat")).alias("lat_e7")).where("lon_e7 is not null and lat_e7 is not null")
    used = trips.where("shape_id <> ''").groupBy("shape_id", "route_id").agg(F.array_sort(F.collect_list("trip_id")).alias("ids"))
    long = points.groupBy("shape_id").agg(F.count("*").alias("n")).where("n >= 2").select("shape_id")
    used = used.join(long, "shape_id").join(routes.select("route_id", route_tags(routes).alias("tags")), "route_id")
    nodes = at.select(F.lit(0).alias("o"), F.col("stop_id").alias("k"), F.lit(0).alias("seq"), "lon_e7", "lat_e7", "tags").unionByName(points.join(used.select("shape_id").distinct(), "shape_id").select(F.lit(1).alias("o"), F.col("shape_id").alias("k"), "seq", "lon_e7", "lat_e7", F.expr("cast(map() as map<string,string>)").alias("tags")))
    numbered = new_ids(nodes, none, ["o", "k", "seq"]).withColumn("id", -F.col("id")).persist()
    refs = numbered.where("o = 1").groupBy(F.col("k").alias("shape_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("x")).select("shape_id", F.transform("x", lambda x: x["id"]).alias("refs"))
    more = F.create_map(F.lit("gtfs:trip_ids"), F.array_join("ids", ";"), F.lit("gtfs:trip_count"), F.size("ids").cast("string"), F.lit("ref:gtfs:shape_id"), F.col("shape_id"))
    ways = new_ids(used.join(refs, "shape_id").select("shape_id", "route_id", "refs", F.map_concat("tags", more).alias("tags")), none, ["shape_id", "route_id"])
    return Dataset(numbered.select("id", "lon_e7", "lat_e7", "tags"), ways.select((-F.col("id")).alias("id"), "refs", "tags"), spark.createDataFrame([], "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"))


def is_feed(names: list[str]) -> bool:
    """Whether an archive's files include all that a feed needs."""
    return set(NEEDED) <= {n.rsplit("/", 1)[-1] for n in names}


def zip_names(spark: SparkSession, path: str) -> list[str]:
    """The names of an archive's files; they are few."""

    def names(batches):
        for b in batches:
            for content in b.column(0):
                yield pa.RecordBatch.from_pydict({"name": zipfile.ZipFile(io.BytesIO(content.as_py())).namelist()}, schema=pa.schema([("name", pa.string())]))

    return [r["name"] for r in spark.read.format("binaryFile").load(path).select("content").mapInArrow(names, "name string").collect()]


def read_zip_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a feed in an archive, read on an executor line by line; all columns are text. A missing table raises."""

    def rows(batches):
        schema = pa.schema([("n", pa.int64()), ("row", pa.list_(pa.string()))])
        for b in batches:
            for content in b.column(0):
                archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                member = next((n for n in archive.namelist() if n.rsplit("/", 1)[-1] == name), None)
                if member is None:
                    raise ValueError(f"the feed has no {name}")
                with archive.open(member) as f:
                    lines = enumerate(csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline="")))
                    while part := list(itertools.islice(lines, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int64()), pa.array([r for _, r in part], pa.list_(pa.string()))], schema=schema)

    df = spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "n long, row array<string>")
    header = df.where("n = 0").first()
    return df.where("n > 0 and size(row) > 0").select(*[F.get("row", F.lit(i)).alias(c.strip()) for i, c in enumerate(header["row"] if header else [])])


def read(spark: SparkSession, path: str) -> Dataset:
    """A feed in an archive, or unpacked into a folder that all executors reach; a missing shapes.txt raises."""
    t = lambda name: (read_zip_table if path.lower().endswith(".zip") else read_table)(spark, path, name)
    return to_dataset(t("stops.txt"), t("routes.txt"), t("trips.txt"), t("shapes.txt"))
