"""Parquet files with a geometry column: rows become entities as features do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from terraframe.model import Dataset, checkpointed
from terraframe.sources import geojson, wkb

TAGS = "map<string,string>"


def _text_tags(df: DataFrame, column: str | None) -> Column:
    """Tags as text to text, of a map, a struct or JSON text; null values go."""
    if column is None or column not in df.columns:
        return F.expr(f"cast(map() as {TAGS})")
    kind = df.schema[column].dataType
    as_json = F.col(column) if isinstance(kind, t.StringType) else F.to_json(F.col(column))
    tags = F.col(column).cast(TAGS) if isinstance(kind, t.MapType) else F.from_json(as_json, TAGS)
    return F.coalesce(F.map_filter(tags, lambda _, v: v.isNotNull()), F.expr(f"cast(map() as {TAGS})"))


def _closed(kind: Column, text: Column) -> Column:
    """Coordinates whose rings end where they begin."""
    close = lambda rings: F.transform(rings, lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))))
    one = F.to_json(close(F.from_json(text, geojson.RINGS)))
    many = F.to_json(F.transform(F.from_json(text, geojson.MULTI), close))
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).otherwise(text)


def read_features(spark: SparkSession, path: str, id_col: str = "id", geometry_col: str = "geometry", tags_col: str | None = "tags", type_col: str | None = "type") -> DataFrame:
    """(ord, id, tags, kind, coordinates) of the rows. Only the named columns are read. The geometry is WKB, or GeoJSON as text
    or a struct; rows without a valid one go. Where the type is "way", a polygon counts without its holes. Rings are closed.
    MultiPoints and collections raise."""
    df = spark.read.parquet(path)
    geometry = df.schema[geometry_col].dataType
    own = df.select(
        F.monotonically_increasing_id().alias("ord"),
        (F.col(id_col).cast("long") if id_col in df.columns else F.lit(None).cast("long")).alias("own"),
        _text_tags(df, tags_col).alias("tags"),
        (F.col(type_col).cast("string") if type_col in df.columns else F.lit(None).cast("string")).alias("entity"),
        F.col(geometry_col).alias("geometry"),
    )
    own = checkpointed(own)
    if isinstance(geometry, t.BinaryType):
        shapes = wkb.decode(own, "ord")
    else:
        text = F.col("geometry") if isinstance(geometry, t.StringType) else F.to_json("geometry")
        shapes = own.select(F.col("ord").alias("id"), F.from_json(text, "struct<type:string,coordinates:string>").alias("g")).select("id", F.col("g.type").alias("kind"), "g.coordinates")
    shapes = shapes.where("kind is not null and coordinates is not null").withColumnRenamed("id", "ord")
    bad = F.col("kind").isin("MultiPoint", "GeometryCollection")
    shapes = shapes.where(F.when(bad, F.raise_error(F.concat(F.lit("geometry is not supported: "), F.col("kind"))).cast("boolean")).otherwise(True))
    both = own.drop("geometry").join(shapes.select("ord", "kind", _closed(F.col("kind"), F.col("coordinates")).alias("coordinates")), "ord")
    outer = (F.col("entity") == "way") & (F.col("kind") == "Polygon")
    first = F.to_json(F.slice(F.from_json("coordinates", geojson.RINGS), 1, 1))
    return both.select("ord", F.col("own").alias("id"), "tags", "kind", F.when(outer, first).otherwise(F.col("coordinates")).alias("coordinates"))


def read(spark: SparkSession, path: str, **columns: str | None) -> Dataset:
    """The rows as a dataset; see geojson.to_dataset."""
    return geojson.to_dataset(read_features(spark, path, **columns))
