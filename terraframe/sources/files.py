"""Map files of any kind by their names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from terraframe.model import Dataset
from terraframe.sources import geojson, geoparquet, gtfs, pbf, shapefile


def kind_of(name: str) -> str:
    """pbf, geojson, shapefile or geoparquet by a file's ending; pbf for unknown ones. A zip is taken for shapefiles, as its
    name doesn't tell a feed."""
    name = name.lower()
    if name.endswith((".geojson", ".json")):
        return "geojson"
    if name.endswith(".zip"):
        return "shapefile"
    return "geoparquet" if name.endswith(".parquet") else "pbf"


def read(spark: SparkSession, path: str) -> Dataset:
    """The file at path; of archives, those with all tables of a GTFS feed are read as one."""
    kind = kind_of(path)
    if kind == "geojson":
        return geojson.to_dataset(geojson.read_features(spark, path))
    if kind == "geoparquet":
        return geoparquet.read(spark, path)
    if kind == "shapefile":
        return gtfs.read(spark, path) if gtfs.is_feed(gtfs.zip_names(spark, path)) else shapefile.read(spark, path)
    return pbf.read(spark, path)
