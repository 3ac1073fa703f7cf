"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraframe.model import Dataset
from terraframe.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = tables.VIEWS, name: str | None = None):
    """Registers f(dataset) as a query of its name. sql: what follows the views (", x AS (...) SELECT ..." or "SELECT ...");
    without views, the whole text."""

    def add(f: Callable[[Dataset], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(tables.dataset(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = f"{views}{'' if sql.lstrip().startswith(',') or not views else ' '}{sql}"
        return f

    return add


def versions(f: Callable[[Dataset, Dataset], DataFrame]) -> Callable[[Dataset], DataFrame]:
    """f(base, patch) as a query of a dataset."""

    def run(ds: Dataset) -> DataFrame:
        return f(tables.part_of(ds, 2), tables.part_of(ds, 1))

    run.__name__ = f.__name__
    return run


def tags_text(column: str = "tags", alias: str = "tags") -> str:
    """Spark SQL: a tag map as sorted text."""
    return f"array_join(transform(array_sort(map_entries({column})), e -> concat(e.key, '=', e.value)), ';') AS {alias}"


def tags_sql(column: str = "tags", alias: str = "tags") -> str:
    """The same for DuckDB."""
    return f"array_to_string(list_sort([e.key || '=' || e.value for e in map_entries({column})]), ';') AS {alias}"
