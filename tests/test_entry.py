import pytest

import __spark_entry__
from terraframe import registry


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["bbox_nodes", "relation_closure", "direct_changes", "way_dedup", "tile_feature_counts", "layer_mask", "knn_ways", "layer_features", "route_sssp", "pbf_round_trip", "gtfs_feed", "edges", "route_stats", "changeset_fold", "osc_augmented", "ingest_filter", "line_labels", "line_anchors", "composite_pixels", "world_positions"])
def test_against_duckdb(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())
