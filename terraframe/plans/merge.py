"""Comparing, merging, deduplicating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.model import Dataset
from terraframe.operators import change, spatial
from terraframe.plans.base import query, tags_sql, tags_text, versions
from terraframe.sources.tables import VERSIONS

SIDES = "".join(
    f", {v}b AS (SELECT 'node' AS entity_type, id, lon_e7 || ' ' || lat_e7 AS body, {tags_sql()} FROM {v}_nodes"
    f" UNION ALL SELECT 'way', id, array_to_string([refs[i] for i in range(1, len(refs) + 1) if i = len(refs) OR refs[i] <> refs[i + 1]], ','), {tags_sql()} FROM {v}_ways"
    f" UNION ALL SELECT 'relation', id, array_to_string([m.type || m.ref || m.role for m in members], ','), {tags_sql()} FROM {v}_relations)"
    for v in ("base", "patch")
)
CHANGES = f"{SIDES}, changes AS (SELECT entity_type, id, CASE WHEN b.id IS NULL THEN 'create' ELSE 'modify' END AS change_type FROM patchb p LEFT JOIN baseb b USING (entity_type, id) WHERE b.body IS NULL OR b.body <> p.body OR b.tags <> p.tags)"


@query(f"{CHANGES} SELECT * FROM changes", VERSIONS)
@versions
def direct_changes(base: Dataset, patch: Dataset) -> DataFrame:
    return change.direct_changes(base, patch)


@query(f"{SIDES} SELECT entity_type, id, 'delete' AS change_type FROM baseb WHERE (entity_type, id) NOT IN (SELECT (entity_type, id) FROM patchb)", VERSIONS)
@versions
def deletions(base: Dataset, patch: Dataset) -> DataFrame:
    return change.deletions(base, patch)


@query(f"{CHANGES} SELECT count(*) AS total, count(*) FILTER (entity_type = 'node') AS node_changes, count(*) FILTER (entity_type = 'way') AS way_changes, count(*) FILTER (entity_type = 'relation') AS relation_changes, count(*) FILTER (change_type = 'create') AS creates, count(*) FILTER (change_type = 'modify') AS modifys, count(*) FILTER (change_type = 'delete') AS deletes FROM changes", VERSIONS)
@versions
def change_stats(base: Dataset, patch: Dataset) -> DataFrame:
    return change.change_stats(change.direct_changes(base, patch))


@query(f"""{CHANGES}, n AS (SELECT 0 AS i, 'total changes' AS label, count(*) AS n FROM changes UNION ALL SELECT CASE entity_type WHEN 'node' THEN 1 WHEN 'way' THEN 2 ELSE 3 END, entity_type || ' changes', count(*) FROM changes GROUP BY entity_type)
SELECT 'Changeset summary: ' || string_agg(' ' || label || ': ' || format('{{:,}}', n), ', ' ORDER BY n DESC, i) AS summary FROM n""", VERSIONS)
@versions
def change_summary(base: Dataset, patch: Dataset) -> DataFrame:
    return change.change_summary(change.change_stats(change.direct_changes(base, patch)))


_DELETED = "id % 5 = 0 AND (id % 4 <> 0 OR id % 3 = 0)"


@query(f"""SELECT 'node' AS entity_type, id, CASE WHEN {_DELETED} AND id % 25 = 0 THEN 'create' WHEN {_DELETED} THEN 'delete' WHEN id % 4 = 0 THEN 'create' ELSE 'modify' END AS change_type,
CASE WHEN {_DELETED} AND id % 25 = 0 THEN 'c' || id WHEN {_DELETED} THEN CASE WHEN id % 4 <> 0 THEN 'base' || id END WHEN id % 2 = 0 THEN 'b' || id ELSE 'a' || id END AS body,
CASE WHEN id % 4 <> 0 AND NOT ({_DELETED} AND id % 25 = 0) THEN 'base' || id END AS old_body FROM nodes WHERE id % 3 = 0 OR {_DELETED}""")
def changeset_fold(ds: Dataset) -> DataFrame:
    """Up to four edits of each node in turn, over a base without every fourth node."""
    i, kind = F.col("id"), F.lit("node").alias("entity_type")
    base = ds.nodes.where(i % 4 != 0).select(kind, "id", F.concat(F.lit("base"), i).alias("body"))
    edit = lambda seq, rows, op, mark: ds.nodes.where(rows).select(F.lit(seq).alias("seq"), kind, "id", op.alias("op"), (F.concat(F.lit(mark), i) if mark else F.lit(None).cast("string")).alias("body"))
    edits = edit(1, "id % 3 = 0", F.when(i % 4 == 0, "create").otherwise("modify"), "a").unionByName(edit(2, "id % 6 = 0", F.lit("modify"), "b"))
    edits = edits.unionByName(edit(3, _DELETED, F.lit("delete"), None)).unionByName(edit(4, f"{_DELETED} AND id % 25 = 0", F.lit("create"), "c"))
    return change.fold(base, edits)


@query(f"{CHANGES} SELECT entity_type, id, change_type FROM changes WHERE change_type = 'modify' ORDER BY CASE entity_type WHEN 'node' THEN 0 WHEN 'way' THEN 1 ELSE 2 END, id LIMIT 50 OFFSET 100", VERSIONS)
@versions
def change_page(base: Dataset, patch: Dataset) -> DataFrame:
    """Page 2 of 50 rows: paging is the feature."""
    return change.change_page(change.direct_changes(base, patch), 2, 50, types=("modify",))


MERGED = "".join(f", merged_{n} AS (SELECT * FROM patch_{n} UNION ALL SELECT * FROM base_{n} WHERE id NOT IN (SELECT id FROM patch_{n}))" for n in ("nodes", "ways", "relations"))


@query(f"{MERGED} SELECT 'node' AS kind, id, {tags_sql()} FROM merged_nodes UNION ALL SELECT 'way', id, {tags_sql()} FROM merged_ways UNION ALL SELECT 'relation', id, {tags_sql()} FROM merged_relations", VERSIONS)
@versions
def apply_changes(base: Dataset, patch: Dataset) -> DataFrame:
    out = change.apply_changes(base, patch, change.direct_changes(base, patch))
    return out.wide().selectExpr("kind", "id", tags_text())


@query("SELECT a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.lon_e7 = b.lon_e7 AND a.lat_e7 = b.lat_e7 AND a.id < b.id")
def node_dedup_pairs(ds: Dataset) -> DataFrame:
    """Pairs within a metre; in these tables all of them are on one spot."""
    return spatial.node_pairs_within(ds.nodes, ds.nodes, 1.0).select("a", "b")


_RANK = "(coalesce(TRY_CAST({t}.tags['ext:osm_version'] AS DOUBLE), 0), cardinality({t}.tags), {t}.id)"
PAIRS = f", np AS (SELECT a.id AS a, b.id AS b, {_RANK.format(t='a')} > {_RANK.format(t='b')} AS first FROM nodes a JOIN nodes b ON a.lon_e7 = b.lon_e7 AND a.lat_e7 = b.lat_e7 AND a.id < b.id), nm AS (SELECT CASE WHEN first THEN b ELSE a END AS id, CASE WHEN first THEN a ELSE b END AS keep FROM np)"


@query(f"{PAIRS} SELECT id, keep FROM nm")
def node_dedup_map(ds: Dataset) -> DataFrame:
    return change.node_replacements(ds)


@query(f"{PAIRS}, nr AS (SELECT w.id, i, coalesce(keep, refs[i]) AS ref FROM (SELECT id, refs, unnest(range(1, len(refs) + 1)) AS i FROM ways) w LEFT JOIN nm ON nm.id = refs[i]), nl AS (SELECT id, list(ref ORDER BY i) AS refs FROM nr GROUP BY id) SELECT id, array_to_string([refs[i] for i in range(1, len(refs) + 1) if i = len(refs) OR refs[i] <> refs[i + 1]], ',') AS refs FROM nl")
def way_ref_replacement(ds: Dataset) -> DataFrame:
    out = change.replace_refs(ds.ways, change.node_replacements(ds))
    return out.select("id", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("refs"))


@query(""", wl AS (SELECT id, tags, array_to_string([r % 7 for r in refs], ',') AS line FROM ways), wr AS (SELECT id, line, row_number() OVER (PARTITION BY line ORDER BY coalesce(TRY_CAST(tags['ext:osm_version'] AS DOUBLE), 0) DESC, cardinality(tags) DESC, id) AS n, first_value(id) OVER (PARTITION BY line ORDER BY coalesce(TRY_CAST(tags['ext:osm_version'] AS DOUBLE), 0) DESC, cardinality(tags) DESC, id) AS keep FROM wl)
SELECT id, keep FROM wr WHERE n > 1""")
def way_dedup(ds: Dataset) -> DataFrame:
    """Over references modulo seven, so that lines repeat."""
    few = Dataset(ds.nodes, ds.ways.withColumn("refs", F.transform("refs", lambda r: r % 7)), ds.relations)
    return change.way_duplicates(few)


@query("SELECT (SELECT max(id) FROM nodes) + row_number() OVER (ORDER BY x, id) AS id, id AS old FROM (SELECT id, lon_e7 AS x FROM nodes WHERE tags['place'] IS NOT NULL)")
def new_node_ids(ds: Dataset) -> DataFrame:
    rows = ds.nodes.where("tags['place'] is not null").select(F.col("id").alias("old"), F.col("lon_e7").alias("x"))
    return change.new_ids(rows, ds.nodes, ["x", "old"]).select("id", "old")


def _tag_xml(c: str) -> str:
    esc = lambda v: f"replace(replace(replace(replace(replace({v}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
    return f"array_to_string(list_sort(['<tag k=\"' || {esc('e.key')} || '\" v=\"' || {esc('e.value')} || '\"/>' for e in map_entries({c})]), '')"


def _xml(v: str) -> str:
    return f"""SELECT 'node' AS entity_type, id, '<node id="' || id || '" lat="' || printf('%.7f', lat_e7 / 1e7) || '" lon="' || printf('%.7f', lon_e7 / 1e7) || '">' || {_tag_xml('tags')} || '</node>' AS xml FROM {v}_nodes
UNION ALL SELECT 'way', id, '<way id="' || id || '">' || array_to_string(['<nd ref="' || r || '"/>' for r in refs], '') || {_tag_xml('tags')} || '</way>' FROM {v}_ways
UNION ALL SELECT 'relation', id, '<relation id="' || id || '">' || array_to_string(['<member type="' || m.type || '" ref="' || m.ref || '" role="' || m.role || '"/>' for m in members], '') || {_tag_xml('tags')} || '</relation>' FROM {v}_relations"""


@query(f"""{CHANGES}, x AS ({_xml('patch')})
SELECT change_type AS section, id, xml FROM changes JOIN x USING (entity_type, id)""", VERSIONS)
@versions
def osc_xml(base: Dataset, patch: Dataset) -> DataFrame:
    return change.osc_rows(base, patch, change.direct_changes(base, patch)).select("section", "id", "xml")


@query(f"""{CHANGES}, x AS ({_xml('patch')}), y AS ({_xml('base')}) SELECT change_type AS section, id, CASE change_type WHEN 'create' THEN x.xml ELSE '<old>' || y.xml || '</old><new>' || x.xml || '</new>' END AS xml FROM changes JOIN x USING (entity_type, id) LEFT JOIN y USING (entity_type, id)
UNION ALL SELECT 'delete', id, '<old>' || y.xml || '</old>' FROM y WHERE (entity_type, id) NOT IN (SELECT (entity_type, id) FROM x)""", VERSIONS)
@versions
def osc_augmented(base: Dataset, patch: Dataset) -> DataFrame:
    every = change.direct_changes(base, patch).unionByName(change.deletions(base, patch))
    return change.osc_rows(base, patch, every, augmented=True).select("section", "id", "xml")
