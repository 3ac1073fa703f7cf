"""Differences between versions of a map, their application, and removal of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions import geo, text
from terraframe.functions import tags as T
from terraframe.model import Dataset, checkpointed
from terraframe.operators import joins, spatial

KINDS = ("node", "way", "relation")


def _bodies(ds: Dataset) -> DataFrame:
    """(entity_type, id, body, tags): entities in a form that can be compared."""
    parts = {
        "node": ds.nodes.select("id", F.to_json(F.struct("lon_e7", "lat_e7")).alias("body"), "tags"),
        "way": ds.ways.select("id", F.to_json(F.struct(T.without_repeats(F.col("refs")).alias("refs"))).alias("body"), "tags"),
        "relation": ds.relations.select("id", F.to_json(F.struct(T.without_repeats(F.col("members")).alias("members"))).alias("body"), "tags"),
    }
    out = None
    for k, df in parts.items():
        df = df.select(F.lit(k).alias("entity_type"), "id", "body", T.sorted_entries(F.col("tags")).alias("tags"))
        out = df if out is None else out.unionByName(df)
    return out


def direct_changes(base: Dataset, patch: Dataset) -> DataFrame:
    """(entity_type, id, change_type): create for what base lacks, modify for what differs in it; equals have no row."""
    new = _bodies(patch)
    old = _bodies(base).select("entity_type", "id", F.col("body").alias("old_body"), F.col("tags").alias("old_tags"))
    both = new.join(old, ["entity_type", "id"], "left")
    kind = F.when(F.col("old_body").isNull(), "create").when((F.col("body") != F.col("old_body")) | (F.col("tags") != F.col("old_tags")), "modify")
    return both.select("entity_type", "id", kind.alias("change_type")).where("change_type is not null")


def deletions(base: Dataset, patch: Dataset) -> DataFrame:
    """The same form, delete for what patch lacks."""
    return _bodies(base).join(_bodies(patch), ["entity_type", "id"], "left_anti").select("entity_type", "id", F.lit("delete").alias("change_type"))


def apply_changes(base: Dataset, patch: Dataset, changes: DataFrame) -> Dataset:
    """base with the changes: creates and modifies take the patch's entity. A change that contradicts base (create of an id
    that exists, another of one that doesn't) raises when the result is read."""

    def one(kind: str, old: DataFrame, new: DataFrame) -> DataFrame:
        c = changes.where(F.col("entity_type") == kind).select("id", "change_type")
        fields = [f for f in old.columns if f != "id"]
        both = old.withColumn("there", F.lit(True)).select("id", "there", F.struct(*fields).alias("old")).join(c, "id", "full").join(new.select("id", F.struct(*fields).alias("new")), "id", "left")
        bad = (F.col("change_type") == "create") & F.col("there").isNotNull() | F.col("change_type").isin("modify", "delete") & F.col("there").isNull()
        checked = both.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(f"change of {kind} "), F.col("id"), F.lit(" contradicts the base"))).cast("boolean")).otherwise(True))
        body = F.when(F.col("change_type").isin("create", "modify"), F.col("new")).otherwise(F.col("old"))
        return checked.where(F.coalesce(F.col("change_type") != "delete", F.lit(True))).select("id", body.alias("x")).select("id", "x.*")

    return Dataset(one("node", base.nodes, patch.nodes), one("way", base.ways, patch.ways), one("relation", base.relations, patch.relations), base.name, base.header)


def change_stats(changes: DataFrame) -> DataFrame:
    """One row with the number of changes in all, by entity and by type."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    return changes.agg(F.count("*").alias("total"), *[count("entity_type", k).alias(f"{k}_changes") for k in KINDS], *[count("change_type", k).alias(f"{k}s") for k in ("create", "modify", "delete")])


def change_summary(stats: DataFrame) -> DataFrame:
    """(summary): the counts of entities' changes as one line of text, without zeros, largest first."""
    labels = {"total": "total changes"} | {f"{k}_changes": f"{k} changes" for k in KINDS}
    counts = F.array(*[F.struct((-F.col(c)).alias("n"), F.lit(i).alias("i"), F.lit(v).alias("label")) for i, (c, v) in enumerate(labels.items())])
    shown = F.transform(F.array_sort(F.filter(counts, lambda x: x["n"] < 0)), lambda x: F.concat(F.lit(" "), x["label"], F.lit(": "), F.format_number(-x["n"], 0)))
    return stats.select(F.when(F.size(shown) == 0, "Changeset is empty.").otherwise(F.concat(F.lit("Changeset summary: "), F.array_join(shown, ", "))).alias("summary"))


def fold(base: DataFrame, edits: DataFrame) -> DataFrame:
    """(entity_type, id, change_type, body, old_body): the net change of each entity of a sequence of edits (seq,
    entity_type, id, op, body) on base (entity_type, id, body).

    A create or delete replaces what was before. A modify after a create stays a create, and takes the new body; old_body is
    the one in base, none for a create. A modify of what is deleted, or of what isn't there, raises when the result is read.
    The edits of an entity are sorted and folded by windows and partial aggregates, never gathered."""
    from pyspark.sql import Window as W

    key, op = ["entity_type", "id"], F.col("op")
    known = base.select(*key, F.col("body").alias("old_body"), F.lit(True).alias("there"))
    e = edits.withColumn("before", F.lag("op").over(W.partitionBy(*key).orderBy("seq"))).join(known, key, "left")
    wrong = (op == "modify") & F.coalesce(F.col("before") == "delete", F.col("there").isNull() & F.col("before").isNull())
    e = e.where(F.when(wrong, F.raise_error(F.concat(F.lit("cannot modify "), F.concat_ws(" ", *key))).cast("boolean")).otherwise(True))
    reset = F.max_by(F.when(op != "modify", F.struct("op", "body")), F.when(op != "modify", F.col("seq")))
    net = e.groupBy(*key).agg(reset.alias("reset"), F.max_by("body", "seq").alias("last"), F.any_value("old_body").alias("own"))
    kind, gone = F.coalesce("reset.op", F.lit("modify")), F.coalesce("reset.body", "own")
    body = F.when(kind == "delete", gone).otherwise(F.col("last"))
    return net.select(*key, kind.alias("change_type"), body.alias("body"), F.when(kind == "delete", gone).when(kind == "modify", F.col("own")).alias("old_body"))


def change_page(changes: DataFrame, page: int, size: int, kinds: tuple[str, ...] = KINDS, types: tuple[str, ...] = ("create", "modify", "delete")) -> DataFrame:
    """A page of the changes that pass the filters, nodes before ways before relations, then by id; from page 0. The rows
    of a page are cut by a top-k of all rows up to its end, so no global window is needed."""
    order = F.when(F.col("entity_type") == "node", 0).when(F.col("entity_type") == "way", 1).otherwise(2)
    rows = changes.where(F.col("entity_type").isin(*kinds) & F.col("change_type").isin(*types)).withColumn("o", order)
    return rows.orderBy("o", "id").limit((page + 1) * size).orderBy("o", "id").offset(page * size).drop("o")


def node_replacements(ds: Dataset, meters: float = 1.0) -> DataFrame:
    """(id, keep): nodes that another node within a distance replaces. Of a pair the one with the higher version stays, then
    with more tags, then with the larger id; a node with several winners takes the best of them, and chains are followed
    to their end."""
    pairs = spatial.node_pairs_within(ds.nodes, ds.nodes, meters)
    # all nodes again, so not broadcast
    rank = ds.nodes.select("id", F.struct(T.version(F.col("tags")).alias("v"), F.size("tags").alias("n"), F.col("id").alias("i")).alias("r")).hint("merge")
    both = pairs.join(rank.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(rank.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
    step = both.groupBy(F.least("ra", "rb")["i"].alias("id")).agg(F.max(F.greatest("ra", "rb"))["i"].alias("keep"))
    return resolve(step)


def resolve(step: DataFrame) -> DataFrame:
    """(id, keep) with keep followed to the end of its chain, by pointer doubling: a chain of n needs log2(n) joins. A cycle,
    which has no end, raises. Replacements grow with the nodes, so they aren't broadcast."""
    now = checkpointed(step)
    for _ in range(now.count().bit_length() + 1):
        after = now.join(now.select(F.col("id").alias("keep"), F.col("keep").alias("further")).hint("merge"), "keep", "left").select("id", F.coalesce("further", "keep").alias("keep"), F.col("further").isNotNull().alias("moved"))
        after = checkpointed(after)
        if not after.where("moved").limit(1).count():
            return after.select("id", "keep")
        now = after.select("id", "keep")
    raise ValueError("replacements lead in a circle")


def replace_refs(ways: DataFrame, replacements: DataFrame) -> DataFrame:
    """Ways with replaced references, without repeats in a row. Neither the replacements nor the ways are broadcast."""
    refs = ways.select("id", F.posexplode("refs").alias("pos", "ref")).join(replacements.select(F.col("id").alias("ref"), "keep").hint("merge"), "ref", "left")
    new = refs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("keep", "ref").alias("ref")))).alias("x"))
    return ways.join(new.hint("merge"), "id", "left").select("id", T.without_repeats(F.coalesce(F.transform("x", lambda x: x["ref"]), F.col("refs"))).alias("refs"), "tags")


def way_duplicates(ds: Dataset) -> DataFrame:
    """(id, keep): ways whose coordinates equal another way's. Of equals the one with the highest version stays, then with
    the most tags, then with the smallest id. An equi-join by a group of the coordinates; no boxes are needed."""
    lines = joins.way_lines(ds).join(ds.ways.select(F.col("id").alias("way_id"), "tags"), "way_id")
    best = F.struct((-T.version(F.col("tags"))).alias("v"), (-F.size("tags")).alias("n"), F.col("way_id").alias("i"))
    key = F.sha2(F.to_json("line"), 256)
    g = lines.select("way_id", key.alias("k"), best.alias("best"))
    keep = g.groupBy("k").agg(F.min("best")["i"].alias("keep"), F.count("*").alias("n")).where("n > 1")
    return g.join(keep, "k").where("way_id <> keep").select(F.col("way_id").alias("id"), "keep")


def deduplicate(ds: Dataset, meters: float = 1.0) -> Dataset:
    """ds without duplicate nodes and ways; references and members follow."""
    nodes = node_replacements(ds, meters)
    ways = replace_refs(ds.ways, nodes)
    once = Dataset(ds.nodes.join(nodes.select("id"), "id", "left_anti"), ways, ds.relations, ds.name, ds.header)
    gone = way_duplicates(once)
    relations = replace_members(ds.relations, nodes.select(F.lit("node").alias("type"), F.col("id").alias("ref"), "keep").unionByName(gone.select(F.lit("way").alias("type"), F.col("id").alias("ref"), "keep")))
    return Dataset(once.nodes, ways.join(gone.select("id"), "id", "left_anti"), relations, ds.name, ds.header)


def replace_members(relations: DataFrame, replacements: DataFrame) -> DataFrame:
    """Relations with replaced members (type, ref, keep), without repeats in a row."""
    m = relations.select("id", F.posexplode("members").alias("pos", "m")).select("id", "pos", "m.*").join(replacements, ["type", "ref"], "left")
    new = m.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("type", F.coalesce("keep", "ref").alias("ref"), "role").alias("m")))).alias("x"))
    return relations.join(new, "id", "left").select("id", T.without_repeats(F.coalesce(F.transform("x", lambda x: x["m"]), F.col("members"))).alias("members"), "tags")


def new_ids(rows: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """rows with an id each, above all existing ones, in an order. The numbers come from per-partition counts of a range
    sort, not from one global window."""
    spark = rows.sparkSession
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    # a range partitioning is sampled: computed again after a loss, it could number otherwise
    ordered = checkpointed(ordered)
    sizes = sorted((r["p"], r["n"], r["lo"]) for r in ordered.groupBy("p").agg(F.count("*").alias("n"), F.min("i").alias("lo")).collect())
    offsets, at = [], top + 1
    for p, n, lo in sizes:
        offsets.append((p, at - lo))
        at += n
    off = spark.createDataFrame(offsets, "p int, off long")
    return ordered.join(F.broadcast(off), "p").withColumn("id", F.col("i") + F.col("off")).drop("p", "i", "off")


def merge(base: Dataset, patch: Dataset, meters: float = 1.0, dedup: bool = True, intersections: bool = True) -> Dataset:
    """patch laid over base, then without duplicates, and with a shared node where ways that should connect cross."""
    merged = apply_changes(base, patch, direct_changes(base, patch))
    if dedup:
        merged = deduplicate(merged, meters)
    return create_intersections(merged, meters=meters) if intersections else merged


def create_intersections(ds: Dataset, cell_e7: int = 100_000, meters: float = 1.0) -> Dataset:
    """ds with a node in both ways wherever two that should connect cross or touch. An end of one of the two segments is that
    node if it lies within a distance of the point, the nearest one, else the one with the smallest id; otherwise a new node
    tagged crossing=yes, one for each point."""
    cross = checkpointed(crossings(ds, cell_e7))
    if not cross.limit(1).count():
        return ds
    key = ["a", "b", "pos_a", "pos_b", "x", "y"]
    ends = joins.segments(ds)
    ends = ends.select("way_id", "pos", F.explode(F.array(F.struct(F.col("a").alias("ref"), F.col("ax").alias("ex"), F.col("ay").alias("ey")), F.struct(F.col("b").alias("ref"), F.col("bx").alias("ex"), F.col("by").alias("ey")))).alias("e")).select("way_id", "pos", "e.*")
    side = lambda way, pos: cross.join(ends.withColumnsRenamed({"way_id": way, "pos": pos}), [way, pos])
    both = side("a", "pos_a").unionByName(side("b", "pos_b")).withColumn("m", geo.haversine_m(*(F.col(c) / 1e7 for c in ("x", "y", "ex", "ey"))))
    found = both.where(F.col("m") <= meters).groupBy(key).agg(F.min(F.struct("m", "ref"))["ref"].alias("node"))
    cross = checkpointed(cross.join(found, key, "left"))
    fresh = new_ids(cross.where("node is null").select("x", "y").distinct(), ds.nodes, ["x", "y"]).withColumnRenamed("id", "made")
    fresh = checkpointed(fresh)
    at = cross.join(fresh, ["x", "y"], "left").withColumn("node", F.coalesce("node", "made"))
    inserts = at.select(F.col("a").alias("id"), F.col("pos_a").alias("pos"), "x", "y", "node").unionByName(at.select(F.col("b").alias("id"), F.col("pos_b").alias("pos"), "x", "y", "node"))
    nodes = ds.nodes.unionByName(fresh.select(F.col("made").alias("id"), F.col("x").cast("int").alias("lon_e7"), F.col("y").cast("int").alias("lat_e7"), F.create_map(F.lit("crossing"), F.lit("yes")).alias("tags")))
    return Dataset(nodes, splice(ds, inserts), ds.relations, ds.name, ds.header)


def splice(ds: Dataset, inserts: DataFrame) -> DataFrame:
    """The ways of ds with nodes (id, pos, x, y, node) put in behind the reference at pos, in the order in which they lie on
    the segment; without repeats in a row."""
    start = joins.way_points(ds, ds.ways.join(inserts.select("id").distinct(), "id", "left_semi")).select(F.col("way_id").alias("id"), "pos", F.col("lon_e7").alias("sx"), F.col("lat_e7").alias("sy"))
    far = lambda p, q: (F.col(p).cast("double") - F.col(q)) ** 2
    new = inserts.join(start, ["id", "pos"]).select("id", "pos", (far("x", "sx") + far("y", "sy")).alias("d"), F.col("node").alias("ref"), F.lit(1).alias("o"))
    old = ds.ways.join(inserts.select("id").distinct(), "id", "left_semi").select("id", F.posexplode("refs").alias("pos", "ref")).select("id", "pos", F.lit(0.0).alias("d"), "ref", F.lit(0).alias("o"))
    refs = old.unionByName(new).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "o", "d", "ref"))).alias("x"))
    return ds.ways.join(refs, "id", "left").select("id", T.without_repeats(F.coalesce(F.transform("x", lambda x: x["ref"]), F.col("refs"))).alias("refs"), "tags")


def osc_rows(base: Dataset, patch: Dataset, changes: DataFrame, augmented: bool = False) -> DataFrame:
    """(section, o, id, xml): each change as an element of an osmChange file; sections create, modify, delete, in these
    nodes, ways, relations by id. Augmented, modified elements have their old and new form, deleted ones the old form."""
    tag = lambda tags: F.array_join(F.transform(T.sorted_entries(tags), lambda e: F.concat(F.lit('<tag k="'), text.xml_escape(e["key"]), F.lit('" v="'), text.xml_escape(e["value"]), F.lit('"/>'))), "")
    num = lambda c: F.format_string("%.7f", c / 1e7)
    i = F.col("id").cast("string")

    def bodies(ds: Dataset) -> DataFrame:
        n = ds.nodes.select(F.lit("node").alias("entity_type"), F.lit(0).alias("o"), "id", F.concat(F.lit('<node id="'), i, F.lit('" lat="'), num(F.col("lat_e7")), F.lit('" lon="'), num(F.col("lon_e7")), F.lit('">'), tag(F.col("tags")), F.lit("</node>")).alias("xml"))
        w = ds.ways.select(F.lit("way").alias("entity_type"), F.lit(1).alias("o"), "id", F.concat(F.lit('<way id="'), i, F.lit('">'), F.array_join(F.transform("refs", lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>'))), ""), tag(F.col("tags")), F.lit("</way>")).alias("xml"))
        m = F.transform("members", lambda m: F.concat(F.lit('<member type="'), m["type"], F.lit('" ref="'), m["ref"].cast("string"), F.lit('" role="'), text.xml_escape(F.coalesce(m["role"], F.lit(""))), F.lit('"/>')))
        r = ds.relations.select(F.lit("relation").alias("entity_type"), F.lit(2).alias("o"), "id", F.concat(F.lit('<relation id="'), i, F.lit('">'), F.array_join(m, ""), tag(F.col("tags")), F.lit("</relation>")).alias("xml"))
        return n.unionByName(w).unionByName(r)

    if augmented:
        now, was = bodies(patch).withColumnRenamed("xml", "now"), bodies(base).select("entity_type", "id", F.col("o").alias("p"), F.col("xml").alias("was"))
        old = F.concat(F.lit("<old>"), F.col("was"), F.lit("</old>"))
        both = changes.join(now, ["entity_type", "id"], "left").join(was, ["entity_type", "id"], "left")
        xml = F.when(F.col("change_type") == "delete", old).when(F.col("change_type") == "modify", F.concat(old, F.lit("<new>"), F.col("now"), F.lit("</new>"))).otherwise(F.col("now"))
        return both.select(F.col("change_type").alias("section"), F.coalesce("o", "p").alias("o"), "id", xml.alias("xml"))
    new = changes.where("change_type <> 'delete'").join(bodies(patch), ["entity_type", "id"])
    old = changes.where("change_type = 'delete'").join(bodies(base), ["entity_type", "id"])
    return new.unionByName(old).select(F.col("change_type").alias("section"), "o", "id", "xml")


def crossings(ds: Dataset, cell_e7: int) -> DataFrame:
    """Points where ways that should connect cross (see spatial.segment_crossings)."""
    ways = ds.ways.where(T.crossing_candidate(F.col("tags")))
    return spatial.segment_crossings(ds, ways, cell_e7, T.should_connect(F.col("a_tags"), F.col("b_tags")))
