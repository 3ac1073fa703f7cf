"""Labels, pixels and positions on a display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.functions import color, geo
from terraframe.model import Dataset
from terraframe.operators import joins, labels
from terraframe.plans.base import query
from terraframe.plans.lookup import POINTS


@query(""", c AS (SELECT CASE WHEN tags['natural'] = 'water' THEN 'water' WHEN tags['building'] = 'yes' THEN 'place' ELSE 'road' END AS kind, CASE WHEN tags['highway'] IS NULL THEN 'Area ' || id % 50 WHEN id % 2 = 0 THEN upper(tags['name']) ELSE tags['name'] END AS text,
CASE tags['highway'] WHEN 'motorway' THEN 9 WHEN 'primary' THEN 7 WHEN 'residential' THEN 5 ELSE 3 END AS priority, CAST(len(refs) AS INTEGER) AS length, 'way/' || id AS key FROM ways)
SELECT * FROM c WHERE kind = 'place' UNION ALL SELECT kind, text, priority, length, key FROM (SELECT *, row_number() OVER (PARTITION BY kind, lower(text) ORDER BY priority DESC, length DESC, key) AS n FROM c WHERE kind <> 'place') WHERE n = 1""")
def line_labels(ds: Dataset) -> DataFrame:
    t, i = lambda k: F.col("tags")[k], F.col("id")
    kind = F.when(t("natural") == "water", "water").when(t("building") == "yes", "place").otherwise("road")
    text = F.when(t("highway").isNull(), F.concat(F.lit("Area "), i % 50)).when(i % 2 == 0, F.upper(t("name"))).otherwise(t("name"))
    priority = F.when(t("highway") == "motorway", 9).when(t("highway") == "primary", 7).when(t("highway") == "residential", 5).otherwise(3)
    return labels.best_lines(ds.ways.select(kind.alias("kind"), text.alias("text"), priority.alias("priority"), F.size("refs").alias("length"), F.concat(F.lit("way/"), i).alias("key")))


@query(f"""{POINTS}, g AS (SELECT way_id, i, lon_e7 AS ax, lat_e7 AS ay, lead(lon_e7) OVER w AS bx, lead(lat_e7) OVER w AS dy FROM p WINDOW w AS (PARTITION BY way_id ORDER BY i)), d AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(dy - ay, 2)) AS d FROM g WHERE bx IS NOT NULL),
e AS (SELECT *, sum(d) OVER (PARTITION BY way_id ORDER BY i) AS upto, sum(d) OVER (PARTITION BY way_id) AS total FROM d), f AS (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY i) AS n, CASE WHEN d = 0 THEN 0 ELSE (total / 2 - (upto - d)) / d END AS part FROM e WHERE total / 2 <= upto)
SELECT way_id, round(total) AS length, round(ax + (bx - ax) * part) AS x, round(ay + (dy - ay) * part) AS y FROM f WHERE n = 1""")
def line_anchors(ds: Dataset) -> DataFrame:
    """Planar length and midpoint of all ways of two points or more, in 1e-7 degrees."""
    line = F.transform("line", lambda p: F.struct(p["lon_e7"].cast("double").alias("x"), p["lat_e7"].cast("double").alias("y")))
    at = joins.way_lines(ds).where(F.size("line") >= 2).select("way_id", line.alias("line")).select("way_id", labels.line_length(F.col("line")).alias("length"), labels.line_midpoint(F.col("line")).alias("at"))
    return at.select("way_id", F.round("length").alias("length"), F.round("at.x").alias("x"), F.round("at.y").alias("y"))


#: Factors of the channels of two pixels for each part.
FIRST, SECOND = {"r": 37, "g": 53, "b": 97, "a": 13}, {"r": 61, "g": 29, "b": 7, "a": 17}
_LINEAR = "(CASE WHEN {0} / 255e0 <= 0.04045e0 THEN {0} / 255e0 / 12.92e0 ELSE pow(({0} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END)"
_OVER = ", ".join(f"{_LINEAR.format('t' + c)} * ta / 255e0 + {_LINEAR.format('s' + c)} * sa / 255e0 * (1 - ta / 255e0) AS {c}" for c in color.CHANNELS)
_SRGB = "CAST(CASE WHEN a <= 0 THEN 0 ELSE floor(least(255e0, greatest(0e0, CASE WHEN {0} / a <= 0.0031308e0 THEN 255 * 12.92e0 * {0} / a ELSE 255 * (1.055e0 * pow({0} / a, 1 / 2.4e0) - 0.055e0) END)) + 0.5e0) END AS INTEGER) AS {0}"


@query(f"""WITH k AS (SELECT p_partkey AS id, {", ".join(f"p_partkey * {n} % 256 AS {s}{c}" for s, t in (("s", FIRST), ("t", SECOND)) for c, n in t.items())} FROM part),
o AS (SELECT id, {_OVER}, ta / 255e0 + sa / 255e0 * (1 - ta / 255e0) AS a FROM k) SELECT id, {", ".join(_SRGB.format(c) for c in color.CHANNELS)}, CAST(floor(a * 255 + 0.5e0) AS INTEGER) AS a FROM o""", views="")
def composite_pixels(ds: Dataset) -> DataFrame:
    pixel = lambda factors: F.struct(*[(F.col("id") * n % 256).alias(c) for c, n in factors.items()])
    return ds.nodes.select("id", color.composite(F.array(pixel(FIRST), pixel(SECOND))).alias("p")).select("id", "p.*")


@query("SELECT id, CAST(floor((lon_e7 / 1e7 + 180) / 360 * 1073741824) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat_e7 / 1e7)) + 1 / cos(radians(lat_e7 / 1e7))) / pi()) / 2 * 1073741824) AS BIGINT) AS y, CAST(lon_e7 AS BIGINT) AS lon, CAST(lat_e7 AS BIGINT) AS lat FROM nodes")
def world_positions(ds: Dataset) -> DataFrame:
    """Pixels of the square Mercator world at zoom 22, and positions back again."""
    at = ds.nodes.select("id", *[c.alias(n) for n, c in zip("xy", geo.world(F.col("lon_e7") / 1e7, F.col("lat_e7") / 1e7))])
    lon, lat = geo.from_world(F.col("x"), F.col("y"))
    return at.select("id", F.floor(F.col("x") * 2**30).alias("x"), F.floor(F.col("y") * 2**30).alias("y"), F.round(lon * 1e7).cast("long").alias("lon"), F.round(lat * 1e7).cast("long").alias("lat"))
