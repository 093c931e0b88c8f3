"""Generators over every position or tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import generate, geo
from tesserae.plans.geo import sql_col, sql_row
from tesserae.registry import query
from tesserae.sources import tables
from tesserae.sources.tables import cte

_F = "abs(cos(radians(heading)))"
SQL_BOX = """b AS (SELECT *, 3.5 + least(greatest((ground_speed - 40) / 410, 0), 1) * 3.5 AS e, cos(radians(heading)) AS c, sin(radians(heading)) AS s FROM positions),
x AS (SELECT *, 0.5 + 0.30000000000000004::DOUBLE * abs(c) AS fc, 0.5 + 0.30000000000000004::DOUBLE * abs(s) AS fs FROM b),
box AS (SELECT *, lat - e * CASE WHEN c >= 0 THEN 1 - fc ELSE fc END AS lat0, lat + e * CASE WHEN c >= 0 THEN fc ELSE 1 - fc END AS lat1,
  lon - e * CASE WHEN s >= 0 THEN 1 - fs ELSE fs END AS lon0, lon + e * CASE WHEN s >= 0 THEN fs ELSE 1 - fs END AS lon1 FROM x)"""


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple]:
    p = tables.positions(spark, sf_dir)
    return p, generate.box("lat", "lon", "heading", geo.extent("ground_speed"))


@query(
    cte("positions")
    + """, g AS (SELECT seq, CAST(floor(lat) AS INT) + r.range AS a, CAST(floor(lon) AS INT) + c.range AS o FROM positions, range(-2, 2) r, range(-1, 2) c)
SELECT seq, CAST(least(greatest(a, -90), 89) AS INT) AS dsf_lat, CAST(((o + 180) % 360 + 360) % 360 - 180 AS INT) AS dsf_lon FROM g"""
)
def gen_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.positions(spark, sf_dir).select("seq", F.inline(generate.grid("lat", "lon", 4, 3)))


@query(
    cte("positions")
    + """ SELECT source_id, CAST(min(floor(lat)) AS INT) AS min_lat, CAST(max(floor(lat)) AS INT) + 1 AS max_lat, CAST(min(floor(lon)) AS INT) AS min_lon, CAST(max(floor(lon)) AS INT) + 1 AS max_lon FROM positions GROUP BY source_id"""
)
def gen_cell_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open bounds of the cells of each source; 0 where there are none."""
    p = tables.positions(spark, sf_dir).withColumns({"a": geo.degree("lat"), "o": geo.degree("lon")})
    edge = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return p.groupBy("source_id").agg(edge(F.min("a"), "min_lat"), edge(F.max("a") + 1, "max_lat"), edge(F.min("o"), "min_lon"), edge(F.max("o") + 1, "max_lon"))


@query(cte("positions") + f""", {SQL_BOX} SELECT seq, round(lat0, 6) AS min_lat, round(lat1, 6) AS max_lat, round(lon0, 6) AS min_lon, round(lon1, 6) AS max_lon FROM box""")
def gen_box_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, b = boxes(spark, sf_dir)
    return p.select("seq", *[F.round(c, 6).alias(n) for c, n in zip(b, ("min_lat", "max_lat", "min_lon", "max_lon"))])


@query(
    cte("positions")
    + f""", {SQL_BOX}, a AS (SELECT seq, lon0, lon1, unnest(range(CAST(floor(lat0) AS BIGINT), CAST(floor(lat1 - 1e-9) AS BIGINT) + 1)) AS a FROM box),
c AS (SELECT a, unnest(range(CAST(floor(lon0) AS BIGINT), CAST(floor(lon1 - 1e-9) AS BIGINT) + 1)) AS o FROM a)
SELECT CAST(a AS INT) AS dsf_lat, CAST(o AS INT) AS dsf_lon, count(*) AS positions FROM c GROUP BY a, o"""
)
def gen_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many positions have each cell in their box."""
    p, b = boxes(spark, sf_dir)
    return generate.boxed(p, b).groupBy("dsf_lat", "dsf_lon").agg(F.count("*").alias("positions"))


@query(
    cte("positions")
    + f""", g AS (SELECT DISTINCT CAST(floor(lat) AS INT) AS a, CAST(floor(lon) AS INT) AS o FROM positions),
s AS (SELECT a, o, a + r.range * 0.25::DOUBLE + 0.125::DOUBLE AS lat, o + c.range * 0.25::DOUBLE + 0.125::DOUBLE AS lon FROM g, range(4) r, range(4) c)
SELECT DISTINCT a AS dsf_lat, o AS dsf_lon, CAST({sql_row("lat", "14")} AS BIGINT) AS "row", CAST({sql_col("lon", "14")} AS BIGINT) AS col FROM s WHERE lat BETWEEN -85.05112878 AND 85.05112878"""
)
def gen_sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.positions(spark, sf_dir).select(geo.degree("lat").alias("dsf_lat"), geo.degree("lon").alias("dsf_lon")).distinct()
    return c.select("dsf_lat", "dsf_lon", F.inline(generate.sample_grid("dsf_lat", "dsf_lon")))


@query(
    cte("positions")
    + f""", e AS (SELECT *, CAST(CAST(2 * pi() * 3440.065 / pow(2, 10) * cos(radians(abs(lat))) AS FLOAT) * CAST(0.5 AS FLOAT) AS FLOAT) AS every FROM positions),
i AS (SELECT *, unnest(range(CAST(floor(CAST(5 AS FLOAT) / every) AS BIGINT), CAST(ceil(CAST(60 AS FLOAT) / every) AS BIGINT) + 1)) AS i FROM e),
d AS (SELECT *, CAST(CAST(i AS FLOAT) * every AS FLOAT) AS nm FROM i), k AS (SELECT *, CAST(nm AS DOUBLE) / 3440.065 AS d, radians(lat) AS a, radians(heading) AS h FROM d WHERE nm <= 60 AND nm >= 5),
t AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(h)) AS b FROM k),
o AS (SELECT seq, i, least(greatest(degrees(b), -85.05112878), 85.05112878) AS lat, degrees(radians(lon) + atan2(sin(h) * sin(d) * cos(a), cos(d) - sin(a) * sin(b))) AS lon FROM t),
w AS (SELECT seq, i, lat, CASE WHEN lon > 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END AS lon FROM o)
SELECT seq, CAST({sql_row("lat", "10")} AS BIGINT) AS "row", CAST({sql_col("lon", "10")} AS BIGINT) AS col, CAST(min(i) AS INT) AS step FROM w GROUP BY 1, 2, 3"""
)
def gen_ray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles between 5 and 60 nautical miles ahead, in order of their first sample."""
    p = tables.positions(spark, sf_dir).select("seq", "lat", "lon", "heading")
    return generate.ray(p, "lat", "lon", "heading", 60.0, 10, 5.0).select("seq", "row", "col", "step")


_OFF_LAT = "least(greatest({a} + {d} * cos({h}), -85.05112878), 85.05112878)"
_OFF_LON = "{o} + {d} * sin({h}) / greatest(cos(radians({a})), 0.01)"
_WRAP = "CASE WHEN {o} > 180 THEN {o} - 360 WHEN {o} < -180 THEN {o} + 360 ELSE {o} END"


@query(
    cte("positions")
    + f""", b AS (SELECT *, {sql_row("lat", "8")} AS r, {sql_col("lon", "8")} AS c, 360.0::DOUBLE / 256 * 60 * greatest(abs(cos(radians(lat))), 0.1) AS nm, radians(heading) AS h FROM positions),
k AS (SELECT b.*, p, d, CAST(ceil(d * tan(radians(30)) / nm) AS BIGINT) AS spread FROM b, (VALUES (1, 5.0::DOUBLE), (2, 10), (3, 20), (4, 35), (5, 50)) v(p, d)),
m0 AS (SELECT *, {_OFF_LAT.format(a="lat", d="(d / 60)", h="h")} AS ma, {_OFF_LON.format(a="lat", o="lon", d="(d / 60)", h="h")} AS mo0 FROM k),
m AS (SELECT *, {_WRAP.format(o="mo0")} AS mo, unnest(range(-spread, spread + 1)) AS k FROM m0),
s0 AS (SELECT *, CASE WHEN k = 0 THEN ma ELSE {_OFF_LAT.format(a="ma", d="(abs(k) * nm / 60)", h="(h + sign(k) * pi() / 2)")} END AS sa, CASE WHEN k = 0 THEN mo ELSE {_OFF_LON.format(a="ma", o="mo", d="(abs(k) * nm / 60)", h="(h + sign(k) * pi() / 2)")} END AS so0 FROM m),
s AS (SELECT *, CASE WHEN k = 0 THEN so0 ELSE {_WRAP.format(o="so0")} END AS so FROM s0),
r AS (SELECT *, least(CAST(ceil(60 / nm) AS BIGINT), 200) AS rad FROM b), dr AS (SELECT *, unnest(range(-rad, rad + 1)) AS dr FROM r), dc AS (SELECT *, unnest(range(-rad, rad + 1)) AS dc FROM dr),
disc AS (SELECT *, sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) AS far FROM dc),
t AS (SELECT seq, r AS "row", c AS col, 0 AS priority FROM b UNION ALL SELECT seq, {sql_row("sa", "8")}, {sql_col("so", "8")}, p FROM s
  UNION ALL SELECT seq, r + dr, c + dc, 6 + CAST(floor(ceil(far) / 10) AS INT) FROM disc WHERE far > 0 AND far <= rad AND r + dr BETWEEN 0 AND 255 AND c + dc BETWEEN 0 AND 255),
u AS (SELECT seq, "row", col, min(priority) AS priority FROM t GROUP BY 1, 2, 3)
SELECT seq, CAST(priority AS INT) AS priority, count(*) AS tiles, CAST(sum("row") AS BIGINT) AS row_sum, CAST(sum(col) AS BIGINT) AS col_sum FROM u GROUP BY seq, priority"""
)
def gen_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of cone and disc predictions by priority: their number and the sums of their places."""
    t = generate.predicted(tables.positions(spark, sf_dir), 8)
    return t.groupBy("seq", "priority").agg(F.count("*").alias("tiles"), F.sum("row").alias("row_sum"), F.sum("col").alias("col_sum"))


@query(
    cte("cache_entries")
    + """ SELECT entry_id, CAST(count(*) AS BIGINT) AS tiles, count(DISTINCT (least(greatest("row" + r.range, 0), 4095), least(greatest(col + c.range, 0), 4095))) AS distinct_tiles,
CAST(sum(least(greatest("row" + r.range, 0), 4095)) AS BIGINT) AS row_sum FROM cache_entries, range(-2, 3) r, range(-2, 3) c GROUP BY entry_id"""
)
def gen_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of radius 2: how many tiles, how many distinct ones."""
    e = tables.cache_entries(spark, sf_dir).withColumn("t", generate.square("row", "col", "zoom", 2))
    return e.select("entry_id", F.size("t").cast("long").alias("tiles"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tiles"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["row"]).alias("row_sum"))
