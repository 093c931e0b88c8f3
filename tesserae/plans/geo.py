"""Scalar functions over points, tiles, chunks, cells and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import geo
from tesserae.registry import query
from tesserae.sources import tables
from tesserae.sources.tables import cte

HERE = (53.63, 9.99)


def sql_row(lat: str, z: str) -> str:
    return f"greatest(0, least(CAST(floor((1 - asinh(tan(radians({lat}))) / pi()) / 2 * pow(2, {z})) AS BIGINT), CAST(pow(2, {z}) - 1 AS BIGINT)))"


def sql_col(lon: str, z: str) -> str:
    return f"greatest(0, least(CAST(floor(({lon} + 180) / 360 * pow(2, {z})) AS BIGINT), CAST(pow(2, {z}) - 1 AS BIGINT)))"


def sql_lat(row: str, z: str, within: float = 0.0) -> str:
    return f"degrees(atan(sinh(pi() * (1 - 2 * ({row} + {within}) / pow(2, {z})))))"


def sql_lon(col: str, z: str, within: float = 0.0) -> str:
    return f"(({col} + {within}) / pow(2, {z}) * 360 - 180)"


def sql_name(lat: str, lon: str) -> str:
    return f"printf('%+03d%+04d', CAST({lat} AS INT), CAST({lon} AS INT))"


def six(c) -> F.Column:
    return F.round(c, 6)


@query(cte("positions") + f" SELECT seq, CAST({sql_row('lat', '16')} AS BIGINT) AS \"row\", CAST({sql_col('lon', '16')} AS BIGINT) AS col FROM positions")
def geo_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.positions(spark, sf_dir).withColumn("t", geo.try_tile("lat", "lon", F.lit(16))).select("seq", "t.row", "t.col")


@query(
    cte("positions")
    + f""", c AS (SELECT seq, {sql_row("lat", "16")} AS r, {sql_col("lon", "16")} AS c, {sql_row("lat", "20")} AS cr, {sql_col("lon", "20")} AS cc FROM positions)
SELECT seq, CAST(r AS BIGINT) AS "row", CAST(c AS BIGINT) AS col, CAST(cr % 16 AS BIGINT) AS chunk_row, CAST(cc % 16 AS BIGINT) AS chunk_col FROM c"""
)
def geo_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.positions(spark, sf_dir).withColumn("t", geo.try_chunk("lat", "lon", F.lit(16))).select("seq", "t.*")


@query(cte("positions") + """ SELECT seq, abs(lat * 1.1::DOUBLE) <= 85.05112878 AND abs(lon * 1.01::DOUBLE) <= 180 AND seq % 23 <= 18 AS has_tile FROM positions""")
def geo_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which points have a tile: positions drawn out beyond the limits of the projection, at zooms beyond the last."""
    p = tables.positions(spark, sf_dir).select("seq", (F.col("lat") * 1.1).alias("lat"), (F.col("lon") * 1.01).alias("lon"), (F.col("seq") % 23).cast("int").alias("zoom"))
    return p.select("seq", geo.try_tile("lat", "lon", "zoom")["row"].isNotNull().alias("has_tile"))


@query(
    cte("tile_requests")
    + f""" SELECT seq, round({sql_lat('"row"', "zoom")}, 6) AS nw_lat, round({sql_lon("col", "zoom")}, 6) AS nw_lon, round({sql_lat('"row"', "zoom", 0.5)}, 6) AS mid_lat,
round({sql_lon("col", "zoom", 0.5)}, 6) AS mid_lon FROM tile_requests"""
)
def geo_corner_and_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.tile_requests(spark, sf_dir)
    at = [("nw", 0.0), ("mid", 0.5)]
    return r.select("seq", *[six(geo.lat_of("row", "zoom", w)).alias(f"{n}_lat") for n, w in at], *[six(geo.lon_of("col", "zoom", w)).alias(f"{n}_lon") for n, w in at])


@query(
    cte("positions")
    + f""", c AS (SELECT seq, CAST(floor(lat) AS INT) AS a, CAST(floor(lon) AS INT) AS o FROM positions)
SELECT seq, a AS dsf_lat, o AS dsf_lon, {sql_name("a", "o")} AS name, CASE WHEN a >= 0 THEN 'N' ELSE 'S' END || abs(a) || CASE WHEN o >= 0 THEN 'E' ELSE 'W' END || abs(o) AS label,
{sql_name("floor(a / 10.0) * 10", "floor(o / 10.0) * 10")} AS block, a + 0.5::DOUBLE AS mid_lat, o + 0.5::DOUBLE AS mid_lon FROM c"""
)
def geo_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.positions(spark, sf_dir).select("seq", geo.degree("lat").alias("dsf_lat"), geo.degree("lon").alias("dsf_lon"))
    a, o = F.col("dsf_lat"), F.col("dsf_lon")
    return p.withColumns({"name": geo.cell_name(a, o), "label": geo.cell_label(a, o), "block": geo.grid_name(a, o), "mid_lat": a + F.lit(0.5), "mid_lon": o + F.lit(0.5)})


@query(
    cte("positions")
    + """, c AS (SELECT DISTINCT CAST(floor(lat) AS INT) AS a, CAST(floor(lon) AS INT) AS o FROM positions),
d(name, da, dl) AS (VALUES ('N', 1, 0), ('NE', 1, 1), ('E', 0, 1), ('SE', -1, 1), ('S', -1, 0), ('SW', -1, -1), ('W', 0, -1), ('NW', 1, -1))
SELECT a AS dsf_lat, o AS dsf_lon, name AS side, CAST(least(greatest(a + da, -90), 89) AS INT) AS n_lat, CAST(((o + dl + 180) % 360 + 360) % 360 - 180 AS INT) AS n_lon FROM c, d"""
)
def geo_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight neighbours of every cell in use; the cardinal four are those of one letter."""
    p = tables.positions(spark, sf_dir).select(geo.degree("lat").alias("dsf_lat"), geo.degree("lon").alias("dsf_lon")).distinct()
    steps = {"N": (1, 0), "NE": (1, 1), "E": (0, 1), "SE": (-1, 1), "S": (-1, 0), "SW": (-1, -1), "W": (0, -1), "NW": (1, -1)}
    each = []
    for side, (a, o) in steps.items():
        lat, lon = geo.shifted("dsf_lat", "dsf_lon", a, o)
        each.append(F.struct(F.lit(side).alias("side"), lat.cast("int").alias("n_lat"), lon.cast("int").alias("n_lon")))
    return p.select("dsf_lat", "dsf_lon", F.explode(F.array(*each)).alias("n")).select("dsf_lat", "dsf_lon", "n.*")


@query(
    cte("cache_entries")
    + """ SELECT entry_id, list_reduce(list_transform(range(zoom, 0, -1), lambda i: CAST((("row" >> (i - 1)) & 1) * 2 + ((col >> (i - 1)) & 1) AS VARCHAR)), lambda a, b: a || b) AS quadkey FROM cache_entries"""
)
def geo_quadkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cache_entries(spark, sf_dir).select("entry_id", geo.quadkey("row", "col", "zoom").alias("quadkey"))


@query(cte("cache_entries") + """ SELECT entry_id, "row", col, zoom FROM cache_entries""")
def geo_quadkey_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tables.cache_entries(spark, sf_dir).withColumn("t", geo.try_from_quadkey(geo.quadkey("row", "col", "zoom")))
    return q.select("entry_id", "t.row", "t.col", "t.zoom")


@query(
    cte("tile_requests")
    + """, t AS (SELECT DISTINCT "row", col, zoom FROM tile_requests), k AS (SELECT t.*, CAST(range AS BIGINT) AS i FROM t, range(256))
SELECT "row", col, zoom, "row" * 16 + i // 16 AS chunk_row, col * 16 + i % 16 AS chunk_col, zoom + 4 AS chunk_zoom, "row" AS back_row, col AS back_col, zoom AS back_zoom FROM k"""
)
def geo_tile_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile in use with its 256 chunks, row by row, and the tile of each chunk again."""
    t = tables.tile_requests(spark, sf_dir).select("row", "col", "zoom").distinct()
    k = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(geo.CHUNKS**2 - 1))))
    k = k.select("row", "col", "zoom", (F.col("row") * geo.CHUNKS + F.floor(F.col("i") / geo.CHUNKS)).alias("chunk_row"), (F.col("col") * geo.CHUNKS + F.col("i") % geo.CHUNKS).alias("chunk_col"), (F.col("zoom") + geo.CHUNK_LEVELS).alias("chunk_zoom"))
    return k.withColumns({"back_row": geo.tile_of_chunk("chunk_row"), "back_col": geo.tile_of_chunk("chunk_col"), "back_zoom": geo.zoom_of_chunk("chunk_zoom")})


@query(
    cte("tile_refs")
    + """ SELECT ref_id, d AS levels, CASE WHEN d > 0 AND d % 2 = 0 THEN "row" >> d ELSE -1 END AS parent_row, CASE WHEN d > 0 AND d % 2 = 0 THEN col >> d ELSE -1 END AS parent_col FROM tile_refs, (VALUES (0), (1), (2), (4)) v(d)"""
)
def geo_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.tile_refs(spark, sf_dir).withColumn("levels", F.explode(F.array(*map(F.lit, (0, 1, 2, 4)))))
    return t.select("ref_id", "levels", *[F.coalesce(geo.parent(c, "levels"), F.lit(-1)).alias(f"parent_{c}") for c in ("row", "col")])


_B = "degrees(atan2(sin(radians(9.99 - lon)) * cos(radians(53.63)), cos(radians(lat)) * sin(radians(53.63)) - sin(radians(lat)) * cos(radians(53.63)) * cos(radians(9.99 - lon))))"


@query(
    cte("positions")
    + f""", b AS (SELECT *, CAST(CASE WHEN {_B} < 0 THEN {_B} + 360 ELSE {_B} END AS FLOAT) AS b FROM positions), t AS (SELECT *, CAST(b AS DOUBLE) - heading AS d FROM b)
SELECT seq, round(CAST(b AS DOUBLE), 3) AS bearing, round(CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END, 3) AS turn,
round(((degrees(atan2(9.99 - lon, 53.63 - lat)) + 360) % 360), 6) AS flat FROM t"""
)
def geo_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.positions(spark, sf_dir).withColumn("b", geo.bearing("lat", "lon", *HERE))
    turn = geo.turn(F.col("b").cast("double"), "heading")
    return p.select("seq", F.round(F.col("b").cast("double"), 3).alias("bearing"), F.round(turn, 3).alias("turn"), six(geo.flat_bearing("lat", "lon", *HERE)).alias("flat"))


@query(
    cte("positions")
    + """ SELECT seq, round(CAST(CAST(2 * 3440.065 * asin(sqrt(pow(sin(radians(53.63 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(53.63)) * pow(sin(radians(9.99 - lon) / 2), 2))) AS FLOAT) AS DOUBLE), 2) AS nm FROM positions"""
)
def geo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.positions(spark, sf_dir).select("seq", F.round(geo.distance_nm("lat", "lon", *HERE).cast("double"), 2).alias("nm"))


_TO = "asin(sin(radians(lat)) * cos(50 / 3440.065) + cos(radians(lat)) * sin(50 / 3440.065) * cos(radians(heading)))"


@query(
    cte("positions")
    + f""", q AS (SELECT seq, degrees({_TO}) AS a, degrees(radians(lon) + atan2(sin(radians(heading)) * sin(50 / 3440.065) * cos(radians(lat)), cos(50 / 3440.065) - sin(radians(lat)) * sin({_TO}))) AS o FROM positions)
SELECT seq, round(least(greatest(a, -85.05112878), 85.05112878), 6) AS lat, round(CASE WHEN o > 180 THEN o - 360 WHEN o < -180 THEN o + 360 ELSE o END, 6) AS lon FROM q"""
)
def geo_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.positions(spark, sf_dir)
    lat, lon = geo.projected("lat", "lon", "heading", F.lit(50.0))
    return p.select("seq", six(lat).alias("lat"), six(lon).alias("lon"))


@query(
    cte("positions")
    + """, q AS (SELECT seq, lat + ground_speed / 3600 * 60 / 60 * cos(radians(heading)) AS a, lon + ground_speed / 3600 * 60 / 60 * sin(radians(heading)) / cos(radians(lat)) AS o FROM positions)
SELECT seq, round(least(greatest(a, -85.05112878), 85.05112878), 6) AS lat, round(CASE WHEN o > 180 THEN o - 360 WHEN o < -180 THEN o + 360 ELSE o END, 6) AS lon FROM q"""
)
def geo_extrapolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.positions(spark, sf_dir)
    lat, lon = geo.ahead("lat", "lon", "heading", "ground_speed", F.lit(60.0))
    return p.select("seq", six(lat).alias("lat"), six(lon).alias("lon"))


@query(
    cte("positions")
    + """, l AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS o, lag(heading) OVER w AS h, lag(ground_speed) OVER w AS v FROM positions WINDOW w AS (PARTITION BY source_id ORDER BY ts, seq))
SELECT seq, a IS NOT NULL AND (least(abs(heading - h), 360 - abs(heading - h)) > 15 OR (v > 1 AND abs(ground_speed - v) > v * 0.2) OR abs(lat - a) > 0.01 OR abs(lon - o) > 0.01) AS changed FROM l"""
)
def geo_significant_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.positions(spark, sf_dir)
    w = Window.partitionBy("source_id").orderBy("ts", "seq")
    now = ["lat", "lon", "heading", "ground_speed"]
    for c in now:
        p = p.withColumn(f"{c}0", F.lag(c).over(w))
    return p.select("seq", (F.col("lat0").isNotNull() & geo.changed(*now, *[f"{c}0" for c in now])).alias("changed"))


@query(cte("positions") + " SELECT seq, round(3.5 + least(greatest((ground_speed - 40) / 410, 0), 1) * 3.5, 6) AS extent FROM positions")
def geo_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.positions(spark, sf_dir).select("seq", six(geo.extent("ground_speed")).alias("extent"))


@query(
    cte("positions")
    + """, q AS (SELECT seq, CAST(floor((heading + 22.5) / 45) AS INT) % 8 AS i FROM positions)
SELECT seq, ['N','NE','E','SE','S','SW','W','NW'][i + 1] AS quadrant, i % 2 = 1 AS diagonal, i IN (7, 0, 1) AS northbound, i IN (1, 2, 3) AS eastbound, i * 45.0::DOUBLE AS middle,
['N','NE','E','SE','S','SW','W','NW'][(i + 4) % 8 + 1] AS opposite, ['N','NE','E','SE','S','SW','W','NW'][(i + 7) % 8 + 1] AS before, ['N','NE','E','SE','S','SW','W','NW'][(i + 1) % 8 + 1] AS after FROM q"""
)
def geo_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    name = lambda k: F.element_at(F.array(*map(F.lit, geo.DIRECTIONS)), (k % 8 + 1).cast("int"))
    p = tables.positions(spark, sf_dir).select("seq", geo.direction_index("heading").alias("i"))
    return p.select("seq", name(i).alias("quadrant"), (i % 2 == 1).alias("diagonal"), i.isin(7, 0, 1).alias("northbound"), i.isin(1, 2, 3).alias("eastbound"), (i * F.lit(45.0)).alias("middle"), name(i + 4).alias("opposite"), name(i + 7).alias("before"), name(i + 1).alias("after"))


@query(
    cte("positions")
    + """, v AS (SELECT *, ground_speed * 1.852 / (111.0 * 3600.0) AS v FROM positions), t AS (SELECT *, CASE WHEN v >= 0.0001 THEN (1.6 - (lat - floor(lat))) / v END AS t FROM v)
SELECT seq, round(t, 4) AS seconds, t IS NULL OR 900.0 <= t * 0.7 AS fits FROM t"""
)
def geo_time_to_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.positions(spark, sf_dir)
    return p.select("seq", F.round(geo.seconds_to_trigger("lat", "ground_speed"), 4).alias("seconds"), geo.fits_in_time("lat", "ground_speed", F.lit(900_000.0), 0.7).alias("fits"))


@query(
    cte("positions")
    + """ SELECT seq, CAST(3 AS BIGINT) AS window_rows, CAST(ceil(3.0::DOUBLE / greatest(abs(cos(radians(lat))), 0.1)) AS BIGINT) AS lon_tiles, round(2 * pi() * 3440.065 / pow(2, 14) * cos(radians(abs(lat))), 6) AS tile_nm FROM positions"""
)
def geo_lon_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assumed scenery window (three rows and so many columns) and the size of a tile."""
    return tables.positions(spark, sf_dir).select("seq", F.lit(3).cast("long").alias("window_rows"), geo.lon_tiles("lat").alias("lon_tiles"), six(geo.tile_size_nm("lat", F.lit(14))).alias("tile_nm"))


@query(
    cte("positions")
    + """, c AS (SELECT DISTINCT CAST(floor(lat) AS INT) AS a, CAST(floor(lon) AS INT) AS o FROM positions)
SELECT a AS dsf_lat, o AS dsf_lon, array_to_string(list_filter([CASE WHEN a BETWEEN -90 AND -61 THEN 'ant' END, CASE WHEN a BETWEEN -35 AND 37 AND o BETWEEN -18 AND 52 THEN 'afr' END,
CASE WHEN a BETWEEN 0 AND 80 AND (o BETWEEN 52 AND 180 OR o BETWEEN -180 AND -170) THEN 'asia' END, CASE WHEN a BETWEEN -50 AND 0 AND o BETWEEN 110 AND 180 THEN 'aus' END,
CASE WHEN a BETWEEN 35 AND 72 AND o BETWEEN -25 AND 52 THEN 'eur' END, CASE WHEN a BETWEEN 15 AND 85 AND o BETWEEN -170 AND -50 THEN 'na' END,
CASE WHEN a BETWEEN -60 AND 15 AND o BETWEEN -90 AND -30 THEN 'sa' END], lambda x: x IS NOT NULL), ',') AS regions FROM c"""
)
def geo_suggested_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.positions(spark, sf_dir).select(geo.degree("lat").alias("dsf_lat"), geo.degree("lon").alias("dsf_lon")).distinct()
    return c.withColumn("regions", F.array_join(geo.regions_of("dsf_lat", "dsf_lon"), ","))


@query(
    cte("positions")
    + """ SELECT seq, lat BETWEEN 20 AND 30 AND lat < 30 AND lon >= -40 AND lon < 60 AS in_box, CAST(floor(lat) AS INT) = 25 AND CAST(floor(lon) AS INT) = 10 AS in_cell FROM positions"""
)
def geo_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-open box and a one-degree cell as predicates."""
    box = (F.col("lat") >= 20) & (F.col("lat") < 30) & (F.col("lon") >= -40) & (F.col("lon") < 60)
    return tables.positions(spark, sf_dir).select("seq", box.alias("in_box"), ((geo.degree("lat") == 25) & (geo.degree("lon") == 10)).alias("in_cell"))
