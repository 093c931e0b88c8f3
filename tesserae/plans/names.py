"""Names, keys, sizes and versions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.plans.geo import sql_lat, sql_lon, sql_name
from tesserae.registry import query
from tesserae.sources import tables
from tesserae.sources.tables import cte

_NAMES = """, f AS (SELECT seq, CASE seq % 6 WHEN 0 THEN "row" || '_' || col || '_BI' || zoom || '.dds' WHEN 1 THEN 'x/' || "row" || '_' || col || '_go2' || zoom || '.dds' WHEN 2 THEN "row" || '_' || col || '_ZL' || zoom || '.DDS'
WHEN 3 THEN '99999999999_' || col || '_BI18.dds' WHEN 4 THEN "row" || '_' || col || '_BI' || zoom || '_sea.dds' ELSE "row" || '_' || col || '.dds' END AS name FROM tile_requests)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c, z = F.col("row").cast("string"), F.col("col").cast("string"), F.col("zoom").cast("string")
    k = F.col("seq") % 6
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    name = F.when(k == 0, j(r, "_", c, "_BI", z, ".dds")).when(k == 1, j("x/", r, "_", c, "_go2", z, ".dds")).when(k == 2, j(r, "_", c, "_ZL", z, ".DDS")).when(k == 3, j("99999999999_", c, "_BI18.dds")).when(k == 4, j(r, "_", c, "_BI", z, "_sea.dds")).otherwise(j(r, "_", c, ".dds"))
    return tables.tile_requests(spark, sf_dir).select("seq", name.alias("name"), "row", "col", "zoom")


@query(cte("tile_requests") + _NAMES + r""", g AS (SELECT seq, regexp_extract(name, '([0-9]+)_([0-9]+)_([A-Za-z]+[0-9]?)([0-9]{2})\.dds$', ['r', 'c', 'm', 'z']) AS g FROM f)
SELECT seq, CASE WHEN g.r <> '' AND TRY_CAST(g.r AS HUGEINT) <= 4294967295 THEN TRY_CAST(g.r AS BIGINT) ELSE -1 END AS "row", CASE WHEN g.r <> '' AND TRY_CAST(g.r AS HUGEINT) <= 4294967295 THEN TRY_CAST(g.c AS BIGINT) ELSE -1 END AS col,
CASE WHEN g.r <> '' AND TRY_CAST(g.r AS HUGEINT) <= 4294967295 THEN upper(g.m) ELSE '' END AS map_type, CASE WHEN g.r <> '' AND TRY_CAST(g.r AS HUGEINT) <= 4294967295 THEN TRY_CAST(g.z AS INT) ELSE -1 END AS zoom FROM g""")
def name_dds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texture names by pattern; -1 and empty where a name is none."""
    d = _names(spark, sf_dir).withColumn("t", text.dds_name(F.col("name")))
    return d.select("seq", *[F.coalesce(f"t.{c}", F.lit(-1)).alias(c) for c in ("row", "col")], F.coalesce("t.map_type", F.lit("")).alias("map_type"), F.coalesce("t.zoom", F.lit(-1)).alias("zoom"))


@query(cte("tile_requests") + _NAMES + r""", p AS (SELECT seq, CASE WHEN name LIKE '%.dds' THEN split(substr(name, 1, length(name) - 4), '_') ELSE [] END AS p FROM f),
k AS (SELECT seq, p, len(p) >= 3 AND regexp_full_match(p[1], '[0-9]+') AND regexp_full_match(p[2], '[0-9]+') AND length(p[1]) <= 10 AND regexp_full_match(right(p[3], 2), '[0-9]{2}') AS ok FROM p)
SELECT seq, CASE WHEN ok THEN CAST(p[1] AS BIGINT) ELSE -1 END AS "row", CASE WHEN ok THEN CAST(right(p[3], 2) AS INT) ELSE -1 END AS zoom, CASE WHEN ok THEN upper(left(p[3], length(p[3]) - 2)) ELSE '' END AS provider FROM k""")
def name_dds_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by splitting, as scenery and deduplication read them."""
    d = _names(spark, sf_dir).withColumn("t", text.dds_parts(F.col("name")))
    return d.select("seq", F.coalesce("t.row", F.lit(-1)).alias("row"), F.coalesce("t.zoom", F.lit(-1)).alias("zoom"), F.coalesce("t.provider", F.lit("")).alias("provider"))


@query(cte("tile_requests") + f""", t AS (SELECT seq, "row" AS r, col AS c, zoom FROM tile_requests)
SELECT seq, r >> 4 AS "row", c >> 4 AS col, zoom - 4 AS zoom, CAST(floor({sql_lat("r", "zoom", 0.5)}) AS INT) AS dsf_lat, CAST(floor({sql_lon("c", "zoom", 0.5)}) AS INT) AS dsf_lon FROM t""")
def name_ter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain names (with and without _sea) to their tile and cell."""
    r = tables.tile_requests(spark, sf_dir)
    sea = F.when(F.col("seq") % 3 == 0, "_sea").when(F.col("seq") % 3 == 1, "_sea_overlay").otherwise("")
    base = F.concat_ws("_", F.col("row").cast("string"), F.col("col").cast("string"), F.concat(F.lit("BI"), F.col("zoom").cast("string")))
    d = r.select("seq", text.ter_tile(F.concat(base, sea, F.lit(".ter"))).alias("t"), text.scenery_cell(F.concat(base, F.when(F.col("seq") % 3 == 0, "_sea").otherwise(""), F.lit(".ter"))).alias("k"))
    return d.select("seq", "t.*", "k.*")


@query(cte("positions") + f""", c AS (SELECT seq, CAST(floor(lat) AS INT) AS a, CAST(floor(lon) AS INT) AS o FROM positions) SELECT seq, {sql_name("a", "o")} || '.dsf' AS name, a AS dsf_lat, o AS dsf_lon, a AS tile_lat, o AS tile_lon FROM c""")
def name_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell file names written and read again, also as tile folders."""
    from tesserae.functions import geo

    p = tables.positions(spark, sf_dir).select("seq", geo.cell_name(geo.degree("lat"), geo.degree("lon")).alias("n"))
    d = p.select("seq", F.concat("n", F.lit(".dsf")).alias("name"), text.cell_of_name(F.concat("n", F.lit(".dsf"))).alias("c"), text.tile_id(F.concat(F.lit("zOrtho4XP_"), "n")).alias("t"))
    return d.select("seq", "name", "c.*", F.col("t.dsf_lat").alias("tile_lat"), F.col("t.dsf_lon").alias("tile_lon"))


@query(cte("cache_entries") + f""", k AS (SELECT entry_id, 'tile:' || zoom || ':' || "row" || ':' || col AS key, {sql_name("floor(" + sql_lat('"row"', "zoom", 0.5) + ")", "floor(" + sql_lon("col", "zoom", 0.5) + ")")} AS region FROM cache_entries)
SELECT entry_id, key, region, region || '/' || replace(key, ':', '_') || '.cache' AS path, key AS back FROM k""")
def name_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys, the folder of their cell, the path there, and the key read back from the file's name."""
    e = tables.cache_entries(spark, sf_dir).select("entry_id", text.cache_key("zoom", "row", "col").alias("key"))
    return e.select("entry_id", "key", text.key_region(F.col("key")).alias("region"), text.key_path(F.col("key")).alias("path"), text.file_key(text.key_file(F.col("key"))).alias("back"))


@query(cte("cache_entries") + """, n AS (SELECT entry_id, size_bytes * (1 + entry_id % 5 * 7000) AS n FROM cache_entries)
SELECT entry_id, CASE WHEN n >= 1000000000 THEN printf('%.1f GB', floor(n / 100000000.0 + 0.5) / 10) WHEN n >= 1000000 THEN printf('%.1f MB', floor(n / 100000.0 + 0.5) / 10) WHEN n >= 1000 THEN printf('%.1f KB', floor(n / 100.0 + 0.5) / 10) ELSE n || ' B' END AS decimal_size,
CASE WHEN n % 90000 // 3600 > 0 THEN printf('%02d:%02d:%02d', n % 90000 // 3600, n % 3600 // 60, n % 60) ELSE printf('%02d:%02d', n % 3600 // 60, n % 60) END AS clock,
(n % 900) * CASE entry_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS parsed FROM n""")
def name_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and times written out, and sizes read."""
    e = tables.cache_entries(spark, sf_dir).select("entry_id", (F.col("size_bytes") * (1 + F.col("entry_id") % 5 * 7000)).alias("n"))
    unit = F.element_at(F.array(F.lit(""), F.lit(" KB"), F.lit("m"), F.lit("G")), (F.col("entry_id") % 4 + 1).cast("int"))
    n = F.col("n")
    return e.select("entry_id", text.decimal_bytes(n).alias("decimal_size"), text.clock(n % 90000).alias("clock"), text.parse_size(F.concat((n % 900).cast("string"), unit)).alias("parsed"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'zz' ELSE 'yz' END || 'region' || (s_suppkey % 40) || '_' || CASE WHEN s_suppkey % 2 = 0 THEN 'ortho' ELSE 'overlay' END AS folder, '1.' || (s_suppkey % 4 + 1) || '.0' AS minor, '1.' || (s_suppkey % 4) || '.' || (s_suppkey % 12 + 1) AS patch,
CASE WHEN s_suppkey % 8 + 1 < 6 THEN least(100.0 * pow(2, s_suppkey % 8), 30000) ELSE -1 END::DOUBLE AS delay_ms FROM supplier""")
def name_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package folders, bumped versions, and backoff delays of attempts."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    v = F.concat_ws(".", F.lit("1"), (k % 4).cast("string"), (k % 12).cast("string"))
    folder = text.mountpoint(F.concat(F.lit("Region"), (k % 40).cast("string")), F.when(k % 2 == 0, "Z").otherwise("Y"))
    return s.select(k.alias("id"), folder.alias("folder"), text.bumped(v, "minor").alias("minor"), text.bumped(v, "patch").alias("patch"), F.coalesce(text.delay_ms(k % 8 + 1, 6), F.lit(-1.0)).alias("delay_ms"))


@query("""SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value, round(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1.94384, 6) AS knots, round(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 3.28084, 6) AS feet FROM events""")
def name_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of JSON messages by name, in the units they are wanted in."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.try_element_at(F.from_json("props", "map<string,double>"), F.lit("k"))
    return e.select(F.col("event_id").alias("seq"), v.alias("value"), F.round(v * 1.94384, 6).alias("knots"), F.round(v * 3.28084, 6).alias("feet"))
