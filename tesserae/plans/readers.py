"""Stored indexes, binary packets and file formats, over text and bytes made from the tables."""

from __future__ import annotations

from struct import pack

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import binary
from tesserae.registry import query
from tesserae.sources import caches, files, shared, tables
from tesserae.sources.tables import cte


def _text(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


# --- binary packets -----------------------------------------------------------------------------------------------------------------------


@query(
    cte("positions")
    + """, p AS (SELECT seq, seq % 3 <> 1 AS a, seq % 3 <> 2 AS h, seq % 5 <> 0 AS v, CAST(CAST(lat AS FLOAT) AS DOUBLE) AS lat, CAST(CAST(lon AS FLOAT) AS DOUBLE) AS lon, CAST(CAST(ground_speed * 20.3 AS FLOAT) AS DOUBLE) AS alt, CAST(CAST(heading - 180.7 AS FLOAT) AS DOUBLE) AS hd, CAST(CAST(ground_speed / 3 AS FLOAT) AS DOUBLE) AS kt FROM positions WHERE seq % 11 <> 7)
SELECT seq, CASE WHEN a THEN lat END AS lat, CASE WHEN a THEN lon END AS lon, CASE WHEN a THEN alt END AS altitude_ft, CASE WHEN h THEN (CASE WHEN hd < 0 THEN hd + 360 ELSE hd END) END AS heading, CASE WHEN v THEN kt END AS knots FROM p"""
)
def scan_data_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as binary packets, with records that are not read between, some cut off, some of another kind, and back."""
    values = {"a": F.col("lat"), "o": F.col("lon"), "alt": F.col("ground_speed") * 20.3, "hd": F.col("heading") - 180.7, "kt": F.col("ground_speed") / 3}
    p = tables.positions(spark, sf_dir).select("seq", *[binary.single_hex(v).alias(k) for k, v in values.items()])
    record = lambda n, *v: F.concat(F.lit(pack("<I", n).hex()), *[F.lit(pack("<f", x).hex()) if isinstance(x, float) else F.col(x) for x in v])
    seq, zero = F.col("seq"), (0.0,)
    position = record(files.POSITION, "a", "o", -1.5, "alt", *zero * 4)
    heading = record(files.HEADINGS, 0.25, 0.5, "hd", 7.0, *zero * 4)
    speed = record(files.SPEEDS, 1.0, 2.0, 3.0, "kt", *zero * 4)
    other = record(99, *zero * 8)
    rest = F.when(seq % 4 == 0, F.substring(position, 1, 40)).otherwise(F.lit(""))  # not a whole record
    kind = F.when(seq % 11 == 7, F.lit("58475053")).otherwise(F.lit("44415441"))
    some = lambda keep, x: F.when(keep, x).otherwise(F.lit(""))
    body = F.concat(kind, F.lit("2A"), other, some(seq % 3 != 1, position), some(seq % 3 != 2, heading), some(seq % 5 != 0, speed), other, rest)
    return files.data_packets(p.select("seq", F.unhex(body).alias("packet")))


# --- stored index of scenery tiles ---------------------------------------------------------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored index for each supplier, with two packages and its line items as tiles, and the packages that are there now; some do not match."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("index"), _text("s_suppkey")).alias("file"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sea = F.col("l_linenumber") == 1
    n = li.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("tiles"), F.count_if(sea).alias("sea"))
    k = F.col("k")
    name = lambda i: F.concat(F.lit("P"), _text(k % 7), F.lit("ab"[i]))
    package = lambda i: F.concat_ws("  ", name(i), F.concat(F.lit("/s/"), name(i)), _text(k * 100 + i), _text(k % 5 + i))
    first = [F.when(k % 13 == 1, "OTHER").otherwise(caches.CACHE_HEAD), F.when(k % 13 == 2, "2").when(k % 13 == 3, "x").otherwise("1"), F.lit("2"), F.when(k % 13 == 4, "many").otherwise(_text("tiles")), _text("sea")]
    lines = F.array(*first, package(0), F.when(k % 13 == 5, F.lit("P  broken")).otherwise(package(1)), F.lit(""))
    head = s.join(n, "k", "left").withColumns({"tiles": F.coalesce("tiles", F.lit(0)), "sea": F.coalesce("sea", F.lit(0))}).select("file", F.posexplode(lines).alias("n", "line"))
    body = F.concat_ws("  ", _text("l_orderkey"), _text("l_partkey"), F.lit("16"), F.concat(_text(F.col("l_partkey") % 80), F.lit(".5")), F.concat(F.lit("-"), _text(F.col("l_partkey") % 170), F.lit(".25")), F.when(sea, "1").otherwise("0"))
    tiles = li.select(F.concat(F.lit("index"), _text("l_suppkey")).alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 10).cast("int").alias("n"), F.when(F.col("l_partkey") % 50 == 0, F.lit("no tile")).otherwise(body).alias("line"))
    now = s.where(k % 13 != 8).select("file", "k", F.explode(F.array(*[F.struct(name(i).alias("name"), F.concat(F.lit("/s/"), name(i)).alias("path"), (k * 100 + i + F.when((k % 13 == 6) & (F.lit(i) == 1), 1).otherwise(0)).alias("mtime"), (k % 5 + i + F.when((k % 13 == 7) & (F.lit(i) == 0), 1).otherwise(0)).alias("files")) for i in range(2)])).alias("p"))
    return head.unionByName(tiles), now.select("file", "p.*")


@query("""WITH n AS (SELECT l_suppkey AS k, count(*) AS tiles, count(*) FILTER (l_linenumber = 1) AS sea FROM lineitem GROUP BY 1)
SELECT 'index' || s_suppkey AS file, CASE s_suppkey % 13 WHEN 1 THEN 'invalid' WHEN 2 THEN 'stale' WHEN 3 THEN 'invalid' WHEN 4 THEN 'invalid' WHEN 5 THEN 'invalid' WHEN 6 THEN 'stale' WHEN 7 THEN 'stale' WHEN 8 THEN 'stale' ELSE 'loaded' END AS status,
 CASE s_suppkey % 13 WHEN 1 THEN 'head' WHEN 2 THEN 'other_version' WHEN 3 THEN 'version' WHEN 4 THEN 'tile_count' WHEN 5 THEN 'package_line' WHEN 6 THEN 'other_packages' WHEN 7 THEN 'other_packages' WHEN 8 THEN 'other_package_count' END AS reason,
 CASE WHEN s_suppkey % 13 <> 4 THEN coalesce(tiles, 0) ELSE -1 END AS tiles, coalesce(sea, 0) AS sea_tiles FROM supplier LEFT JOIN n ON k = s_suppkey""")
def scan_index_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored indexes hold for the packages that are there, and why others do not."""
    lines, now = _stored(spark, sf_dir)
    return caches.index_heads(lines, now).withColumn("tiles", F.coalesce("tiles", F.lit(-1)))


@query("""SELECT 'index' || l_suppkey AS file, l_orderkey AS "row", l_partkey AS col, 16 AS zoom, CAST(l_partkey % 80 || '.5' AS FLOAT) AS lat, CAST('-' || l_partkey % 170 || '.25' AS FLOAT) AS lon, l_linenumber = 1 AS is_sea FROM lineitem WHERE l_partkey % 50 <> 0""")
def scan_index_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.index_tiles(_stored(spark, sf_dir)[0])


# --- union index kept up source by source ---------------------------------------------------------------------------------------------------


@query(cte("source_files") + """, f AS (SELECT 'S' || source_idx AS source, path, max(size) AS size FROM source_files WHERE source_idx % 10 <> 3 GROUP BY ALL),
g AS (SELECT source, path, CASE WHEN source LIKE '%1' THEN size + 1000 ELSE size END AS size FROM f UNION ALL SELECT 'Snew', 'Earth nav data/f0.dsf', 5)
SELECT path, source, CAST(size AS BIGINT) AS size FROM g QUALIFY row_number() OVER (PARTITION BY path ORDER BY CASE WHEN source = 'Snew' THEN 'a' ELSE 'b' || length(source) END, source) = 1""")
def join_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all sources, stored; then some change, some go and one comes, and only those are written: the union is that of a full build."""
    at = shared.scratch(spark, "index")
    when = F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))
    f = tables.source_files(spark, sf_dir).groupBy("source_idx", "path").agg(F.max("size").alias("size"))
    f.select(F.concat(F.lit("S"), _text("source_idx")).alias("source"), "path", "size", when.alias("mtime")).write.parquet(f"{at}/files")  # read five times
    f = spark.read.schema("source string, path string, size long, mtime timestamp_ntz").parquet(f"{at}/files")
    caches.refreshed(spark, at, f)
    later = f.where(~F.col("source").rlike("^S(.*)3$")).withColumn("size", F.when(F.endswith("source", F.lit("1")), F.col("size") + 1000).otherwise(F.col("size")))
    new = spark.createDataFrame([("Snew", "Earth nav data/f0.dsf", 5)], "source string, path string, size long").withColumn("mtime", when)
    later = later.unionByName(new)
    caches.refreshed(spark, at, later)
    order = later.select("source").distinct().withColumn("sort_key", F.when(F.col("source") == "Snew", "a").otherwise(F.concat(F.lit("b"), _text(F.length("source")))))
    return caches.union_index(spark, at, order)


# --- readers that had no query -----------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 80 - 40 AS a, p_partkey % 170 - 85 AS o FROM part)
SELECT DISTINCT CAST((k * 16) // 16 AS BIGINT) AS "row", CAST((k * 32) // 16 AS BIGINT) AS col, 14 AS zoom FROM p WHERE k % 9 <> 0 AND a >= -10 AND a < 20 AND o >= -60 AND o < 60""")
def scan_prewarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of terrain files whose middle lies in a box; those without one in their first ten lines do not count."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    k = F.col("k")
    name = F.concat(_text(k * 16), F.lit("_"), _text(k * 32), F.lit("_BI18.ter"))
    centre = F.concat(F.lit("LOAD_CENTER "), _text(k % 80 - 40), F.lit(" "), _text(k % 170 - 85), F.lit(" 4000 4096"))
    lines = F.when(k % 9 == 0, F.concat(F.array_repeat(F.lit("x"), 10), F.array(centre))).otherwise(F.array(F.lit("A"), centre))
    return files.terrain_tiles(p.select(name.alias("file"), F.posexplode(lines).alias("n", "line")), (-10.0, 20.0, -60.0, 60.0))


@query(cte("positions") + """, c AS (SELECT DISTINCT CAST(floor(lat) AS INT) AS s, CAST(floor(lon) AS INT) AS w FROM positions)
SELECT s AS dsf_lat, w AS dsf_lon, '{"type":"Feature","properties":{"name":"' || CASE WHEN s < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(s) AS VARCHAR), 2, '0') || CASE WHEN w < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(w) AS VARCHAR), 3, '0') ||
 '"},"geometry":{"type":"Polygon","coordinates":[[[' || w || ',' || s || '],[' || (w + 1) || ',' || s || '],[' || (w + 1) || ',' || (s + 1) || '],[' || w || ',' || (s + 1) || '],[' || w || ',' || s || ']]]}}' AS feature FROM c""")
def gen_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon for each cell that a flight was in."""
    p = tables.positions(spark, sf_dir).select(F.floor("lat").cast("int").alias("dsf_lat"), F.floor("lon").cast("int").alias("dsf_lon")).distinct()
    return files.geojson(p)
