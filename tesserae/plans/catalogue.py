"""Readers over text made from the tables, and lookups in what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import generate, geo
from tesserae.operators import catalogue
from tesserae.plans.geo import sql_col, sql_row
from tesserae.registry import query
from tesserae.sources import files, tables
from tesserae.sources.tables import cte


def _lines(df: DataFrame, name, *lines) -> DataFrame:
    return df.select(F.col(name).alias("file") if isinstance(name, str) else name.alias("file"), F.posexplode(F.array(*lines)).alias("n", "line"))


def _text(x) -> F.Column:
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


# --- terrain files ----------------------------------------------------------------------------------------------------------------------


def _terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain files of the parts: some without a place, some with a name that cannot be read, some at sea."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    name = F.concat(_text(k), F.when(k % 3 == 0, "_sea").otherwise(""), F.lit(".ter"))
    place = F.when(k % 11 == 0, F.lit("LOAD_CENTER x y")).otherwise(F.concat(F.lit("LOAD_CENTER "), _text(k % 160 - 80), F.lit(".5 "), _text(k % 340 - 170), F.lit(".25 7000 4096")))
    tex = F.when(k % 13 == 0, F.lit("BASE_TEX_NOWRAP ../textures/none.png")).otherwise(F.concat(F.lit("BASE_TEX_NOWRAP ../textures/"), _text(k * 16), F.lit("_"), _text(k * 32), F.lit("_BI16.dds")))
    return _lines(p, name, F.lit("A"), F.lit("800"), F.lit("TERRAIN"), place, F.lit(""), tex)


@query("""SELECT p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '_sea' ELSE '' END || '.ter' AS file, p_partkey * 16 AS "row", p_partkey * 32 AS col, 16 AS zoom, 'BI' AS provider,
CAST(p_partkey % 160 - 80 || '.5' AS FLOAT) AS lat, CAST(p_partkey % 340 - 170 || '.25' AS FLOAT) AS lon, p_partkey % 3 = 0 AS is_sea FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0""")
def scan_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain files read line by line."""
    return files.terrain_of(_terrain(spark, sf_dir))


@query("""SELECT p_partkey * 16 AS "row", p_partkey * 32 AS col, 16 AS zoom, CAST(p_partkey % 160 - 80 || '.5' AS FLOAT) AS lat FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 160 - 80 = 10 AND p_partkey % 340 - 170 = 10
UNION ALL SELECT p_partkey * 16, p_partkey * 32, 16, CAST(p_partkey % 160 - 80 || '.5' AS FLOAT) FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND CAST(floor(CAST(p_partkey % 160 - 80 || '.5' AS DOUBLE)) AS INT) = 3 AND CAST(floor(CAST(p_partkey % 340 - 170 || '.25' AS DOUBLE)) AS INT) = -87""")
def scan_terrain_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain of two cells."""
    t = files.terrain_of(_terrain(spark, sf_dir))
    return catalogue.in_cell(t, (10, 10)).unionByName(catalogue.in_cell(t, (3, -87))).select("row", "col", "zoom", "lat")


@query(cte("cache_entries") + """ SELECT entry_id, CASE WHEN (zoom + entry_id % 3 = 13 AND "row" BETWEEN 100 AND 2000 AND col BETWEEN 0 AND 3000) OR (zoom + entry_id % 3 = 14 AND "row" >= 3000 AND "row" <= 4000 AND col BETWEEN 5 AND 500) THEN "row" ELSE -1 END AS "row" FROM cache_entries""")
def name_ter_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.cache_entries(spark, sf_dir)
    name = F.concat(_text("row"), F.lit("_"), _text("col"), F.lit("_GO2"), _text(F.col("zoom") + F.col("entry_id") % 3), F.when(F.col("entry_id") % 2 == 0, "_sea").otherwise(""), F.lit(".ter"))
    return e.select("entry_id", F.coalesce(catalogue.ter_in_bounds(name, [(13, 100, 2000, 0, 3000), (14, 3000, 4000, 5, 500)])["row"], F.lit(-1)).alias("row"))


# --- airports ---------------------------------------------------------------------------------------------------------------------------


def _airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airport blocks of the suppliers, one file per nation: some with a datum, some with a runway, some with neither."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    code = F.concat(F.lit("Q"), F.lpad(F.upper(F.conv(_text(k), 10, 36)), 3, "0"))
    head = F.concat(F.lit("1 "), _text(k % 3000), F.lit(" 0 0 "), code, F.lit(" Field "), _text(k))
    lat, lon = F.concat(_text(k % 160 - 80), F.lit(".125")), F.concat(_text(k % 350 - 175), F.lit(".75"))
    datum = [F.when(k % 3 == 0, F.concat(F.lit(f"1302 datum_{n} "), x)).otherwise("1302 city Somewhere") for n, x in (("lat", lat), ("lon", lon))]
    runway = F.when(k % 3 == 1, F.concat(F.lit("100 45.0 1 0 0.25 0 2 0 09 "), lat, F.lit(" "), lon, F.lit(" 0 0"))).otherwise("20 sign")
    # All lines of a file have one order.
    return s.select(F.concat(F.lit("apt"), _text("s_nationkey"), F.lit(".dat")).alias("file"), k.alias("k"), F.posexplode(F.array(head, *datum, runway)).alias("i", "line")).select("file", (F.col("k") * 4 + F.col("i")).cast("int").alias("n"), "line")


_AIR = """a AS (SELECT s_suppkey AS k, 'Q' || lpad(CASE WHEN s_suppkey >= 46656 THEN chr(CAST(CASE WHEN s_suppkey // 46656 % 36 < 10 THEN 48 + s_suppkey // 46656 % 36 ELSE 55 + s_suppkey // 46656 % 36 END AS INT)) ELSE '' END || CASE WHEN s_suppkey >= 1296 THEN chr(CAST(CASE WHEN s_suppkey // 1296 % 36 < 10 THEN 48 + s_suppkey // 1296 % 36 ELSE 55 + s_suppkey // 1296 % 36 END AS INT)) ELSE '' END
  || CASE WHEN s_suppkey >= 36 THEN chr(CAST(CASE WHEN s_suppkey // 36 % 36 < 10 THEN 48 + s_suppkey // 36 % 36 ELSE 55 + s_suppkey // 36 % 36 END AS INT)) ELSE '' END || chr(CAST(CASE WHEN s_suppkey % 36 < 10 THEN 48 + s_suppkey % 36 ELSE 55 + s_suppkey % 36 END AS INT)), 3, '0') AS icao,
  'Field ' || s_suppkey AS name, CAST(s_suppkey % 160 - 80 || '.125' AS DOUBLE) AS latitude, CAST(s_suppkey % 350 - 175 || '.75' AS DOUBLE) AS longitude, CAST(s_suppkey % 3000 AS FLOAT) AS elevation_ft FROM supplier WHERE s_suppkey % 3 < 2)"""


@query(f"WITH {_AIR} SELECT icao, name, latitude, longitude, elevation_ft FROM a")
def scan_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.airports_of(_airports(spark, sf_dir))


@query(f"WITH {_AIR} SELECT 'Q00A' AS asked, icao, name FROM a WHERE icao = 'Q00A' UNION ALL SELECT 'q00a', icao, name FROM a WHERE icao = 'Q00A' UNION ALL SELECT 'q01C', icao, name FROM a WHERE icao = 'Q01C'")
def join_airport_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes in any case."""
    a = files.airports_of(_airports(spark, sf_dir))
    one, two, three = (catalogue.airport(a, c).select(F.lit(c).alias("asked"), "icao", "name") for c in ("Q00A", "q00a", "q01C"))
    return one.unionByName(two).unionByName(three)


# --- package lists and metadata -----------------------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package list of the customers, one file per nation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    line = F.concat_ws("  ", F.sha2(_text(k), 256), F.when(k % 4 == 0, "Y").otherwise("Z"), F.concat(F.lit("R"), _text(k % 40)), F.concat(_text(k % 3), F.lit(".0."), _text(k % 7)), F.concat(F.lit("https://example.org/"), _text(k)))
    file = F.concat(F.lit("list"), _text("c_nationkey"))
    return c.select(file.alias("file"), (k + 6).cast("int").alias("n"), line.alias("line"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    g = e.groupBy("file").agg(F.count("*").alias("c"))
    head = F.array(F.lit("X REGIONAL SCENERY PACKAGE LIBRARY"), F.lit("1.0.0"), F.concat(F.lit("scope "), "file"), F.lit("17"), F.lit("2025-03-01T10:30:00+02:00"), _text(F.col("c") + F.when(F.endswith("file", F.lit("3")), 1).otherwise(0)))
    return e.unionByName(g.select("file", F.posexplode(head).alias("n", "line")))


_LIST = """e AS (SELECT sha256(CAST(c_custkey AS VARCHAR)) AS checksum, CASE WHEN c_custkey % 4 = 0 THEN 'Y' ELSE 'Z' END AS package_type, 'R' || c_custkey % 40 AS title, c_custkey % 3 || '.0.' || c_custkey % 7 AS version, 'https://example.org/' || c_custkey AS metadata_url, 'list' || c_nationkey AS file FROM customer)"""


@query(f"WITH {_LIST} SELECT checksum, package_type, title, version, metadata_url FROM e")
def scan_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.library_of(_lists(spark, sf_dir))


@query(f"WITH {_LIST} SELECT file, '1.0.0' AS spec_version, 'scope ' || file AS scope, CAST(17 AS BIGINT) AS sequence, TIMESTAMP '2025-03-01 08:30:00' AS published_at, count(*) + CAST(file LIKE '%3' AS INT) AS packages, NOT file LIKE '%3' AS ok FROM e GROUP BY file")
def scan_library_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = files.library_head(_lists(spark, sf_dir))
    return h.withColumn("published_at", F.to_utc_timestamp(F.col("published_at"), F.current_timezone()).cast("timestamp_ntz"))


@query(f"WITH {_LIST} SELECT 'find' AS how, title, checksum FROM e WHERE title = 'R7' AND package_type = 'Z' UNION ALL SELECT 'region', title, checksum FROM e WHERE title = 'R8' UNION ALL SELECT DISTINCT 'regions', title, NULL FROM e")
def join_library_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find by region and type, all of a region, the different regions."""
    e = files.library_of(_lists(spark, sf_dir))
    rows = lambda d, how, c: d.select(F.lit(how).alias("how"), "title", c.alias("checksum"))
    none = F.lit(None).cast("string")
    return rows(catalogue.find(e, "r7", "Z"), "find", F.col("checksum")).unionByName(rows(catalogue.find(e, "r8"), "region", F.col("checksum"))).unionByName(rows(catalogue.regions(e), "regions", none))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of a package per supplier: some with a wrong head, version, time, number or part."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    parts = F.transform(F.sequence(F.lit(1), (k % 3).cast("int")), lambda i: F.concat_ws("  ", F.when((k + i) % 5 == 0, "").otherwise(F.concat(F.lit("sum"), i.cast("string"))), F.concat(F.lit("part"), i.cast("string")), F.when((k + i) % 4 == 0, "").otherwise("https://example.org/p")))
    parts = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(parts)
    head = F.array(
        F.when(k % 17 == 0, "OTHER").otherwise("X REGIONAL SCENERY PACKAGE"), F.lit("1.0.0"), F.concat(F.lit("Title "), _text(k), F.lit("  "), F.when(k % 19 == 0, "x").otherwise("2.1.0")), F.when(k % 23 == 0, "yesterday").otherwise("2025-03-01T10:30:00Z"),
        F.when(k % 29 == 0, "Q").when(k % 2 == 0, "Z").otherwise("Y"), F.lit("mount"), F.lit("file"), _text(k % 3 + F.when(k % 31 == 0, 1).otherwise(0)), F.lit(""), F.lit(""),
    )
    return s.select(F.concat(F.lit("m"), _text(k)).alias("file"), F.posexplode(F.concat(head, F.transform(parts, lambda x: F.concat(x, F.lit(""))))).alias("n", "line"))


# A line is trimmed before it is split, so an empty checksum takes its separator with it and an empty address its own.
_META = """p AS (SELECT s_suppkey AS k, i, (s_suppkey + i) % 5 = 0 AS no_sum, (s_suppkey + i) % 4 = 0 AS no_url FROM (SELECT s_suppkey, unnest(range(1, s_suppkey % 3 + 1)) AS i FROM supplier)),
f AS (SELECT k, i, CASE WHEN no_sum THEN 'part' || i ELSE 'sum' || i END AS checksum, CASE WHEN no_sum AND no_url THEN NULL WHEN no_sum THEN 'https://example.org/p' ELSE 'part' || i END AS filename, CASE WHEN no_sum OR no_url THEN '' ELSE 'https://example.org/p' END AS url, no_sum AND no_url AS short FROM p),
m AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 17 = 0 THEN 'header' WHEN s_suppkey % 19 = 0 THEN 'title' WHEN s_suppkey % 23 = 0 THEN 'time' WHEN s_suppkey % 29 = 0 THEN 'type' WHEN EXISTS (FROM f WHERE f.k = s_suppkey AND short) THEN 'part' WHEN s_suppkey % 31 = 0 THEN 'parts' END AS error FROM supplier)"""


@query(f"WITH {_META} SELECT 'm' || k AS file, error, CAST((SELECT count(*) FROM f WHERE f.k = m.k) AS INT) AS parts, CASE WHEN error IS NULL THEN 'Title ' || k END AS title FROM m")
def scan_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = files.metadata_of(_metadata(spark, sf_dir))
    return m.select("file", "error", F.size("parts").alias("parts"), F.when(F.col("error").isNull(), F.col("title")).alias("title"))


@query(f"""WITH {_META}, g AS (SELECT k FROM m WHERE error IS NULL), c AS (SELECT unnest(['initial', 'awaiting_urls', 'release']) AS context)
SELECT context, 'm' || k AS file, -1 AS part, 'no_parts' AS error FROM g, c WHERE context <> 'initial' AND NOT EXISTS (FROM f WHERE f.k = g.k)
UNION ALL SELECT context, 'm' || k, CAST(i - 1 AS INT), 'empty_checksum' FROM f JOIN g USING (k), c WHERE checksum = '' UNION ALL SELECT context, 'm' || k, CAST(i - 1 AS INT), 'missing_url' FROM f JOIN g USING (k), c WHERE context = 'release' AND url = ''""")
def agg_metadata_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps packages from each stage."""
    m = files.metadata_of(_metadata(spark, sf_dir)).where("error is null")
    every = [files.metadata_errors(m, c).select(F.lit(c).alias("context"), "file", F.coalesce("part", F.lit(-1)).alias("part"), "error") for c in ("initial", "awaiting_urls", "release")]
    return every[0].unionByName(every[1]).unionByName(every[2])


# --- patches and sources ------------------------------------------------------------------------------------------------------------------


def _patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_partkey") % 97
    path = F.when((F.col("l_linenumber") == 1) & (F.col("l_suppkey") % 4 == 0), F.lit("readme.txt")).when(F.col("l_linenumber") == 1, F.concat(F.lit("Earth nav data/+10/"), _text(n), F.lit(".dsf"))).when(F.col("l_linenumber") == 2, F.concat(F.lit("terrain/"), _text(n), F.lit(".ter"))).when(F.col("l_linenumber") == 3, F.concat(F.lit("textures/"), _text(n), F.lit(".DDS"))).otherwise(F.concat(F.lit("Earth nav data/"), _text(n), F.lit(".txt")))
    kind = F.when(F.col("l_suppkey") % 9 == 0, F.lit(".p")).otherwise(F.lit("p"))  # some are hidden
    return li.select(F.concat(kind, F.lpad(_text("l_suppkey"), 6, "0")).alias("patch"), path.alias("path"))


_PATCH = """f AS (SELECT 'p' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS patch, CASE WHEN l_linenumber = 1 AND l_suppkey % 4 = 0 THEN 'readme.txt' WHEN l_linenumber = 1 THEN 'Earth nav data/+10/' || l_partkey % 97 || '.dsf' WHEN l_linenumber = 2 THEN 'terrain/' || l_partkey % 97 || '.ter' WHEN l_linenumber = 3 THEN 'textures/' || l_partkey % 97 || '.DDS' ELSE 'Earth nav data/' || l_partkey % 97 || '.txt' END AS path
  FROM lineitem WHERE l_suppkey % 9 <> 0),
v AS (SELECT patch, count(*) FILTER (path LIKE 'Earth nav data/%.dsf') AS dsf, count(*) FILTER (path LIKE 'terrain/%') AS ter, count(*) FILTER (path LIKE 'textures/%') AS dds, bool_or(path LIKE 'Earth nav data/%') AS has_nav FROM f GROUP BY patch),
s AS (SELECT *, CASE WHEN NOT has_nav THEN 'no_nav_data' WHEN dsf = 0 THEN 'no_cells' END AS error FROM v)"""


@query(f"WITH {_PATCH} SELECT patch, dsf, ter, dds, has_nav, error FROM s")
def scan_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with what they hold and why they are not valid."""
    return catalogue.patches(_patch_files(spark, sf_dir))


@query(f"""WITH {_PATCH} SELECT '_patches/' || patch AS sort_key, patch AS name, TRUE AS is_patch FROM s WHERE error IS NULL
UNION ALL SELECT 'r' || c_custkey, 'R' || c_custkey, FALSE FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0""")
def join_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid patches and enabled packages of images that are there."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("R"), _text(k)).alias("region"), F.when(k % 4 == 0, "Y").otherwise("Z").alias("package_type"), (k % 3 != 0).alias("enabled"), (k % 5 != 0).alias("present"))
    return catalogue.discovered(catalogue.patches(_patch_files(spark, sf_dir)), c)


@query(f"""WITH {_PATCH}, u AS (SELECT patch, path, FALSE AS d FROM f UNION ALL SELECT patch, unnest(CASE WHEN path LIKE 'Earth nav data/+10/%' THEN ['Earth nav data', 'Earth nav data/+10'] WHEN path = 'readme.txt' THEN [] ELSE [split_part(path, '/', 1)] END), TRUE FROM f)
SELECT path, min(patch) AS patch, bool_or(d) AS is_dir FROM u WHERE patch IN (SELECT patch FROM s WHERE error IS NULL) GROUP BY path""")
def join_patch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and folders of the valid patches, the first patch's of each."""
    f = _patch_files(spark, sf_dir)
    return catalogue.union_of_patches(f, catalogue.patches(f))


# --- progress and small folds -------------------------------------------------------------------------------------------------------------


@query(cte("cache_entries") + """ SELECT entry_id, CASE WHEN entry_id % 5 <> 0 THEN "row" ELSE -1 END AS "row", CASE WHEN entry_id % 5 <> 0 THEN col ELSE -1 END AS col, CASE WHEN entry_id % 5 <> 0 THEN zoom ELSE -1 END AS zoom FROM cache_entries""")
def name_job_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.cache_entries(spark, sf_dir)
    name = F.concat(F.when(F.col("entry_id") % 5 == 0, "job-").otherwise("dds-"), _text("row"), F.lit("_"), _text("col"), F.lit("_ZL"), _text("zoom"))
    return e.select("entry_id", catalogue.job_tile(name).alias("t")).select("entry_id", *[F.coalesce(f"t.{c}", F.lit(-1)).alias(c) for c in ("row", "col", "zoom")])


@query(cte("metric_events") + """ SELECT session_id, count(*) FILTER (seq % 3 = 0) AS in_progress, count(*) FILTER (seq % 3 = 1) AS prefetched, count(*) FILTER (seq % 3 = 2) AS no_coverage FROM metric_events GROUP BY session_id""")
def agg_region_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells are in each state of their prefetch."""
    e = tables.metric_events(spark, sf_dir).withColumn("state", F.element_at(F.array(*map(F.lit, ("in_progress", "prefetched", "no_coverage"))), (F.col("seq") % 3 + 1).cast("int")))
    return e.groupBy("session_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("in_progress", "prefetched", "no_coverage")])


@query("""SELECT l_orderkey, round(CASE WHEN l_orderkey % 5 <> 0 THEN CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS DOUBLE) / sum(l_quantity) * 100 ELSE CAST(count(*) FILTER (l_linenumber % 2 = 0) AS DOUBLE) / count(*) * 100 END, 6) AS percent FROM lineitem GROUP BY l_orderkey""")
def agg_download_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads by bytes, by parts where no size is known."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    done = F.col("l_linenumber") % 2 == 0
    g = li.groupBy("l_orderkey").agg(F.sum(F.when(done, F.col("l_quantity")).otherwise(0)).alias("bytes"), F.sum("l_quantity").alias("total"), F.count_if(done).alias("parts"), F.count("*").alias("all"))
    total = F.when(F.col("l_orderkey") % 5 == 0, F.lit(0)).otherwise(F.col("total"))
    return g.select("l_orderkey", F.round(catalogue.percent(F.col("bytes"), total, F.col("parts"), F.col("all")), 6).alias("percent"))


@query(cte("tile_requests") + """, t AS (SELECT session_id, count(*) AS total, count(*) FILTER (seq % 4 = 0) AS done, count(*) FILTER (seq % 4 = 1) AS failed, count(*) FILTER (seq % 4 = 2) AS hits, count(*) FILTER (seq % 4 <> 2 AND session_id % 3 <> 0) AS todo FROM tile_requests GROUP BY session_id)
SELECT session_id, CAST(todo AS BIGINT) AS to_generate, CAST(greatest(0, total - done - failed - hits) AS BIGINT) AS in_flight, round(CASE WHEN todo = 0 THEN 1 ELSE CAST(done AS DOUBLE) / todo END, 6) AS fraction FROM t""")
def agg_warm_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a warm-up: what is left to make, in flight, done."""
    q = F.col("seq") % 4
    t = tables.tile_requests(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("total"), F.count_if(q == 0).alias("done"), F.count_if(q == 1).alias("failed"), F.count_if(q == 2).alias("hits"), F.count_if((q != 2) & (F.col("session_id") % 3 != 0)).alias("to_generate"))
    fraction, flying = catalogue.warm_progress("total", "done", "to_generate", "failed", "hits")
    return t.select("session_id", "to_generate", flying.alias("in_flight"), F.round(fraction, 6).alias("fraction"))


@query(cte("metric_events") + """, d AS (SELECT session_id, ts, seq, event_type, CASE event_type WHEN 'job_started' THEN 1 WHEN 'job_completed' THEN -1 ELSE 0 END AS d FROM metric_events), r AS (SELECT *, sum(d) OVER (PARTITION BY session_id ORDER BY ts, seq) AS open FROM d)
SELECT session_id, CAST(sum(d) AS BIGINT) AS in_progress, CAST(max(open) AS BIGINT) AS peak, count(*) FILTER (event_type = 'job_submitted') AS submitted, count(*) FILTER (event_type = 'job_completed') AS completed, max(ts) FILTER (event_type = 'job_completed') AS last_success FROM r GROUP BY session_id""")
def agg_runtime_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in progress, the most at once, totals and the last success."""
    kind = F.col("event_type")
    e = tables.metric_events(spark, sf_dir).withColumn("d", F.when(kind == "job_started", 1).when(kind == "job_completed", -1).otherwise(0))
    e = e.withColumn("open", F.sum("d").over(Window.partitionBy("session_id").orderBy("ts", "seq")))
    return e.groupBy("session_id").agg(F.sum("d").alias("in_progress"), F.max("open").alias("peak"), F.count_if(kind == "job_submitted").alias("submitted"), F.count_if(kind == "job_completed").alias("completed"), F.max(F.when(kind == "job_completed", F.col("ts"))).alias("last_success"))


@query("""SELECT lower(n_name) AS region, count(*) AS tiles FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def agg_coverage_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles per region, whatever the case of its name."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    title = F.when(F.col("s_suppkey") % 2 == 0, F.lower("n_name")).otherwise(F.upper("n_name"))
    return s.groupBy(F.lower(title).alias("region")).agg(F.count("*").alias("tiles"))


@query(
    cte("cache_entries")
    + """ SELECT CASE WHEN entry_id % 7 = 0 THEN 0 ELSE 1 END AS known, CAST(count(*) AS BIGINT) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM cache_entries GROUP BY ALL"""
)
def agg_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache files that move to their cell's folder, and those that stay."""
    e = tables.cache_entries(spark, sf_dir)
    name = F.when(F.col("entry_id") % 7 == 0, F.lit("readme.txt")).otherwise(F.concat(F.lit("tile_"), _text("zoom"), F.lit("_"), _text("row"), F.lit("_"), _text("col"), F.lit(".cache")))
    g = catalogue.migrated(e.select(name.alias("name"), "size_bytes"))
    return g.groupBy(F.when(F.col("region").isNull(), 0).otherwise(1).alias("known")).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


@query(cte("positions") + """ SELECT seq, '{"params":{"datarefs":[{"id":' || seq || '},{"id":' || source_id || '}]},"req_id":' || seq % 100 || ',"type":"dataref_subscribe_values"}' AS message FROM positions""")
def name_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.positions(spark, sf_dir)
    return p.select("seq", catalogue.subscription(F.col("seq") % 100, F.array("seq", "source_id")).alias("message"))


@query(
    cte("positions")
    + f""", g AS (SELECT DISTINCT CAST(floor(lat) AS INT) AS a, CAST(floor(lon) AS INT) AS o FROM positions),
s AS (SELECT a + r.range * 0.25::DOUBLE + 0.125::DOUBLE AS lat, o + c.range * 0.25::DOUBLE + 0.125::DOUBLE AS lon FROM g, range(4) r, range(4) c),
t AS (SELECT DISTINCT CAST({sql_row("lat", "12")} AS BIGINT) AS r, CAST({sql_col("lon", "12")} AS BIGINT) AS c FROM s WHERE lat BETWEEN -85.05112878 AND 85.05112878)
SELECT r AS "row", c AS col FROM t WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 4096 = r AND o_custkey % 4096 = c)"""
)
def join_warm_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles to make before a flight: those of the cells around the starts that are in no cache."""
    cells = tables.positions(spark, sf_dir).select(geo.degree("lat").alias("a"), geo.degree("lon").alias("o")).distinct()
    t = cells.select(F.inline(generate.sample_grid("a", "o", 12))).select("row", "col").distinct()
    return t.join(tables.cache_entries(spark, sf_dir).select("row", "col"), ["row", "col"], "left_anti")
