"""Joins, lookups, set operations, overlaps and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import geo
from tesserae.operators import index, overlap
from tesserae.plans.gen import SQL_BOX, boxes
from tesserae.functions.generate import box_cells
from tesserae.plans.geo import sql_col, sql_lat, sql_lon, sql_row
from tesserae.registry import query
from tesserae.sources import tables
from tesserae.sources.tables import cte

_RC = f"CAST(floor({sql_lat('q.row', 'q.zoom', 0.5)}) AS INT) AS dsf_lat, CAST(floor({sql_lon('q.col', 'q.zoom', 0.5)}) AS INT) AS dsf_lon"

# Layers made of the request and cache tables: what is in memory, patched, installed (as chunks) and on disk.
SQL_LAYERS = f"""t AS (SELECT DISTINCT "row", col, zoom FROM tile_requests), q AS (SELECT "row" AS row, col, zoom FROM t),
k AS (SELECT q.*, {_RC} FROM q),
m AS (SELECT DISTINCT "row", col, zoom FROM tile_requests WHERE session_id % 7 = 0),
p AS (SELECT DISTINCT dsf_lat, dsf_lon FROM k WHERE (dsf_lat + dsf_lon) % 5 = 0),
i AS (SELECT DISTINCT "row", col, zoom FROM tile_requests WHERE session_id % 11 = 3),
d AS (SELECT DISTINCT "row", col, zoom FROM tile_requests WHERE session_id % 13 = 5)"""


def layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    r = tables.tile_requests(spark, sf_dir)
    at = ["row", "col", "zoom"]
    t = r.select(*at).distinct()
    cells = t.select(geo.degree(geo.lat_of("row", "zoom", 0.5)).alias("dsf_lat"), geo.degree(geo.lon_of("col", "zoom", 0.5)).alias("dsf_lon")).distinct()
    some = lambda n, k: r.where(F.col("session_id") % n == k).select(*at).distinct()
    chunks = some(11, 3).select((F.col("row") * 16).alias("row"), (F.col("col") * 16).alias("col"), (F.col("zoom") + 4).alias("zoom"))
    return t, some(7, 0), cells.where((F.col("dsf_lat") + F.col("dsf_lon")) % 5 == 0), chunks, some(13, 5)


SQL_STAGE = f"""{SQL_LAYERS}, s AS (SELECT k.*, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m."row" = k.row AND m.col = k.col AND m.zoom = k.zoom) THEN 'memory'
  WHEN EXISTS (SELECT 1 FROM p WHERE p.dsf_lat = k.dsf_lat AND p.dsf_lon = k.dsf_lon) THEN 'patched'
  WHEN EXISTS (SELECT 1 FROM i WHERE i."row" = k.row AND i.col = k.col AND i.zoom = k.zoom) THEN 'installed'
  WHEN EXISTS (SELECT 1 FROM d WHERE d."row" = k.row AND d.col = k.col AND d.zoom = k.zoom) THEN 'disk' ELSE 'kept' END AS stage FROM k)"""


@query(cte("tile_requests") + f""", {SQL_STAGE} SELECT row AS "row", col, zoom, stage FROM s""")
def join_filter_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requested tile with the filter that takes it out."""
    return index.filtered(*layers(spark, sf_dir))


@query(cte("tile_requests") + f""", {SQL_STAGE} SELECT stage, count(*) AS tiles FROM s GROUP BY stage""")
def join_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.filtered(*layers(spark, sf_dir)).groupBy("stage").agg(F.count("*").alias("tiles"))


@query(cte("source_files") + """, n AS (SELECT path, min(source_idx) AS source_idx FROM source_files GROUP BY path)
SELECT path, source_idx, min(size) AS size FROM source_files JOIN n USING (path, source_idx) GROUP BY path, source_idx""")
def join_union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all sources: of each path the file of the first source."""
    return index.first_wins(tables.source_files(spark, sf_dir), ["path"], ["source_idx", "size"]).select("path", "source_idx", "size")


@query(cte("source_files") + """, e AS (SELECT DISTINCT 'd' || (source_idx % 3) AS dir, path AS name, source_idx FROM source_files)
SELECT dir, name, min(source_idx) AS source_idx FROM e GROUP BY dir, name""")
def join_directory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.source_files(spark, sf_dir).select(F.concat(F.lit("d"), (F.col("source_idx") % 3).cast("string")).alias("dir"), F.col("path").alias("name"), "source_idx")
    return index.first_wins(e, ["dir", "name"], ["source_idx"])


_LAZY = """, f AS (SELECT CASE WHEN source_idx % 3 = 0 THEN 'terrain/' || path WHEN source_idx % 3 = 1 THEN 'textures/' || path ELSE path END AS path, source_idx, source_idx % 2 = 0 AS is_patch FROM source_files),
own AS (SELECT path, min(source_idx) AS a FROM f WHERE source_idx % 5 = 0 GROUP BY path), probe AS (SELECT path, min(source_idx) AS b FROM f WHERE path LIKE 'terrain/%' OR path LIKE 'textures/%' GROUP BY path),
paths AS (SELECT DISTINCT path FROM f)"""


def _lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source_idx")
    f = tables.source_files(spark, sf_dir)
    return f.select(F.when(s % 3 == 0, F.concat(F.lit("terrain/"), "path")).when(s % 3 == 1, F.concat(F.lit("textures/"), "path")).otherwise(F.col("path")).alias("path"), "source_idx", (s % 2 == 0).alias("is_patch"))


@query(cte("source_files") + _LAZY + " SELECT path, coalesce(a, b, -1) AS source_idx FROM paths LEFT JOIN own USING (path) LEFT JOIN probe USING (path)")
def join_lazy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index holds every fifth source; other lazy paths are found by looking into the sources; -1 is not found."""
    f = _lazy(spark, sf_dir)
    out = index.resolved(f.select("path").distinct(), f.where(F.col("source_idx") % 5 == 0), f)
    return out.select("path", F.coalesce("source_idx", F.lit(-1)).alias("source_idx"))


@query(
    cte("source_files")
    + _LAZY
    + """, c AS (SELECT DISTINCT path, CAST(length(path) % 7 AS INT) AS dsf_lat, CAST(length(path) % 5 AS INT) AS dsf_lon FROM f), j AS (SELECT c.*, f.source_idx, CASE WHEN dsf_lat % 2 = 0 AND is_patch THEN 0 ELSE 1 END AS late FROM c JOIN f USING (path)),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY late, source_idx) AS n FROM j) SELECT path, dsf_lat, dsf_lon, source_idx FROM r WHERE n = 1"""
)
def join_geo_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _lazy(spark, sf_dir)
    p = f.select("path", (F.length("path") % 7).alias("dsf_lat"), (F.length("path") % 5).alias("dsf_lon")).distinct()
    return index.resolved_near_patches(p, f, p.where("dsf_lat % 2 = 0")).select("path", "dsf_lat", "dsf_lon", "source_idx")


_PLACES = """, s AS (SELECT o_orderkey AS place, CAST((o_orderkey * 7727 % 16000) / CAST(100 AS DOUBLE) - 80 AS FLOAT) AS p_lat, CAST((o_custkey * 6151 % 35900) / CAST(100 AS DOUBLE) - 179.5 AS FLOAT) AS p_lon FROM orders),
q AS (SELECT c_custkey AS seq, CAST((c_custkey * 7919 % 16000) / CAST(100 AS DOUBLE) - 80 AS FLOAT) AS lat, CAST((c_custkey * 104729 % 35900) / CAST(100 AS DOUBLE) - 179.5 AS FLOAT) AS lon FROM customer)"""


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    f = lambda k, m, n, off: (F.col(k) * m % n / F.lit(100.0) - off).cast("float")
    s = o.select(F.col("o_orderkey").alias("place"), f("o_orderkey", 7727, 16000, 80).alias("p_lat"), f("o_custkey", 6151, 35900, 179.5).alias("p_lon"))
    return c.select(F.col("c_custkey").alias("seq"), f("c_custkey", 7919, 16000, 80).alias("lat"), f("c_custkey", 104729, 35900, 179.5).alias("lon")), s


@query(
    "WITH x AS (SELECT 1)"
    + _PLACES
    + """, d AS (SELECT seq, place, CAST((p_lat - lat) * CAST(60 AS FLOAT) AS FLOAT) AS y, CAST(CAST(CAST(p_lon - lon AS FLOAT) * CAST(60 AS FLOAT) AS FLOAT) * CAST(cos(CAST(CAST(radians(CAST(lat AS DOUBLE)) AS FLOAT) AS DOUBLE)) AS FLOAT) AS FLOAT) AS x
  FROM q JOIN s ON floor(p_lat) BETWEEN floor(lat - 0.75) AND ceil(lat + 0.75)), e AS (SELECT seq, place, CAST(sqrt(CAST(CAST(CAST(y * y AS FLOAT) + CAST(x * x AS FLOAT) AS FLOAT) AS DOUBLE)) AS FLOAT) AS nm FROM d)
SELECT seq, place, round(CAST(nm AS DOUBLE), 3) AS nm FROM e WHERE nm <= 45"""
)
def join_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within 45 nautical miles of each customer's point."""
    q, s = _places(spark, sf_dir)
    return index.radius_join(q, s, 45.0).select("seq", "place", F.round(F.col("nm").cast("double"), 3).alias("nm"))


def _scenery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenery tiles at the places of orders: the chunk of each place at zoom 16."""
    _, s = _places(spark, sf_dir)
    t = geo.try_tile(F.col("p_lat").cast("double"), F.col("p_lon").cast("double"), F.lit(16))
    return s.withColumn("t", t).select("t.row", "t.col", F.lit(16).alias("chunk_zoom"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), (F.col("place") % 7 == 0).alias("is_sea"))


@query(
    "WITH x AS (SELECT 1)"
    + _PLACES
    + f""", r AS (SELECT DISTINCT CAST(floor(lat) AS INT) AS a, CAST(floor(lon) AS INT) AS o FROM q), z AS (SELECT CAST(p_lat AS DOUBLE) AS a, CAST(p_lon AS DOUBLE) AS o, p_lat, p_lon FROM s),
t AS (SELECT {sql_row("a", "16")} AS r, {sql_col("o", "16")} AS c, p_lat, p_lon FROM z),
h AS (SELECT r.a, r.o, t.r >> 4 AS "row", t.c >> 4 AS col, CAST((p_lat - CAST(r.a + 0.5 AS FLOAT)) * CAST(60 AS FLOAT) AS FLOAT) AS y,
  CAST(CAST(CAST(p_lon - CAST(r.o + 0.5 AS FLOAT) AS FLOAT) * CAST(60 AS FLOAT) AS FLOAT) * CAST(cos(CAST(CAST(radians(CAST(CAST(r.a + 0.5 AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE)) AS FLOAT) AS FLOAT) AS x
  FROM r JOIN t ON floor(p_lat) = r.a AND floor(p_lon) = r.o),
near AS (SELECT DISTINCT a AS dsf_lat, o AS dsf_lon, "row", col, 12 AS zoom FROM h WHERE CAST(sqrt(CAST(CAST(CAST(y * y AS FLOAT) + CAST(x * x AS FLOAT) AS FLOAT) AS DOUBLE)) AS FLOAT) <= 45),
g AS (SELECT a, o, a + i.range * 0.25::DOUBLE + 0.125::DOUBLE AS lat, o + j.range * 0.25::DOUBLE + 0.125::DOUBLE AS lon FROM r, range(4) i, range(4) j WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.dsf_lat = r.a AND n.dsf_lon = r.o))
SELECT dsf_lat, dsf_lon, CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, zoom FROM near UNION ALL
SELECT DISTINCT a, o, CAST({sql_row("lat", "14")} AS BIGINT), CAST({sql_col("lon", "14")} AS BIGINT), 14 FROM g"""
)
def join_region_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles to plan for the cell of each customer's point."""
    q, _ = _places(spark, sf_dir)
    return index.region_tiles(q.select(geo.degree("lat").alias("dsf_lat"), geo.degree("lon").alias("dsf_lon")), _scenery(spark, sf_dir))


@query(
    cte("tile_requests")
    + f""", t AS (SELECT DISTINCT "row" AS row, col, zoom FROM tile_requests), q AS (SELECT * FROM t), k AS (SELECT DISTINCT {_RC} FROM q),
b AS (SELECT *, {sql_row("(dsf_lat + 1)", "18")} AS r0, {sql_row("dsf_lat", "18")} AS r1, {sql_col("dsf_lon", "18")} AS c0, {sql_col("(dsf_lon + 1)", "18")} AS c1 FROM k)
SELECT dsf_lat, dsf_lon, row AS "row", col, zoom FROM b JOIN t ON row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1"""
)
def join_tiles_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested tiles in the row and column range of each requested cell; a border tile is in two."""
    t = tables.tile_requests(spark, sf_dir).select("row", "col", "zoom").distinct()
    cells = t.select(geo.degree(geo.lat_of("row", "zoom", 0.5)).alias("dsf_lat"), geo.degree(geo.lon_of("col", "zoom", 0.5)).alias("dsf_lon")).distinct()
    return index.files_in_cells(cells, t).select("dsf_lat", "dsf_lon", "row", "col", "zoom")


SQL_OVERLAP = """, h AS (SELECT DISTINCT "row", col FROM tile_refs WHERE zoom = 18), l AS (SELECT * FROM tile_refs WHERE zoom = 16),
o AS (SELECT l.ref_id, 16 AS low, 18 AS high, l."row" AS r, l.col AS c, count(*) AS children, CAST(16 AS BIGINT) AS expected, CASE WHEN count(*) = 16 THEN 'complete' ELSE 'partial' END AS coverage
  FROM l JOIN h ON h."row" >> 2 = l."row" AND h.col >> 2 = l.col GROUP BY ALL)"""


@query(cte("tile_refs") + SQL_OVERLAP + ' SELECT ref_id, low, high, r AS "row", c AS col, children, expected, coverage FROM o')
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(tables.tile_refs(spark, sf_dir))


@query(
    cte("tile_refs")
    + SQL_OVERLAP
    + """ SELECT ref_id, low, high, r AS p_row, c AS p_col, r * 4 + i.range AS "row", c * 4 + j.range AS col FROM o, range(4) i, range(4) j
WHERE coverage = 'partial' AND NOT EXISTS (SELECT 1 FROM h WHERE h."row" = r * 4 + i.range AND h.col = c * 4 + j.range)"""
)
def join_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.gaps(tables.tile_refs(spark, sf_dir))


_HIGHEST = "SELECT DISTINCT ref_id FROM o WHERE coverage = 'complete'"
_LOWEST = """SELECT DISTINCT f.ref_id FROM (SELECT "row", col, min(ref_id) AS ref_id FROM tile_refs WHERE zoom = 18 GROUP BY ALL) f JOIN o ON f."row" >> 2 = r AND f.col >> 2 = c AND coverage = 'complete'"""


@query(cte("tile_refs") + SQL_OVERLAP + " " + _HIGHEST)
def join_resolve_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.removals(tables.tile_refs(spark, sf_dir), "highest")


@query(cte("tile_refs") + SQL_OVERLAP + " " + _LOWEST)
def join_resolve_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.removals(tables.tile_refs(spark, sf_dir), "lowest")


@query(cte("tile_refs") + SQL_OVERLAP + " " + _LOWEST)
def join_resolve_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.removals(tables.tile_refs(spark, sf_dir), 16)


@query(cte("tile_refs") + SQL_OVERLAP + f""", x AS ({_HIGHEST}) SELECT zoom, ref_id IN (SELECT ref_id FROM x) AS removed, count(*) AS tiles FROM tile_refs GROUP BY ALL""")
def join_dedupe_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references split into removed and preserved."""
    t = tables.tile_refs(spark, sf_dir)
    gone = overlap.removals(t, "highest").withColumn("removed", F.lit(True))
    return t.join(gone, "ref_id", "left").groupBy("zoom", F.coalesce("removed", F.lit(False)).alias("removed")).agg(F.count("*").alias("tiles"))


_PACKAGES = """WITH i AS (SELECT 'Region' || (s_suppkey % 40) AS region, CASE WHEN s_suppkey % 2 = 0 THEN 'Z' ELSE 'Y' END AS package_type, max(s_suppkey) AS k FROM supplier GROUP BY ALL),
inst AS (SELECT region, package_type, '1.' || (k % 4) || '.' || (k % 12) AS version FROM i), b AS (SELECT 'REGION' || (c_custkey % 50) AS region, CASE WHEN c_custkey % 3 = 0 THEN 'Z' ELSE 'Y' END AS package_type, max(c_custkey) AS k FROM customer GROUP BY ALL),
lib AS (SELECT region, package_type, '1.' || (k % 3) || '.' || (k % 15) AS version FROM b)"""


def _packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    def of(name: str, key: str, word: str, n: int, two: int, a: int, b: int) -> DataFrame:
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        k = F.col(key)
        g = t.groupBy(F.concat(F.lit(word), (k % n).cast("string")).alias("region"), F.when(k % two == 0, "Z").otherwise("Y").alias("package_type")).agg(F.max(k).alias("k"))
        return g.select("region", "package_type", F.concat(F.lit("1."), (F.col("k") % a).cast("string"), F.lit("."), (F.col("k") % b).cast("string")).alias("version"))

    return of("supplier", "s_suppkey", "Region", 40, 2, 4, 12), of("customer", "c_custkey", "REGION", 50, 3, 3, 15)


@query(
    _PACKAGES
    + """, j AS (SELECT coalesce(inst.region, lib.region) AS region, coalesce(inst.package_type, lib.package_type) AS package_type, inst.version AS a, lib.version AS b FROM inst FULL JOIN lib ON lower(inst.region) = lower(lib.region) AND inst.package_type = lib.package_type)
SELECT region, package_type, coalesce(a, '') AS installed, coalesce(b, '') AS available, CASE WHEN a IS NULL THEN 'not_installed' WHEN b IS NULL THEN 'orphaned'
WHEN list_transform(split(a, '.'), lambda x: CAST(x AS INT)) >= list_transform(split(b, '.'), lambda x: CAST(x AS INT)) THEN 'up_to_date' ELSE 'update_available' END AS status FROM j"""
)
def join_package_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = index.package_status(*_packages(spark, sf_dir))
    return s.select("region", "package_type", *[F.coalesce(c, F.lit("")).alias(c) for c in ("installed", "available")], "status").orderBy(F.lower("region"), "package_type")


@query(
    """WITH e AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'REGION' ELSE 'Region' END || (s_suppkey % 20) AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'Z' ELSE 'Y' END AS package_type, s_suppkey AS url FROM supplier),
m AS (SELECT lower(title) AS k, package_type, max(url) AS url FROM e GROUP BY ALL) SELECT e.title, e.package_type, e.url FROM e JOIN m USING (package_type, url) WHERE lower(title) = k"""
)
def join_library_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    e = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.when(k % 3 == 0, "REGION").otherwise("Region"), (k % 20).cast("string")).alias("title"), F.when(k % 2 == 0, "Z").otherwise("Y").alias("package_type"), k.alias("url"))
    return index.merged_libraries(e, "url").select("title", "package_type", "url")


@query(
    cte("positions")
    + f""", {SQL_BOX}, a AS (SELECT lon0, lon1, unnest(range(CAST(floor(lat0) AS BIGINT), CAST(floor(lat1 - 1e-9) AS BIGINT) + 1)) AS a FROM box WHERE ground_speed < 120),
c AS (SELECT DISTINCT a, unnest(range(CAST(floor(lon0) AS BIGINT), CAST(floor(lon1 - 1e-9) AS BIGINT) + 1)) AS o FROM a), p AS (SELECT DISTINCT floor(lat) AS a, floor(lon) AS o FROM positions WHERE ground_speed >= 240)
SELECT CAST(a AS INT) AS dsf_lat, CAST(o AS INT) AS dsf_lon FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = c.a AND p.o = c.o)"""
)
def join_new_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in the boxes of slow positions that no fast one has been in."""
    p, b = boxes(spark, sf_dir)
    cells = p.where("ground_speed < 120").select(F.inline(box_cells(b))).distinct()
    known = p.where("ground_speed >= 240").select(geo.degree("lat").alias("dsf_lat"), geo.degree("lon").alias("dsf_lon"))
    return index.removed(cells, known, index.CELL)


@query(
    cte("positions")
    + f""", {SQL_BOX}, l AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, seq DESC) AS n FROM box),
a AS (SELECT source_id, lon0, lon1, unnest(range(CAST(floor(lat0) AS BIGINT) - 1, CAST(floor(lat1 - 1e-9) AS BIGINT) + 2)) AS a FROM l WHERE n = 1),
c AS (SELECT source_id, a, unnest(range(CAST(floor(lon0) AS BIGINT) - 1, CAST(floor(lon1 - 1e-9) AS BIGINT) + 2)) AS o FROM a) SELECT source_id, CAST(a AS INT) AS dsf_lat, CAST(o AS INT) AS dsf_lon FROM c"""
)
def join_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source retains after its last update: the box around it and one cell more on each side."""
    p, _ = boxes(spark, sf_dir)
    last = p.groupBy("source_id").agg(F.max(F.struct("ts", "seq", "lat", "lon", "heading", "ground_speed")).alias("l")).select("source_id", "l.*")
    from tesserae.functions.generate import box

    b = box("lat", "lon", "heading", geo.extent("ground_speed"))
    return last.select("source_id", F.inline(box_cells(b, 1)))


_STATES = """, pre AS (SELECT floor(lat) AS a, floor(lon) AS o, CASE min(seq) % 3 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'prefetched' ELSE 'no_coverage' END AS state FROM positions WHERE ground_speed < 160 GROUP BY ALL),
act AS (SELECT floor(lat) AS a, floor(lon) AS o, count(*) FILTER (seq % 4 = 0) AS fh, count(*) FILTER (seq % 4 = 1) AS fg, count(*) FILTER (seq % 4 = 2) AS ph, count(*) FILTER (seq % 4 = 3) AS pg FROM positions WHERE ground_speed BETWEEN 100 AND 300 GROUP BY ALL),
pat AS (SELECT DISTINCT floor(lat) AS a, floor(lon) AS o FROM positions WHERE ground_speed BETWEEN 280 AND 400), ret AS (SELECT DISTINCT floor(lat) AS a, floor(lon) AS o FROM positions WHERE ground_speed > 380)"""
#: The cells' states as the table layers, after _STATES.
SQL_STATES = """, j AS (SELECT a, o, state, fh, fg, ph, pg, pat.a IS NOT NULL AS p, ret.a IS NOT NULL AS r FROM (SELECT a, o FROM pre UNION SELECT a, o FROM act UNION SELECT a, o FROM pat UNION SELECT a, o FROM ret) k
  LEFT JOIN pre USING (a, o) LEFT JOIN act USING (a, o) LEFT JOIN pat USING (a, o) LEFT JOIN ret USING (a, o)),
s AS (SELECT *, CASE WHEN state = 'prefetched' AND fh + fg > 0 THEN 'mixed' ELSE coalesce(state, CASE WHEN fh + fg > 0 AND ph + pg > 0 THEN 'mixed' WHEN fh + fg > 0 THEN 'fuse_loaded' WHEN ph + pg > 0 THEN 'prefetched' END,
  CASE WHEN p THEN 'patched' END, CASE WHEN r THEN 'retained' END) END AS s FROM j),
layers AS (SELECT CAST(a AS INT) AS dsf_lat, CAST(o AS INT) AS dsf_lon, s AS state, CAST(coalesce(fh, 0) AS BIGINT) AS fuse_hits, CAST(coalesce(fg, 0) AS BIGINT) AS fuse_misses, CAST(coalesce(pg, 0) AS BIGINT) AS prefetch_generated FROM s)"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    p = tables.positions(spark, sf_dir).withColumns({"dsf_lat": geo.degree("lat"), "dsf_lon": geo.degree("lon")})
    k = F.pmod(F.min("seq"), F.lit(3))
    pre = p.where("ground_speed < 160").groupBy(*index.CELL).agg(F.when(k == 0, "in_progress").when(k == 1, "prefetched").otherwise("no_coverage").alias("state"))
    names = ["fuse_cache_hits", "fuse_generated", "prefetch_cache_hits", "prefetch_generated"]
    act = p.where("ground_speed between 100 and 300").groupBy(*index.CELL).agg(*[F.count_if(F.col("seq") % 4 == i).alias(n) for i, n in enumerate(names)])
    return pre, act, p.where("ground_speed between 280 and 400").select(*index.CELL), p.where("ground_speed > 380").select(*index.CELL)


@query(
    cte("positions")
    + _STATES
    + SQL_STATES
    + " SELECT * FROM layers"
)
def join_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each cell that any of four layers knows."""
    return index.region_states(*_states(spark, sf_dir))


@query(
    cte("positions")
    + _STATES
    + """ SELECT CAST(a AS INT) AS dsf_lat, CAST(o AS INT) AS dsf_lon, state FROM pre WHERE state = 'in_progress' OR EXISTS (SELECT 1 FROM act WHERE act.a = pre.a AND act.o = pre.o)"""
)
def join_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of the prefetched cells when those with activity are retained."""
    pre, act, _, _ = _states(spark, sf_dir)
    return index.kept_regions(pre, act)


@query(
    cte("tile_requests")
    + f""", t AS (SELECT DISTINCT "row" AS row, col, zoom FROM tile_requests), q AS (SELECT * FROM t), k AS (SELECT q.*, {_RC} FROM q), d AS (SELECT DISTINCT "row" AS row, col, zoom FROM tile_requests WHERE (col - 138240) % 2560 <> 0)
SELECT dsf_lat, dsf_lon FROM k LEFT JOIN d USING (row, col, zoom) GROUP BY dsf_lat, dsf_lon HAVING count(*) = count(d.row)"""
)
def join_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of which all requested tiles are on disk."""
    r = tables.tile_requests(spark, sf_dir)
    t = r.select("row", "col", "zoom").distinct()
    t = t.withColumns({"dsf_lat": geo.degree(geo.lat_of("row", "zoom", 0.5)), "dsf_lon": geo.degree(geo.lon_of("col", "zoom", 0.5))})
    return index.all_present(t, r.where("(col - 138240) % 2560 <> 0"))


@query(cte("cache_entries") + """ SELECT "row" % 64 AS "row", col % 64 AS col, max(entry_id) AS entry_id, max_by(size_bytes, entry_id) AS size_bytes FROM cache_entries GROUP BY 1, 2""")
def join_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer populated from one half of the entries and changed by the other: the last write of each key stays."""
    e = tables.cache_entries(spark, sf_dir).select((F.col("row") % 64).alias("row"), (F.col("col") % 64).alias("col"), "entry_id", "size_bytes")
    return index.upserted(e.where("entry_id % 2 = 0"), e.where("entry_id % 2 = 1"), ["row", "col"], "entry_id")


@query(
    cte("tile_requests")
    + """, e AS (SELECT *, epoch_us(ts) AS t0, epoch_us(ts) + 2000000 + (seq % 50) * 1000000 AS t1 FROM tile_requests),
m AS (SELECT *, max(t1) OVER (PARTITION BY "row", col ORDER BY t0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM e)
SELECT seq, coalesce(busy > t0, FALSE) AS coalesced FROM m"""
)
def join_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request meets one for the same tile that is still in flight."""
    from pyspark.sql.window import Window

    e = tables.tile_requests(spark, sf_dir).withColumn("t0", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("t1", F.col("t0") + 2_000_000 + F.col("seq") % 50 * 1_000_000)
    w = Window.partitionBy("row", "col").orderBy("t0", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("seq", F.coalesce(F.max("t1").over(w) > F.col("t0"), F.lit(False)).alias("coalesced"))
