"""Reports of deduplication and of gaps, line by line in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import geo
from tesserae.operators import overlap, reports
from tesserae.plans.geo import sql_lat, sql_lon
from tesserae.plans.join import SQL_OVERLAP
from tesserae.registry import query
from tesserae.sources import tables
from tesserae.sources.tables import cte

_REMOVED = (
    cte("tile_refs")
    + SQL_OVERLAP
    + """, x AS (SELECT *, concat("row", '_', col, '_', provider, zoom, '.ter') AS path, row_number() OVER (PARTITION BY zoom ORDER BY "row", col, ref_id) AS i, count(*) OVER (PARTITION BY zoom) AS m
  FROM tile_refs WHERE ref_id IN (SELECT ref_id FROM o WHERE coverage = 'complete')),
z AS (SELECT zoom, count(*) AS m, lead(zoom) OVER (ORDER BY zoom) IS NOT NULL AS more FROM x GROUP BY zoom),
p AS (SELECT high, low, count(*) AS m, lead(high) OVER (ORDER BY high, low) IS NOT NULL AS more FROM o GROUP BY high, low),
t AS (SELECT count(*) AS tiles, '[' || array_to_string(list_sort(list_distinct(list(zoom))), ', ') || ']' AS zooms, (SELECT count(*) FROM x) AS gone, (SELECT count(*) FROM p) AS pairs,
  (SELECT coalesce(sum(CASE WHEN zoom BETWEEN 12 AND 14 THEN 102400 WHEN zoom BETWEEN 15 AND 16 THEN 307200 WHEN zoom BETWEEN 17 AND 18 THEN 819200 WHEN zoom = 19 THEN 1536000 ELSE 204800 END), 0) FROM x) AS saved FROM tile_refs)"""
)
_NUMBERED = "SELECT row_number() OVER (ORDER BY s, k, j, i) - 1 AS n, line FROM d"


@query(
    _REMOVED
    + """, d(s, k, j, i, line) AS (SELECT 0, 0, 0, 0, '{'
UNION ALL SELECT 1, 0, 0, 0, '  "tiles_analyzed": ' || tiles || ',' FROM t
UNION ALL SELECT 2, 0, 0, 0, '  "zoom_levels_present": ' || zooms || ',' FROM t
UNION ALL SELECT 3, 0, 0, 0, '  "overlaps_by_pair": {'
UNION ALL SELECT 4, 0, 0, 0, '' FROM t WHERE pairs = 0
UNION ALL SELECT 4, high, low, 0, concat('    "', high, '-', low, '": ', m, CASE WHEN more THEN ',' ELSE '' END) FROM p
UNION ALL SELECT 5, 0, 0, 0, '  },'
UNION ALL SELECT 6, 0, 0, 0, '  "tiles_removed_count": ' || gone || ',' FROM t
UNION ALL SELECT 7, 0, 0, 0, '  "tiles_preserved_count": ' || (tiles - gone) || ',' FROM t
UNION ALL SELECT 8, 0, 0, 0, '  "dry_run": true,'
UNION ALL SELECT 9, 0, 0, 0, '  "priority_mode": "highest",'
UNION ALL SELECT 10, 0, 0, 0, '  "tile_filter": null,'
UNION ALL SELECT 11, 0, 0, 0, '  "removed_by_zoom": {'
UNION ALL SELECT 12, 0, 0, 0, '' FROM t WHERE gone = 0
UNION ALL SELECT 12, zoom, 0, 0, '    "ZL' || zoom || '": [' FROM z
UNION ALL SELECT 12, zoom, 1, i, '        "' || path || '"' || CASE WHEN i < m THEN ',' ELSE '' END FROM x
UNION ALL SELECT 12, zoom, 2, 0, '    ]' || CASE WHEN more THEN ',' ELSE '' END FROM z
UNION ALL SELECT 13, 0, 0, 0, '  }' UNION ALL SELECT 14, 0, 0, 0, '}') """
    + _NUMBERED
)
def report_dedupe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dedupe_json(tables.tile_refs(spark, sf_dir), "highest", True, "highest")


@query(
    _REMOVED
    + """, d(s, k, j, i, line) AS (SELECT 0, 0, 0, i, l FROM (SELECT unnest(['Deduplication Audit Report', '==========================', '', 'Configuration', '-------------', 'Priority mode: highest', 'Dry run: false',
  'Tile filter: 10,-20', '', 'Summary', '-------', 'Tiles analyzed: ' || tiles, 'Zoom levels: ' || zooms, 'Tiles removed: ' || gone, 'Tiles preserved: ' || (tiles - gone), '', 'Overlaps Detected', '-----------------']) AS l,
  unnest(range(18)) AS i FROM t)
UNION ALL SELECT 1, 0, 0, 0, '  No overlapping tiles found.' FROM t WHERE pairs = 0
UNION ALL SELECT 1, high, low, 0, concat('  ZL', high, ' overlaps ZL', low, ': ', m, ' tiles') FROM p
UNION ALL SELECT 2, 0, 0, 0, ''
UNION ALL SELECT 3, 0, 0, i, l FROM (SELECT unnest(['Removed Tiles by Zoom Level', '---------------------------']) AS l, unnest(range(2)) AS i FROM t WHERE gone > 0)
UNION ALL SELECT 4, zoom, 0, 0, '' FROM z UNION ALL SELECT 4, zoom, 1, 0, concat('  ZL', zoom, ' (', m, ' tiles):') FROM z
UNION ALL SELECT 4, zoom, 2, i, concat('    (', "row", ', ', col, ') - ', path) FROM x WHERE i <= 50
UNION ALL SELECT 4, zoom, 3, 0, concat('    ... and ', m - 50, ' more') FROM z WHERE m > 50
UNION ALL SELECT 5, 0, 0, i, l FROM (SELECT unnest(['', 'Estimated Space Savings', '-----------------------', '  ~' || CASE WHEN saved >= 1073741824 THEN printf('%.2f GB', saved / 1073741824) WHEN saved >= 1048576 THEN printf('%.2f MB', saved / 1048576)
  WHEN saved >= 1024 THEN printf('%.2f KB', saved / 1024) ELSE concat(saved, ' bytes') END || ' (estimated)', '']) AS l, unnest(range(5)) AS i FROM t WHERE gone > 0)) """
    + _NUMBERED
)
def report_dedupe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dedupe_text(tables.tile_refs(spark, sf_dir), "highest", False, "highest", (10, -20))


_MISSING = (
    cte("tile_refs")
    + SQL_OVERLAP
    + f""", m AS (SELECT ref_id, r, c, r * 4 + i.range AS "row", c * 4 + j.range AS col, 18 AS zoom,
  CAST(CAST({sql_lat("r", "16", 0.5)} AS FLOAT) - CAST((CAST(i.range AS FLOAT) - CAST(2 AS FLOAT) + CAST(0.5 AS FLOAT)) / CAST(4 AS FLOAT) * CAST(0.5 AS FLOAT) AS FLOAT) AS FLOAT) AS lat,
  CAST(CAST({sql_lon("c", "16", 0.5)} AS FLOAT) + CAST((CAST(j.range AS FLOAT) - CAST(2 AS FLOAT) + CAST(0.5 AS FLOAT)) / CAST(4 AS FLOAT) * CAST(0.5 AS FLOAT) AS FLOAT) AS FLOAT) AS lon
  FROM o, range(4) i, range(4) j WHERE coverage = 'partial' AND NOT EXISTS (SELECT 1 FROM h WHERE h."row" = r * 4 + i.range AND h.col = c * 4 + j.range))"""
)


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = overlap.gaps(tables.tile_refs(spark, sf_dir))
    side = F.pow(F.lit(2.0), F.col("high") - F.col("low")).cast("long")
    above = geo.lat_of("p_row", "low", 0.5), geo.lon_of("p_col", "low", 0.5)
    lat, lon = overlap.missing_centre(*above, F.col("row"), F.col("col"), side)
    parent = [F.col("low").alias("p_zoom"), "p_row", "p_col", above[0].cast("float").alias("p_lat"), above[1].cast("float").alias("p_lon")]
    return g.select("ref_id", "row", "col", F.col("high").alias("zoom"), lat.alias("lat"), lon.alias("lon"), *parent)


@query(
    _MISSING
    + """, d AS (SELECT 0 AS s, i AS lat, 0 AS lon, l AS line FROM (SELECT unnest(['# Ortho4XP Missing Tile Coordinates', '# ==================================', concat('# Generated for ', count(DISTINCT ref_id), ' gaps, ', count(*), ' missing tiles'), '#',
  '# Format: latitude, longitude, zoom_level', '# Use these coordinates to regenerate tiles in Ortho4XP', '#', '']) AS l, unnest(range(8)) AS i FROM m)
UNION ALL SELECT 1, lat, lon, printf('%.4f, %.4f, %d', CAST(lat AS DOUBLE), CAST(lon AS DOUBLE), zoom) FROM m) SELECT row_number() OVER (ORDER BY s, lat, lon, line) - 1 AS n, line FROM d"""
)
def report_gap_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gap_coordinates(_missing(spark, sf_dir))


@query(
    _MISSING
    + """, g AS (SELECT floor(lat) AS y, floor(lon) AS x, count(*) AS m FROM m GROUP BY ALL), d AS (SELECT 0 AS s, i AS y, 0 AS x, l AS line FROM (SELECT unnest(['Missing Tiles by 1°×1° Cell', '===========================', '']) AS l, unnest(range(3)) AS i)
UNION ALL SELECT 1, y, x, concat(CASE WHEN y >= 0 THEN '+' ELSE '-' END, printf('%02d', CAST(abs(y) AS INT)), CASE WHEN x >= 0 THEN '+' ELSE '-' END, printf('%03d', CAST(abs(x) AS INT)), ': ', m, ' missing ZL18 tiles') FROM g)
SELECT row_number() OVER (ORDER BY s, y, x) - 1 AS n, line FROM d"""
)
def report_gap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gap_cells(_missing(spark, sf_dir))


_TOTALS = """, t AS (SELECT count(*) AS tiles, '[' || array_to_string(list_sort(list_distinct(list(zoom))), ', ') || ']' AS zooms, (SELECT count(*) FROM m) AS gone, (SELECT count(DISTINCT ref_id) FROM m) AS gaps FROM tile_refs)"""


@query(
    _MISSING
    + _TOTALS
    + """, x AS (SELECT *, row_number() OVER (ORDER BY ref_id, "row", col) AS i FROM m),
d(s, k, j, i, line) AS (SELECT 0, 0, 0, i, l FROM (SELECT unnest(['{', '  "tiles_analyzed": ' || tiles || ',', '  "zoom_levels_present": ' || zooms || ',', '  "gaps_count": ' || gaps || ',', '  "total_missing_tiles": ' || gone || ',',
  '  "tile_filter": null,', '  "missing_tiles": [']) AS l, unnest(range(7)) AS i FROM t)
UNION ALL SELECT 1, 0, 0, 0, '' FROM t WHERE gone = 0
UNION ALL SELECT 1, 0, 0, i, printf('    { "row": %d, "col": %d, "zoom": %d, "lat": %.4f, "lon": %.4f }', "row", col, zoom, CAST(lat AS DOUBLE), CAST(lon AS DOUBLE)) || CASE WHEN i < gone THEN ',' ELSE '' END FROM x, t
UNION ALL SELECT 2, 0, 0, 0, '  ]' UNION ALL SELECT 3, 0, 0, 0, '}') """
    + _NUMBERED
)
def report_gap_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gap_json(tables.tile_refs(spark, sf_dir), _missing(spark, sf_dir))


@query(
    _MISSING
    + _TOTALS
    + f""", x AS (SELECT ref_id, any_value(r) AS r, any_value(c) AS c, count(*) AS m, row_number() OVER (ORDER BY ref_id) AS i FROM m GROUP BY ref_id QUALIFY i <= 20),
d(s, k, j, i, line) AS (SELECT 0, 0, 0, i, l FROM (SELECT unnest(['Coverage Gap Analysis Report', '============================', '', 'Summary', '-------', 'Tiles analyzed: ' || tiles, 'Zoom levels: ' || zooms, 'Gaps found: ' || gaps,
  'Total missing tiles: ' || gone, 'Tile filter: 7,8', '', concat('Estimated download size: ~', CASE WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824) WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576) ELSE concat(b, ' bytes') END, ' (to generate missing tiles)'), '']) AS l,
  unnest(range(13)) AS i FROM (SELECT *, gone * 13107200 AS b FROM t))
UNION ALL SELECT 1, 0, 0, i, l FROM (SELECT unnest(['Gap Details', '-----------']) AS l, unnest(range(2)) AS i FROM t WHERE gaps > 0)
UNION ALL SELECT 2, i, 0, 0, '' FROM x
UNION ALL SELECT 2, i, 1, 0, printf('%d. Parent ZL16 (%d, %d) at %.2f,%.2f:', i, r, c, CAST(CAST({sql_lat("r", "16", 0.5)} AS FLOAT) AS DOUBLE), CAST(CAST({sql_lon("c", "16", 0.5)} AS FLOAT) AS DOUBLE)) FROM x
UNION ALL SELECT 2, i, 2, 0, printf('   Coverage: %d/16 (%.1f%%)', 16 - m, CAST((16 - m) / 16 * 100 AS DOUBLE)) FROM x UNION ALL SELECT 2, i, 3, 0, concat('   Missing ', m, ' tiles') FROM x
UNION ALL SELECT 3, 0, 0, i, l FROM (SELECT unnest(['', concat('... and ', gaps - 20, ' more gaps')]) AS l, unnest(range(2)) AS i FROM t WHERE gaps > 20)
UNION ALL SELECT 4, 0, 0, 0, '' FROM t WHERE gaps > 0) """
    + _NUMBERED
)
def report_gap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gap_text(tables.tile_refs(spark, sf_dir), _missing(spark, sf_dir), (7, 8))


@query(
    f"""WITH e AS (SELECT 'Region' || (s_suppkey % 40) AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'Z' ELSE 'Y' END AS kind, concat(md5(s_name), '  ', CASE WHEN s_suppkey % 2 = 0 THEN 'Z' ELSE 'Y' END, '  Region', s_suppkey % 40, '  1.', s_suppkey % 4, '.0  http://made/', s_suppkey) AS line FROM supplier),
d AS (SELECT 0 AS s, i, '' AS title, '' AS kind, l AS line FROM (SELECT unnest(['MADE {reports.LIST_HEAD}', '1.0.0', 'WORLD', '3', '2025-01-01T00:00:00Z', CAST((SELECT count(*) FROM e) AS VARCHAR), '', '']) AS l, unnest(range(8)) AS i)
UNION ALL SELECT 1, 0, title, kind, line FROM e) SELECT row_number() OVER (ORDER BY s, i, encode(title), kind, encode(line)) - 1 AS n, line FROM d"""
)
def report_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package list of the suppliers' packages, as its lines."""
    k = F.col("s_suppkey")
    text = lambda x: x.cast("string")
    kind = F.when(k % 2 == 0, "Z").otherwise("Y")
    e = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.md5("s_name").alias("checksum"), kind.alias("package_type"), F.concat(F.lit("Region"), text(k % 40)).alias("title"), F.concat(F.lit("1."), text(k % 4), F.lit(".0")).alias("version"), F.concat(F.lit("http://made/"), text(k)).alias("metadata_url"))
    return reports.library_lines(e, "MADE", "WORLD", 3, "2025-01-01T00:00:00Z")
