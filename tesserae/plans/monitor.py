"""The debug map, the position log, addresses of chunks, and cells whose plan was submitted whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import geo, text
from tesserae.operators import index, monitor
from tesserae.plans.agg import with_cells
from tesserae.plans.fsm import _T, timed
from tesserae.plans.geo import sql_lat, sql_lon
from tesserae.plans.join import _STATES, SQL_STATES, _states
from tesserae.registry import query
from tesserae.sources import tables
from tesserae.sources.tables import cte

_LAT, _LON = sql_lat('"row"', "zoom", 0.5), sql_lon("col", "zoom", 0.5)


@query(
    cte("positions", "tile_requests", "metric_events")
    + _STATES
    + SQL_STATES
    + f""", air AS (SELECT lat, lon, heading, seq, ground_speed AS gs FROM positions ORDER BY seq DESC LIMIT 1), x AS (SELECT *, 3.5 + 3.5 * least(greatest((gs - 40) / 410, 0), 1) AS e FROM air),
r AS (SELECT *, row_number() OVER (ORDER BY dsf_lat, dsf_lon) AS i, count(*) OVER () AS m FROM layers),
t AS (SELECT "row", col, zoom, arg_max(CASE WHEN seq % 2 = 0 THEN 'fuse' ELSE 'prefetch' END, (ts, seq)) AS origin, arg_max(seq % 3 = 0, (ts, seq)) AS hit FROM tile_requests GROUP BY "row", col, zoom),
u AS (SELECT *, {_LAT} AS lat, {_LON} AS lon, row_number() OVER (ORDER BY "row", col, zoom) AS i, count(*) OVER () AS m FROM t),
st AS (SELECT count(*) FILTER (event_type = 'memory_cache_hit') / count(*) FILTER (event_type IN ('memory_cache_hit', 'memory_cache_miss')) AS rate, count(*) FILTER (event_type = 'job_submitted') AS sub, count(*) FILTER (event_type = 'download_failed') AS def FROM metric_events),
d(s, i, line) AS (SELECT 0, 0, '{{' UNION ALL SELECT 1, 0, printf('"aircraft":{{"latitude":%.6f,"longitude":%.6f,"heading":%.6f,"track":%s,"ground_speed":%.6f,"altitude":%.6f}},', lat, lon, heading, CASE WHEN seq % 2 = 0 THEN printf('%.6f', heading) ELSE 'null' END, gs, gs * 20) FROM air
UNION ALL SELECT 2, 0, concat('"sim_state":{{"paused":', CASE WHEN seq % 3 = 0 THEN 'true' ELSE 'false' END, ',"on_ground":', CASE WHEN gs < 40 THEN 'true' ELSE 'false' END, ',"scenery_loading":false,"replay":false,"sim_speed":', 1 + seq % 4, '}},') FROM air
UNION ALL SELECT 3, 0, printf('"prefetch_box":{{"lat_min":%.6f,"lat_max":%.6f,"lon_min":%.6f,"lon_max":%.6f}},', lat - e / 2, lat + e / 2, lon - e / 2, lon + e / 2) FROM x
UNION ALL SELECT 4, 0, '"regions":['
UNION ALL SELECT 5, i, concat('{{"lat":', dsf_lat, ',"lon":', dsf_lon, ',"state":"', state, '"', CASE WHEN fuse_hits <> 0 THEN concat(',"fuse_hits":', fuse_hits) ELSE '' END, CASE WHEN fuse_misses <> 0 THEN concat(',"fuse_misses":', fuse_misses) ELSE '' END,
  CASE WHEN prefetch_generated <> 0 THEN concat(',"prefetch_generated":', prefetch_generated) ELSE '' END, '}}', CASE WHEN i < m THEN ',' ELSE '' END) FROM r
UNION ALL SELECT 6, 0, '],' UNION ALL SELECT 7, 0, '"tiles":['
UNION ALL SELECT 8, i, concat(printf('{{"row":%d,"col":%d,"zoom":%d,"lat":%.6f,"lon":%.6f,"origin":"', "row", col, zoom, lat, lon), origin, '","result":"', CASE WHEN hit THEN 'cache_hit' ELSE 'generated' END, '"}}', CASE WHEN i < m THEN ',' ELSE '' END) FROM u
UNION ALL SELECT 9, 0, '],' UNION ALL SELECT 10, 0, printf('"stats":{{"memory_cache_hit_rate":%.6f,"tiles_submitted":%d,"deferred_cycles":%d,"prefetch_mode":"Opportunistic","active_strategy":""}}', CAST(rate AS DOUBLE), sub, def) FROM st
UNION ALL SELECT 11, 0, '}}') SELECT row_number() OVER (ORDER BY s, i) - 1 AS n, line FROM d"""
)
def report_debug_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The debug map of all cells and tiles, around the last position."""
    p = tables.positions(spark, sf_dir).agg(F.max_by(F.struct("seq", "lat", "lon", "heading", "ground_speed"), "seq").alias("p")).where("p is not null").select("p.*")
    air = p.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "heading", F.when(F.col("seq") % 2 == 0, F.col("heading")).alias("track"), "ground_speed", (F.col("ground_speed") * 20).alias("altitude"))
    no = F.lit(False)
    sim = p.select((F.col("seq") % 3 == 0).alias("paused"), (F.col("ground_speed") < 40).alias("on_ground"), no.alias("scenery_loading"), no.alias("replay"), (F.col("seq") % 4 + 1).alias("sim_speed"))
    half = geo.extent("ground_speed") / 2
    box = p.select((F.col("lat") - half).alias("lat_min"), (F.col("lat") + half).alias("lat_max"), (F.col("lon") - half).alias("lon_min"), (F.col("lon") + half).alias("lon_max"))
    last = F.struct("ts", "seq")
    t = tables.tile_requests(spark, sf_dir).groupBy("row", "col", "zoom").agg(F.max_by(F.when(F.col("seq") % 2 == 0, "fuse").otherwise("prefetch"), last).alias("origin"), F.max_by(F.col("seq") % 3 == 0, last).alias("hit"))
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    rate = n("memory_cache_hit") / n("memory_cache_hit", "memory_cache_miss")
    stats = tables.metric_events(spark, sf_dir).agg(rate.alias("memory_cache_hit_rate"), n("job_submitted").alias("tiles_submitted"), n("download_failed").alias("deferred_cycles"), F.lit("Opportunistic").alias("prefetch_mode"), F.lit("").alias("active_strategy"))
    return monitor.debug_map(air, sim, box, index.region_states(*_states(spark, sf_dir)), t, stats)


@query(
    cte("positions")
    + _T
    + """, f AS (SELECT source_id, t * 3 AS t, arg_max(e, seq) AS p FROM e GROUP BY source_id, t), k AS (SELECT source_id, unnest(range(0, CAST(floor(max(t) / 20) AS BIGINT) + 1)) AS tick FROM f GROUP BY source_id)
SELECT k.source_id, tick, CASE WHEN p IS NULL THEN 'APT position update (no position data) telemetry=Disconnected' ELSE
printf('APT position update lat="%.5f" lon="%.5f" hdg="%.1f" gs_kt="%.0f" alt_ft="%.0f" accuracy_m="%.0f" source=%s telemetry=%s dsf_tile=%+03d%+04d', p.lat, p.lon, p.heading, p.ground_speed, p.ground_speed * 20, CASE WHEN p.seq % 2 = 0 THEN 10.0::DOUBLE ELSE 100.0::DOUBLE END,
  CASE WHEN p.seq % 2 = 0 THEN 'Telemetry' ELSE 'Manual' END, CASE WHEN tick * 20 - t <= 5 THEN 'Connected' ELSE 'Disconnected' END, CAST(floor(p.lat) AS INT), CAST(floor(p.lon) AS INT)) END AS line
FROM k ASOF LEFT JOIN f ON k.source_id = f.source_id AND CAST(tick * 20 AS DOUBLE) >= f.t"""
)
def report_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's position every 20 seconds."""
    even = F.col("seq") % 2 == 0
    d = timed(spark, sf_dir).withColumns({"t": F.col("t") * 3, "altitude": F.col("ground_speed") * 20, "accuracy": F.when(even, 10.0).otherwise(100.0), "source": F.when(even, "Telemetry").otherwise("Manual")})
    return monitor.position_log(d)


_TOKEN = "made"


@query(
    cte("tile_requests")
    + f""", q AS (SELECT *, list_reduce(list_transform(range(zoom, 0, -1), lambda i: CAST((("row" >> (i - 1)) & 1) * 2 + ((col >> (i - 1)) & 1) AS VARCHAR)), lambda a, b: a || b) AS k FROM tile_requests)
SELECT seq, CASE seq % 7 WHEN 0 THEN concat('https://ecn.t0.tiles.virtualearth.net/tiles/a', k, '.jpeg?g=1') WHEN 1 THEN concat('https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/', zoom, '/', "row", '/', col)
WHEN 2 THEN concat('https://basemap.nationalmap.gov/arcgis/rest/services/USGSImageryOnly/MapServer/tile/', zoom, '/', "row", '/', col) WHEN 3 THEN concat('https://api.mapbox.com/v4/mapbox.satellite/', zoom, '/', col, '/', "row", '.jpg?access_token={_TOKEN}')
WHEN 4 THEN concat('https://tile.googleapis.com/v1/2dtiles/', zoom, '/', col, '/', "row", '?session=s1&key={_TOKEN}') WHEN 5 THEN concat('https://sat-cdn.apple-mapkit.com/tile?style=7&size=1&scale=1&z=', zoom, '&x=', col, '&y=', "row", '&v=s1&accessKey={_TOKEN}') END AS url FROM q"""
)
def name_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of a chunk's picture at each provider; null for one that is not known."""
    names = ["bing", "arcgis", "usgs", "mapbox", "google", "apple", "nobody"]
    r = tables.tile_requests(spark, sf_dir).withColumn("p", F.element_at(F.array(*map(F.lit, names)), (F.col("seq") % 7 + 1).cast("int")))
    return r.select("seq", text.chunk_url(F.col("p"), F.col("row"), F.col("col"), F.col("zoom"), geo.quadkey("row", "col", "zoom"), _TOKEN, "s1").alias("url"))


@query(
    cte("tile_requests")
    + f""", c AS (SELECT session_id AS cycle, "row", col, zoom, CAST(floor({_LAT}) AS INT) AS dsf_lat, CAST(floor({_LON}) AS INT) AS dsf_lon, max(CASE WHEN seq % 9 <> 0 THEN 1 ELSE 0 END) AS s FROM tile_requests GROUP BY ALL)
SELECT cycle, dsf_lat, dsf_lon, count(*) AS tiles FROM c WHERE cycle % 7 <> 0 GROUP BY cycle, dsf_lat, dsf_lon HAVING min(s) = 1"""
)
def join_fully_submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose planned tiles were all taken by the cycle that planned them; a deferred cycle marks none."""
    r = tables.tile_requests(spark, sf_dir).withColumn("cycle", F.col("session_id"))
    return index.fully_submitted(with_cells(r), r.where(F.col("seq") % 9 != 0), r.where(F.col("cycle") % 7 == 0))
