"""Cycles that depend on what the one before left, and tracks that depend on the way flown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import generate, geo
from tesserae.operators import carry, flight, state
from tesserae.plans.agg import _LAT, _LON, with_cells
from tesserae.plans.flight import _ACC, _KIND, _KINDS
from tesserae.plans.fsm import PHASES, _T, timed
from tesserae.registry import query
from tesserae.sources import tables
from tesserae.sources.tables import cte

_EXTENT = 4.0
_PART = lambda f: f"(0.5 + 0.3::DOUBLE * abs({f}(radians(heading))))"
_LOW = lambda x, f: f"{x} - 4.0::DOUBLE * CASE WHEN {f}(radians(heading)) >= 0 THEN 1 - {_PART(f)} ELSE {_PART(f)} END"
_HIGH = lambda x, f: f"{x} + 4.0::DOUBLE * CASE WHEN {f}(radians(heading)) >= 0 THEN {_PART(f)} ELSE 1 - {_PART(f)} END"


@query(
    "WITH RECURSIVE "
    + cte("positions", "tile_requests", "cache_entries")[5:]
    + _T
    + f""", g AS (SELECT source_id, seq, n, t, ground_speed AS knots, ground_speed * 20 AS msl FROM e), {PHASES},
h AS (SELECT source_id, seq, CASE mode WHEN 'idle' THEN 1 WHEN 'held' THEN 0 ELSE 0.25::DOUBLE + (t - ts) / 30 * 0.75::DOUBLE END AS share, phase FROM f),
l AS (SELECT a, o, min(since) AS gone FROM (
  SELECT CAST(floor({_LAT}) AS INT) AS a, CAST(floor({_LON}) AS INT) AS o, CAST(ts AS TIMESTAMP) AS since FROM tile_requests
  UNION ALL SELECT CAST(floor({_LAT}) AS INT), CAST(floor({_LON}) AS INT), CAST(last_accessed AS TIMESTAMP) FROM cache_entries) GROUP BY ALL),
b AS (SELECT source_id, seq, lat, lon, {_LOW('lat', 'cos')} AS s, {_HIGH('lat', 'cos')} AS n, {_LOW('lon', 'sin')} AS w, {_HIGH('lon', 'sin')} AS e FROM positions),
b1 AS (SELECT *, unnest(range(CAST(floor(s) AS INT), CAST(floor(n - 1e-9::DOUBLE) AS INT) + 1)) AS a FROM b),
b2 AS (SELECT *, unnest(range(CAST(floor(w) AS INT), CAST(floor(e - 1e-9::DOUBLE) AS INT) + 1)) AS o FROM b1),
c0 AS (SELECT source_id, seq, b2.a, b2.o, gone, (lat - (b2.a + 0.5::DOUBLE)) * (lat - (b2.a + 0.5::DOUBLE)) + (lon - (b2.o + 0.5::DOUBLE)) * (lon - (b2.o + 0.5::DOUBLE)) AS d FROM b2 LEFT JOIN l ON l.a = b2.a AND l.o = b2.o),
c1 AS (SELECT source_id, seq, list({{'a': a, 'o': o, 'gone': gone}} ORDER BY d, a, o) AS cells FROM c0 GROUP BY ALL),
c AS MATERIALIZED (SELECT e.source_id, e.seq, e.n, CAST(e.ts AS TIMESTAMP) AS now, ground_speed / 480 AS load, ground_speed >= 30 AS opens, cells, share, phase FROM e JOIN c1 USING (source_id, seq) JOIN h USING (source_id, seq)),
z AS (SELECT DISTINCT source_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS phase, '' AS strategy, CAST(0 AS BIGINT) AS considered, CAST(0 AS BIGINT) AS planned, CAST([] AS STRUCT(a INT, o INT, gone TIMESTAMP)[]) AS out, CAST([] AS STRUCT(a INT, o INT, gone TIMESTAMP)[]) AS pending, FALSE AS deferred FROM c
 UNION ALL
 SELECT source_id, n, seq, phase, strategy, considered, planned, plan[1:most], plan[most + 1:], deferred FROM (
  SELECT *, CASE WHEN deferred THEN 0 WHEN share < 1 THEN CAST(ceil(m * share) AS BIGINT) ELSE m END AS most FROM (
   SELECT *, len(plan) AS planned, load > 0.8 AND len(plan) > 0 AS deferred, CASE WHEN load > 0.5 THEN CAST(ceil(len(plan) * 0.5::DOUBLE) AS BIGINT) ELSE len(plan) END AS m FROM (
    SELECT *, len(cells) AS considered, list_filter(cells, lambda x: x.gone IS NULL OR x.gone > now) AS plan FROM (
     SELECT c.source_id, c.n, c.seq, c.now, c.load, c.share, c.phase, CASE WHEN len(z.pending) > 0 THEN 'pending' WHEN c.opens THEN 'box' END AS strategy,
       CASE WHEN len(z.pending) > 0 THEN z.pending WHEN c.opens THEN c.cells ELSE CAST([] AS STRUCT(a INT, o INT, gone TIMESTAMP)[]) END AS cells
     FROM z JOIN c ON c.source_id = z.source_id AND c.n = z.n + 1)))))
SELECT source_id, seq, phase, strategy, CAST(considered AS INT) AS considered, CAST(planned AS INT) AS planned, CAST(len(out) AS INT) AS submitted, CAST(len(pending) AS INT) AS pending, deferred,
  array_to_string(list_transform(out, lambda x: x.a || ':' || x.o), ',') AS cells FROM z WHERE n > 0"""
)
def fsm_coordinator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cycles of all flights: box ahead, filters, phase, throttle, load, and what a cycle leaves to the next."""
    p = timed(spark, sf_dir)
    edges = generate.edges(generate.box("lat", "lon", "heading", F.lit(_EXTENT)))
    f = p.select("source_id", "seq", "t", "ts", F.col("ground_speed").alias("knots"), (F.col("ground_speed") * 20).alias("msl"), (F.col("ground_speed") / 480).alias("load"), flight.fast_enough(F.col("ground_speed")).alias("opens"), "lat", "lon", *[x.alias(c) for x, c in zip(edges, ("south", "north", "west", "east"))])
    asked = with_cells(tables.tile_requests(spark, sf_dir)).select(F.floor("lat").cast("int").alias("dsf_lat"), F.floor("lon").cast("int").alias("dsf_lon"), F.col("ts").alias("since"))
    kept = tables.cache_entries(spark, sf_dir).select(geo.degree(geo.lat_of("row", "zoom", 0.5)).alias("dsf_lat"), geo.degree(geo.lon_of("col", "zoom", 0.5)).alias("dsf_lon"), F.col("last_accessed").alias("since"))
    return carry.cycles(f, [asked, kept])


@query(
    "WITH RECURSIVE "
    + cte("positions")[5:]
    + _T
    + f""", g AS (SELECT source_id, seq, n, t, heading, {_KIND} AS kind, {_ACC} AS acc, lat + ground_speed / 100 AS lat, lon, CASE WHEN ground_speed < 160 THEN heading END AS track, {_KIND} IN ('telemetry', 'network') AS v FROM e),
f AS (SELECT source_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, FALSE AS accepted, NULL::DOUBLE AS ct, NULL::DOUBLE AS ca, NULL::DOUBLE AS tel, NULL::DOUBLE AS sent_at, FALSE AS sent, NULL::DOUBLE AS t, CAST([] AS STRUCT(a DOUBLE, o DOUBLE)[]) AS path, NULL::DOUBLE AS taken,
  NULL::DOUBLE AS track, NULL::VARCHAR AS track_source, FALSE AS has_vectors FROM g WHERE n = 1
 UNION ALL
 SELECT source_id, n, seq, ok, CASE WHEN ok THEN t ELSE ct END, CASE WHEN ok THEN acc ELSE ca END, CASE WHEN kind = 'telemetry' THEN t ELSE tel END, CASE WHEN ok AND due THEN t ELSE sent_at END, ok AND due, t, way, CASE WHEN take THEN t ELSE taken END,
  CASE WHEN NOT ok THEN used WHEN v THEN coalesce(track, drawn, heading) END, CASE WHEN NOT ok THEN used_source WHEN v THEN CASE WHEN track IS NOT NULL THEN 'given' WHEN drawn IS NOT NULL THEN 'derived' ELSE 'heading' END END, CASE WHEN ok THEN v ELSE had END FROM (
  SELECT *, CASE WHEN v AND track IS NULL AND len(way) > 1 AND sqrt((way[-1].a - way[1].a) * (way[-1].a - way[1].a) + (way[-1].o - way[1].o) * (way[-1].o - way[1].o)) >= 0.001 THEN
     CASE WHEN atan2(way[-1].o - way[1].o, way[-1].a - way[1].a) < 0 THEN degrees(atan2(way[-1].o - way[1].o, way[-1].a - way[1].a)) + 360 ELSE degrees(atan2(way[-1].o - way[1].o, way[-1].a - way[1].a)) END END AS drawn FROM (
   SELECT *, CASE WHEN take THEN list_append(path, {{'a': lat, 'o': lon}})[-30:] ELSE path END AS way FROM (
    SELECT g.*, f.ct, f.ca, f.tel, f.sent_at, f.path, f.taken, f.track AS used, f.track_source AS used_source, f.has_vectors AS had, f.ct IS NULL OR g.acc < f.ca OR g.t - f.ct > 30 OR (g.acc = f.ca AND g.t > f.ct) AS ok,
      f.sent_at IS NULL OR g.t - f.sent_at >= 1 AS due, g.v AND (f.taken IS NULL OR g.t - f.taken >= 1) AS take FROM f JOIN g ON g.source_id = f.source_id AND g.n = f.n + 1))))
SELECT source_id, seq, accepted, coalesce(t - tel <= 5, FALSE) AS connected, sent, round(track, 6) AS track, track_source, has_vectors FROM f WHERE n > 0"""
)
def fsm_derived_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of all kinds of sources, those of fast flights without a track of their own: it comes from the way flown."""
    at = (F.col("seq") % 5 + 1).cast("int")
    kind, acc = F.element_at(F.array(*map(F.lit, _KINDS)), at), F.element_at(F.array(*[F.lit(state.ACCURACY_M[k]) for k in _KINDS]), at)
    d = timed(spark, sf_dir).select("source_id", "seq", "t", kind.alias("kind"), acc.alias("accuracy"), (F.col("lat") + F.col("ground_speed") / 100).alias("lat"), "lon", "heading", F.when(F.col("ground_speed") < 160, F.col("heading")).alias("track"))
    out = carry.scanned(d, ["source_id"], ["seq"], ["source_id", "seq"], ["t", "kind", "accuracy", "lat", "lon", "heading", "track"], carry.aggregated, "accepted boolean, connected boolean, sent boolean, track double, track_source string, has_vectors boolean")
    return out.withColumn("track", F.round("track", 6))
