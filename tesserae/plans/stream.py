"""Queries whose rows come out of Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import geo
from tesserae.plans.agg import _LAT, _LON
from tesserae.registry import query
from tesserae.sources.tables import cte
from tesserae.streaming import ordered, streams


def _requests(e: DataFrame) -> DataFrame:
    return e.select("ts", (83776 + (F.col("event_id") * 31 + F.col("user_id") * 7) % 64 * 40).alias("row"), (138240 + F.col("event_id") * 17 % 64 * 40).alias("col"), F.lit(18).alias("zoom"))


@query(cte("tile_requests") + f""" SELECT CAST(floor({_LAT}) AS INT) AS dsf_lat, CAST(floor({_LON}) AS INT) AS dsf_lon, count(*) AS requests FROM tile_requests GROUP BY ALL""")
def stream_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per cell, kept up to date."""
    r = _requests(streams.read(spark, sf_dir, "events"))
    c = r.select(geo.degree(geo.lat_of("row", "zoom", 0.5)).alias("dsf_lat"), geo.degree(geo.lon_of("col", "zoom", 0.5)).alias("dsf_lon"))
    return streams.drained(c.groupBy("dsf_lat", "dsf_lon").agg(F.count("*").alias("requests")), "complete")


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS events, CAST(sum(floor(value * 1000)) AS BIGINT) AS bytes FROM events GROUP BY ALL""")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and bytes per day and kind in event time windows; everything is there at once, so nothing is late."""
    e = streams.read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.floor(F.col("value") * 1000).cast("long").alias("bytes"))
    w = streams.drained(streams.windowed(e), "complete")
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "events", "bytes")


@query(
    """WITH RECURSIVE g AS (SELECT o_custkey AS source_id, o_orderkey AS seq, CAST(o_orderkey * 3 AS DOUBLE) AS t, [10.0, 10.0, 100.0, 100000.0][CAST(o_orderkey % 4 AS INT) + 1]::DOUBLE AS acc, (o_custkey * 7919 % 16000) / CAST(100 AS DOUBLE) - 80 AS lat, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT source_id, seq, n, TRUE AS accepted, t AS ct, acc AS ca, lat AS cl FROM g WHERE n = 1 UNION ALL
SELECT source_id, seq, n, ok, CASE WHEN ok THEN t ELSE ct END, CASE WHEN ok THEN acc ELSE ca END, CASE WHEN ok THEN lat ELSE cl END FROM
 (SELECT g.*, f.ct, f.ca, f.cl, g.acc < f.ca OR g.t - f.ct > 30 OR (g.acc = f.ca AND g.t > f.ct) AS ok FROM f JOIN g ON g.source_id = f.source_id AND g.n = f.n + 1))
SELECT source_id, seq, accepted, round(cl, 6) AS lat, ca AS accuracy FROM f"""
)
def stream_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position fusion with state between batches, over the orders as they come in; the batch fold is its test."""
    o = streams.read(spark, sf_dir, "orders")
    acc = F.element_at(F.array(F.lit(10.0), F.lit(10.0), F.lit(100.0), F.lit(100_000.0)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    t = (F.col("o_orderkey") * 3).cast("double")
    u = o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("seq"), t.alias("t"), t.alias("arrived"), acc.alias("accuracy"), (F.col("o_custkey") * 7919 % 16000 / F.lit(100.0) - 80).alias("lat"), F.lit(0.0).alias("lon"))
    return streams.drained(streams.fused(u), "append")


@query(
    """WITH u AS (SELECT user_id % 200 AS source_id, event_id AS seq, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS t FROM events),
o AS (SELECT *, lag(t) OVER w AS before, lead(t) OVER w AS after, max(t) OVER () AS newest FROM u WINDOW w AS (PARTITION BY source_id ORDER BY t, seq))
SELECT source_id, t, TRUE AS connected FROM o WHERE before IS NULL OR t - before > 86400
UNION ALL SELECT source_id, t + 86400, FALSE FROM o WHERE coalesce(after - t > 86400, floor(newest * 1000) / 1000 > t + 86400)"""
)
def stream_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When users come and go: one who is silent for a day is gone, found by a timer, as no row says so."""
    e = streams.read(spark, sf_dir, "events")
    u = e.select((F.col("user_id") % 200).alias("source_id"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    return streams.drained(ordered.connections(u, "0 seconds", 86_400.0), "append")
