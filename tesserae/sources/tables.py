"""Inputs of the plans, derived from the star schema: positions, tile requests, tile references, metric events, cache entries, files.

TEXT holds the same definitions as SQL, to be put in front of an oracle as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = {
    "positions": """SELECT o_orderkey AS seq, o_custkey AS source_id, o_orderdate AS ts,
  (o_custkey * 7919 % 16000) / CAST(100 AS DOUBLE) - 80 AS lat, (o_orderkey * 104729 % 35900) / CAST(100 AS DOUBLE) - 179.5 AS lon,
  CAST(o_orderkey * 37 % 360 AS DOUBLE) AS heading, CAST(o_orderkey * 13 % 480 AS DOUBLE) AS ground_speed FROM orders""",
    "tile_requests": """SELECT event_id AS seq, ts, user_id AS session_id, 83776 + ((event_id * 31 + user_id * 7) % 64) * 40 AS "row",
  138240 + ((event_id * 17) % 64) * 40 AS col, 18 AS zoom FROM events""",
    "tile_refs": """SELECT p_partkey AS ref_id, 18 AS zoom, 400 + p_partkey % 20 AS "row", 800 + CAST(FLOOR(p_partkey / 20) AS BIGINT) % 20 AS col,
  'BI' AS provider, p_size % 7 = 0 AS is_sea FROM part WHERE ((p_partkey % 20) * 3 + CAST(FLOOR(p_partkey / 20) AS BIGINT) % 20) % 53 <> 0
  UNION ALL SELECT -1 - p_partkey, 16, 100 + p_partkey % 6, 200 + CAST(FLOOR(p_partkey / 6) AS BIGINT) % 6, 'BI', FALSE FROM part WHERE p_partkey < 36""",
    "metric_events": """SELECT event_id AS seq, ts, user_id AS session_id,
  CASE event_id % 8 WHEN 0 THEN 'job_submitted' WHEN 1 THEN 'job_started' WHEN 2 THEN 'job_completed' WHEN 3 THEN 'memory_cache_hit'
    WHEN 4 THEN 'memory_cache_miss' WHEN 5 THEN 'download_started' WHEN 6 THEN 'download_completed' ELSE 'download_failed' END AS event_type,
  CAST(FLOOR(value * 1000) AS BIGINT) AS bytes, event_id * 97 % 5000 AS duration_us, user_id % 2 = 0 AS is_fuse, event_id % 5 <> 0 AS success FROM events""",
    "cache_entries": """SELECT o_orderkey AS entry_id, 12 AS zoom, o_orderkey % 4096 AS "row", o_custkey % 4096 AS col,
  CAST(FLOOR(o_totalprice) AS BIGINT) AS size_bytes, o_orderdate AS last_accessed FROM orders""",
    "source_files": """SELECT l_suppkey AS source_idx, CONCAT('Earth nav data/f', CAST(l_partkey % 97 AS VARCHAR(20)), '.dsf') AS path,
  CAST(l_quantity AS BIGINT) AS size FROM lineitem""",
}


def cte(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({TEXT[n]})" for n in names)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("source_id"),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_custkey") * 7919 % 16000 / F.lit(100.0) - 80).alias("lat"),
        (F.col("o_orderkey") * 104729 % 35900 / F.lit(100.0) - 179.5).alias("lon"),
        (F.col("o_orderkey") * 37 % 360).cast("double").alias("heading"),
        (F.col("o_orderkey") * 13 % 480).cast("double").alias("ground_speed"),
    )


def tile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("user_id").alias("session_id"),
        (83776 + (F.col("event_id") * 31 + F.col("user_id") * 7) % 64 * 40).alias("row"),
        (138240 + F.col("event_id") * 17 % 64 * 40).alias("col"),
        F.lit(18).alias("zoom"),
    )


def tile_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    strip = F.floor(k / 20) % 20
    high = p.where((k % 20 * 3 + strip) % 53 != 0).select(
        k.alias("ref_id"), F.lit(18).alias("zoom"), (400 + k % 20).alias("row"), (800 + strip).alias("col"), F.lit("BI").alias("provider"), (F.col("p_size") % 7 == 0).alias("is_sea")
    )
    low = p.where(k < 36).select(
        (-1 - k).alias("ref_id"), F.lit(16).alias("zoom"), (100 + k % 6).alias("row"), (200 + F.floor(k / 6) % 6).alias("col"), F.lit("BI").alias("provider"), F.lit(False).alias("is_sea")
    )
    return high.unionByName(low)


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    kinds = ["job_submitted", "job_started", "job_completed", "memory_cache_hit", "memory_cache_miss", "download_started", "download_completed", "download_failed"]
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("user_id").alias("session_id"),
        F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 8 + 1).cast("int")).alias("event_type"),
        F.floor(F.col("value") * 1000).cast("long").alias("bytes"),
        (F.col("event_id") * 97 % 5000).alias("duration_us"),
        (F.col("user_id") % 2 == 0).alias("is_fuse"),
        (F.col("event_id") % 5 != 0).alias("success"),
    )


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("entry_id"),
        F.lit(12).alias("zoom"),
        (F.col("o_orderkey") % 4096).alias("row"),
        (F.col("o_custkey") % 4096).alias("col"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"),
        F.col("o_orderdate").alias("last_accessed"),
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("source_idx"), F.concat(F.lit("Earth nav data/f"), (F.col("l_partkey") % 97).cast("string"), F.lit(".dsf")).alias("path"), F.col("l_quantity").cast("long").alias("size")
    )
