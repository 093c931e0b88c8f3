"""Metric events: counters, gauges, ratios, rates, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values. Counters: name to the events that add one, and to (event, field) pairs that add a field.
COUNTS = {
    "chunks_downloaded": ["download_completed"], "chunks_failed": ["download_failed"], "chunks_retried": ["download_retried"],
    "chunk_disk_cache_hits": ["chunk_disk_cache_hit"], "chunk_disk_cache_misses": ["chunk_disk_cache_miss"],
    "dds_disk_cache_hits": ["dds_disk_cache_hit"], "dds_disk_cache_misses": ["dds_disk_cache_miss"],
    "memory_cache_hits": ["memory_cache_hit"], "memory_cache_misses": ["memory_cache_miss"],
    "jobs_submitted": ["job_submitted"], "jobs_coalesced": ["job_coalesced"], "jobs_timed_out": ["job_timed_out"],
    "encodes_completed": ["encode_completed"], "fuse_tiles_served": ["fuse_tile_served"],
}
FUSE_COUNTS = {"fuse_memory_cache_hits": "memory_cache_hit", "fuse_memory_cache_misses": "memory_cache_miss", "fuse_jobs_submitted": "job_submitted", "fuse_dds_disk_cache_hits": "dds_disk_cache_hit", "fuse_dds_disk_cache_misses": "dds_disk_cache_miss"}
SUMS = {
    "bytes_downloaded": ("download_completed", "bytes"), "download_time_us": ("download_completed", "duration_us"), "chunk_disk_bytes_read": ("chunk_disk_cache_hit", "bytes"),
    "chunk_disk_bytes_written": ("disk_write_completed", "bytes"), "disk_write_time_us": ("disk_write_completed", "duration_us"), "disk_bytes_evicted": ("disk_cache_evicted", "bytes"),
    "dds_disk_bytes_read": ("dds_disk_cache_hit", "bytes"), "bytes_encoded": ("encode_completed", "bytes"), "encode_time_us": ("encode_completed", "duration_us"), "assembly_time_us": ("assembly_completed", "duration_us"),
}
LAST = {"initial_disk_cache_bytes": "disk_cache_initial_size", "chunk_disk_cache_size_bytes": "disk_cache_size_update", "dds_disk_cache_size_bytes": "dds_disk_cache_size_update", "memory_cache_size_bytes": "memory_cache_size_update"}
#: In-flight gauges: events that raise them, events that lower them; they never go below zero.
GAUGES = {
    "downloads_active": (["download_started"], ["download_completed", "download_failed", "download_retried"]),
    "disk_writes_active": (["disk_write_started"], ["disk_write_completed"]),
    "jobs_active": (["job_started"], ["job_completed", "job_timed_out"]),
    "encodes_active": (["encode_started"], ["encode_completed"]),
    "fuse_requests_active": (["fuse_request_started"], ["fuse_request_completed"]),
    "fuse_requests_waiting": (["fuse_request_queued"], ["fuse_request_dequeued"]),
}
#: What a reset keeps.
KEPT_BY_RESET = ("initial_disk_cache_bytes", "disk_bytes_evicted", "chunk_disk_cache_size_bytes", "dds_disk_cache_size_bytes")


def counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """All counters, sums and last-written sizes per key, combined before the shuffle."""
    kind = F.col("event_type")
    out = [F.count_if(kind.isin(*v)).alias(n) for n, v in COUNTS.items()]
    out += [F.count_if((kind == v) & F.col("is_fuse")).alias(n) for n, v in FUSE_COUNTS.items()]
    out += [F.count_if((kind == "job_completed") & F.col("success")).alias("jobs_completed"), F.count_if((kind == "job_completed") & ~F.col("success")).alias("jobs_failed")]
    out += [F.coalesce(F.sum(F.when(kind == e, F.col(c))), F.lit(0)).cast("long").alias(n) for n, (e, c) in SUMS.items()]
    out += [F.coalesce(F.max_by(F.when(kind == e, F.col("bytes")), F.when(kind == e, F.struct("ts", "seq"))), F.lit(0)).cast("long").alias(n) for n, e in LAST.items()]
    return events.groupBy(*keys).agg(*out)


def gauge(events: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """events that move a gauge, each with its value after it.

    A walk that stops at zero equals its running sum minus the lowest point the sum has had below zero: two window sums instead of
    a fold.
    """
    up, down = GAUGES[name]
    d = F.when(F.col("event_type").isin(*up), 1).when(F.col("event_type").isin(*down), -1)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("_d", d).where("_d is not null").withColumn("_s", F.sum("_d").over(w))
    return e.withColumn(name, F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_d", "_s")


def after_last_reset(events: DataFrame, keys: list[str], kind: str = "reset") -> DataFrame:
    """events with `live`: whether they are after the last reset of their key. Sums of what a reset keeps are taken over all of them."""
    w = Window.partitionBy(*keys)
    last = F.max(F.when(F.col("event_type") == kind, F.struct("ts", "seq"))).over(w)
    return events.withColumn("live", F.coalesce(F.struct("ts", "seq") > last, F.lit(True)))


def ratio(part: Column, *whole: Column) -> Column:
    """part over the sum of whole, 0 where that is 0."""
    total = sum(whole[1:], whole[0])
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total)


def calibration(samples: DataFrame, keys: list[str], fewest: int = 50, most: int | None = 10_000) -> DataFrame:
    """Throughput and its spread per key from samples (t in seconds, ms): the last `most` of each (None: all), no row below `fewest`.

    The average is an integer, the deviation is taken around it and cut to an integer, as is usual for these reports; confidence
    falls with a spread of up to half the average.
    """
    s = samples
    if most is not None:
        w = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("seq"))
        s = s.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    g = s.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("ms").alias("sum"), F.sum(F.col("ms") * F.col("ms")).alias("sq"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    g = g.where(F.col("n") >= fewest).withColumn("avg_ms", F.floor(F.col("sum") / F.col("n")).cast("long"))
    # Sum of squared differences from the cut average, from the two sums.
    off = F.col("sq") - 2 * F.col("avg_ms") * F.col("sum") + F.col("n") * F.col("avg_ms") * F.col("avg_ms")
    g = g.withColumn("stddev_ms", F.floor(F.sqrt(off / F.col("n"))).cast("long"))
    g = g.withColumn("throughput", F.col("n") / F.greatest(F.col("t1") - F.col("t0"), F.lit(0.001)))
    spread = F.when(F.col("avg_ms") == 0, F.lit(0.5)).otherwise(F.least(F.col("stddev_ms") / F.nullif(F.col("avg_ms"), F.lit(0)), F.lit(0.5)))
    conf = F.least(F.greatest(0.7 * F.least(F.col("n") / 200, F.lit(1.0)) + 0.3 * (1 - spread), F.lit(0.0)), F.lit(1.0))
    mode = F.when(F.col("throughput") >= 30, "aggressive").when(F.col("throughput") >= 10, "opportunistic").otherwise("disabled")
    return g.select(*keys, "n", "throughput", "avg_ms", "stddev_ms", conf.alias("confidence"), mode.alias("mode"))
