"""Windows over ordered rows, and ordered cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import geo
from tesserae.operators.fold import folded
from tesserae.operators import state
from tesserae.plans.fsm import _T, timed
from tesserae.registry import query
from tesserae.sources import tables
from tesserae.sources.tables import cte


def ticks(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    """Downloaded bytes and submitted jobs per session and tick; a tick without events has no row."""
    e = tables.metric_events(spark, sf_dir)
    t = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds).alias("tick")
    done = F.sum(F.when(F.col("event_type") == "download_completed", F.col("bytes")).otherwise(0))
    jobs = F.count_if((F.col("event_type") == "job_submitted") & F.col("is_fuse"))
    return e.groupBy("session_id", t).agg(done.alias("bytes"), jobs.alias("jobs"))


_TICKS = """, k AS (SELECT session_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS tick, CAST(sum(CASE WHEN event_type = 'download_completed' THEN bytes ELSE 0 END) AS BIGINT) AS bytes, count(*) FILTER (event_type = 'job_submitted' AND is_fuse) AS jobs FROM metric_events GROUP BY ALL)"""


@query(cte("metric_events") + _TICKS + """ SELECT session_id, tick, round(bytes / 3600, 6) AS network_rate, round(jobs / 3600, 9) AS fuse_rate, round(max(bytes) OVER w / 3600, 6) AS peak, CAST(sum(bytes) OVER w AS BIGINT) AS bytes_so_far FROM k WINDOW w AS (PARTITION BY session_id ORDER BY tick)""")
def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per tick, with the running peak and total."""
    w = Window.partitionBy("session_id").orderBy("tick")
    return ticks(spark, sf_dir).select("session_id", "tick", F.round(F.col("bytes") / 3600, 6).alias("network_rate"), F.round(F.col("jobs") / 3600, 9).alias("fuse_rate"), F.round(F.max("bytes").over(w) / 3600, 6).alias("peak"), F.sum("bytes").over(w).alias("bytes_so_far"))


@query(cte("metric_events") + _TICKS + """, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tick DESC) AS n FROM k) SELECT session_id, tick, bytes FROM n WHERE n <= 60""")
def win_last60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ring of 60 samples holds at the end."""
    w = Window.partitionBy("session_id").orderBy(F.desc("tick"))
    return ticks(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 60").select("session_id", "tick", "bytes")


@query(cte("positions") + _T + """ SELECT source_id, seq, count(*) OVER w AS samples, round(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE count(*) OVER w / greatest(t - min(t) OVER w, 0.001) END, 6) AS throughput FROM e WINDOW w AS (PARTITION BY source_id ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)""")
def win_rolling_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the last 300 seconds over the time between the first and the last of them."""
    w = Window.partitionBy("source_id").orderBy("t").rangeBetween(-300, 0)
    n = F.count("*").over(w)
    r = F.when(n < 2, F.lit(0.0)).otherwise(n / F.greatest(F.col("t") - F.min("t").over(w), F.lit(0.001)))
    return timed(spark, sf_dir).select("source_id", "seq", n.alias("samples"), F.round(r, 6).alias("throughput"))


_TRACK = "degrees(atan2(lon - o, lat - a))"


@query(cte("positions") + f""", h AS (SELECT *, first_value(lat) OVER w AS a, first_value(lon) OVER w AS o, count(*) OVER w AS n FROM positions WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT source_id, seq, round(CASE WHEN n < 2 OR sqrt((lat - a) * (lat - a) + (lon - o) * (lon - o)) < 0.001 THEN -1 WHEN {_TRACK} < 0 THEN {_TRACK} + 360 ELSE {_TRACK} END, 4) AS track FROM h""")
def win_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction from the oldest to the newest of the last 30 samples; -1 where they are too few or too near."""
    w = Window.partitionBy("source_id").orderBy("seq").rowsBetween(-29, 0)
    p = tables.positions(spark, sf_dir).withColumns({"a": F.first("lat").over(w), "o": F.first("lon").over(w), "n": F.count("*").over(w)})
    d = F.sqrt((F.col("lat") - F.col("a")) * (F.col("lat") - F.col("a")) + (F.col("lon") - F.col("o")) * (F.col("lon") - F.col("o")))
    track = geo.flat_bearing("a", "o", "lat", "lon")
    return p.select("source_id", "seq", F.round(F.when((F.col("n") < 2) | (d < 0.001), F.lit(-1.0)).otherwise(track), 4).alias("track"))


@query(cte("positions") + _T + """ SELECT source_id, seq, round(coalesce(last_value(CASE WHEN seq % 3 = 0 THEN heading END IGNORE NULLS) OVER w, -1), 4) AS heading, round(coalesce(last_value(CASE WHEN seq % 3 = 1 THEN ground_speed END IGNORE NULLS) OVER w, -1), 4) AS ground_speed FROM e WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def win_partial_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that come in different packets, each carried forward; -1 until it has come."""
    w = Window.partitionBy("source_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    held = lambda c, k: F.round(F.coalesce(F.last(F.when(F.col("seq") % 3 == k, F.col(c)), ignorenulls=True).over(w), F.lit(-1.0)), 4).alias(c)
    return tables.positions(spark, sf_dir).select("source_id", "seq", held("heading", 0), held("ground_speed", 1))


@query(cte("positions") + _T + """ SELECT source_id, seq, t - max(t) OVER (PARTITION BY source_id) < -30 AS expired, t - max(t) OVER (PARTITION BY source_id) <= -120 AS region_stale, t - max(t) OVER (PARTITION BY source_id) < -5 AS safe_mode FROM e""")
def win_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age against the newest row of a source: positions over 30 s, regions from 120 s, telemetry over 5 s."""
    age = F.max("t").over(Window.partitionBy("source_id")) - F.col("t")
    return timed(spark, sf_dir).select("source_id", "seq", (age > 30).alias("expired"), (age >= 120).alias("region_stale"), (age > 5).alias("safe_mode"))


@query(
    "WITH RECURSIVE "
    + cte("positions")[5:]
    + _T
    + """, r AS (SELECT source_id, seq, t * 60 AS t, n, count(*) OVER w AS samples, round(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE count(*) OVER w / greatest(t - min(t) OVER w, 0.001) END, 6) AS throughput FROM e WINDOW w AS (PARTITION BY source_id ORDER BY t RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)),
f AS (SELECT source_id, seq, n, CASE WHEN samples >= 10 THEN t END AS last, CASE WHEN samples >= 10 THEN least(2, greatest(0, 1 + CASE WHEN throughput < 0.7::DOUBLE * 0.33::DOUBLE THEN -1 WHEN throughput > 0.9::DOUBLE * 0.33::DOUBLE THEN 1 ELSE 0 END)) ELSE 1 END AS i FROM r WHERE n = 1 UNION ALL
SELECT source_id, seq, n, CASE WHEN due THEN t ELSE last END, CASE WHEN due THEN least(2, greatest(0, i + CASE WHEN throughput < 0.7::DOUBLE * 0.33::DOUBLE THEN -1 WHEN throughput > 0.9::DOUBLE * 0.33::DOUBLE THEN 1 ELSE 0 END)) ELSE i END FROM
 (SELECT r.*, f.last, f.i, r.samples >= 10 AND (f.last IS NULL OR r.t - f.last >= 900) AS due FROM f JOIN r ON r.source_id = f.source_id AND r.n = f.n + 1))
SELECT source_id, seq, ['disabled', 'opportunistic', 'aggressive'][CAST(i AS INT) + 1] AS mode FROM f"""
)
def win_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode ladder over rolling throughput against a baseline of one sample in three seconds."""
    d = win_rolling_throughput(spark, sf_dir).join(timed(spark, sf_dir).select("seq", (F.col("t") * 60).alias("t")), "seq")
    d = d.withColumns({"baseline": F.lit(0.33), "mode": F.lit("opportunistic")}).select("source_id", "seq", "t", "samples", "throughput", "baseline", "mode")

    def step(s: dict | None, r: dict) -> tuple[dict, dict]:
        s, o = state.ladder(s, r)
        return s, {"source_id": r["source_id"], "seq": r["seq"], **o}

    return folded(d, ["source_id"], ["seq"], step, "source_id long, seq long, mode string")


# --- ordered cuts ---------------------------------------------------------------------------------------------------------------------


@query(cte("cache_entries") + """ SELECT entry_id, size_bytes, last_accessed FROM cache_entries WHERE last_accessed < (SELECT max(last_accessed) FROM cache_entries) - INTERVAL 60 SECOND ORDER BY last_accessed, entry_id LIMIT 500""")
def topk_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 entries to evict first among those not used for a minute; the newest use stands for now."""
    e = tables.cache_entries(spark, sf_dir)
    now = e.agg(F.max("last_accessed").alias("now"))
    old = e.join(F.broadcast(now), F.col("last_accessed") < F.col("now") - F.expr("INTERVAL 60 SECOND"))  # one row
    return old.orderBy("last_accessed", "entry_id").limit(500).select("entry_id", "size_bytes", "last_accessed")


@query(cte("cache_entries") + """, t AS (SELECT sum(size_bytes) AS total FROM cache_entries), r AS (SELECT entry_id, size_bytes, row_number() OVER w AS n, sum(size_bytes) OVER w - size_bytes AS before FROM cache_entries WINDOW w AS (ORDER BY last_accessed, entry_id))
SELECT entry_id, size_bytes, CAST((n - 1) // 25 AS BIGINT) AS batch FROM r, t WHERE before < total * 0.2""")
def topk_gc_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest entries until a fifth of all bytes is free, the one that crosses included, in batches of 25.

    The running sum is taken in two steps, so that no task sees all entries: sums of days first, then within each day.
    """
    e = tables.cache_entries(spark, sf_dir).withColumn("day", F.to_date("last_accessed"))
    days = e.groupBy("day").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("rows"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    days = days.select("day", F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("b0"), F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("n0"), F.sum("bytes").over(Window.partitionBy(F.lit(1))).alias("total"))
    d = Window.partitionBy("day").orderBy("last_accessed", "entry_id").rowsBetween(Window.unboundedPreceding, -1)
    r = e.join(days, "day").withColumns({"before": F.col("b0") + F.coalesce(F.sum("size_bytes").over(d), F.lit(0)), "n": F.col("n0") + F.count("*").over(d)})
    return r.where(F.col("before") < F.col("total") * 0.2).select("entry_id", "size_bytes", F.floor(F.col("n") / 25).alias("batch"))


@query(cte("cache_entries") + """ SELECT zoom, CAST(sum(size_bytes) AS BIGINT) AS bytes, sum(size_bytes) > 0.95 * 1000000000 AS needs_gc, CAST(0.8 * 1000000000 AS BIGINT) AS target, CAST(greatest(sum(size_bytes) - 800000000, 0) AS BIGINT) AS to_free, CAST(2 * greatest(greatest(sum(size_bytes) - 800000000, 0) // 20000, 100) AS BIGINT) AS candidates FROM cache_entries GROUP BY zoom""")
def topk_gc_trigger(spark: SparkSession, sf_dir: str, limit: int = 1_000_000_000) -> DataFrame:
    """Whether a cache of a gigabyte is 95 % full, and how much and how many candidates bring it to 80 %."""
    g = tables.cache_entries(spark, sf_dir).groupBy("zoom").agg(F.sum("size_bytes").alias("bytes"))
    free = F.greatest(F.col("bytes") - int(limit * 0.8), F.lit(0))
    return g.select("zoom", "bytes", (F.col("bytes") > limit * 0.95).alias("needs_gc"), F.lit(int(limit * 0.8)).cast("long").alias("target"), free.alias("to_free"), (2 * F.greatest(F.floor(free / 20_000), F.lit(100))).alias("candidates"))


@query(cte("tile_requests") + """ SELECT seq % 4 AS priority, zoom, count(*) AS tasks, min(seq) AS first FROM tile_requests GROUP BY ALL""")
def topk_queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tile_requests(spark, sf_dir).groupBy((F.col("seq") % 4).alias("priority"), "zoom").agg(F.count("*").alias("tasks"), F.min("seq").alias("first"))


@query(cte("tile_requests") + """ SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq % 4 DESC, seq) AS place FROM tile_requests""")
def topk_priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a session's tasks run: priority down, then first come."""
    w = Window.partitionBy("session_id").orderBy(F.desc(F.col("seq") % 4), "seq")
    return tables.tile_requests(spark, sf_dir).select("session_id", "seq", F.row_number().over(w).cast("long").alias("place"))


@query(cte("tile_requests") + """, l AS (SELECT *, (session_id % 10) / 10 AS load, CASE session_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 ELSE 0.7 END AS share, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n, count(*) OVER (PARTITION BY session_id) AS c FROM tile_requests)
SELECT session_id, seq, CASE WHEN load > 0.8 THEN 'deferred' WHEN n <= ceil(round((CASE WHEN load > 0.5 THEN ceil(c * 0.5) ELSE c END) * share, 9)) THEN 'submitted' ELSE 'pending' END AS fate FROM l""")
def topk_backpressure_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a session's plan is sent: nothing under heavy load, half under some, times the throttle's share."""
    w = Window.partitionBy("session_id")
    load = F.col("session_id") % 10 / 10
    share = F.when(F.col("session_id") % 3 == 0, 1.0).when(F.col("session_id") % 3 == 1, 0.25).otherwise(0.7)
    n, c = F.row_number().over(w.orderBy("seq")), F.count("*").over(w)
    most = F.ceil(F.round(F.when(load > 0.5, F.ceil(c * 0.5)).otherwise(c) * share, 9))
    return tables.tile_requests(spark, sf_dir).select("session_id", "seq", F.when(load > 0.8, "deferred").when(n <= most, "submitted").otherwise("pending").alias("fate"))


@query(cte("cache_entries") + """, t AS (SELECT entry_id, pow(degrees(atan(sinh(pi() * (1 - 2 * ("row" + 0.5) / 4096)))) - 53.63, 2) + pow((col + 0.5) / 4096 * 360 - 180 - 9.99, 2) AS d FROM cache_entries) SELECT entry_id, round(d, 4) AS d FROM t ORDER BY round(d, 4), entry_id LIMIT 100""")
def topk_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 tiles nearest to a point by squared degrees; ties by id."""
    e = tables.cache_entries(spark, sf_dir)
    d = F.pow(geo.lat_of("row", "zoom", 0.5) - 53.63, 2) + F.pow(geo.lon_of("col", "zoom", 0.5) - 9.99, 2)
    return e.select("entry_id", F.round(d, 4).alias("d")).orderBy("d", "entry_id").limit(100)


@query(cte("tile_requests") + """, g AS (SELECT session_id, min(ts) AS started, count(*) AS n FROM tile_requests GROUP BY session_id) SELECT session_id, started, n FROM g ORDER BY started, session_id LIMIT 4""")
def topk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four sessions that began first."""
    return tables.tile_requests(spark, sf_dir).groupBy("session_id").agg(F.min("ts").alias("started"), F.count("*").alias("n")).orderBy("started", "session_id").limit(4)
