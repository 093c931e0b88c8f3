"""State machines folded over every source's rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators import state
from tesserae.operators.fold import folded
from tesserae.registry import query
from tesserae.sources import tables
from tesserae.sources.tables import cte

# Seconds of each position within its source: the dates of the table are too far apart for thresholds of seconds.
_T = """, e AS (SELECT *, CAST(sum(seq * 31 % 50) OVER (PARTITION BY source_id ORDER BY seq) AS BIGINT) / CAST(10 AS DOUBLE) AS t, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n FROM positions)"""


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy("seq")
    return tables.positions(spark, sf_dir).withColumn("t", F.sum(F.col("seq") * 31 % 50).over(w) / F.lit(10.0))


@query(
    "WITH RECURSIVE "
    + cte("positions")[5:]
    + _T
    + """, f AS (SELECT source_id, seq, n, t, TRUE AS taken, t AS last FROM e WHERE n = 1 UNION ALL
SELECT e.source_id, e.seq, e.n, e.t, e.t - f.last >= 1, CASE WHEN e.t - f.last >= 1 THEN e.t ELSE f.last END FROM f JOIN e ON e.source_id = f.source_id AND e.n = f.n + 1)
SELECT source_id, seq, taken FROM f"""
)
def fsm_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions taken at most once a second, counted from the last that was taken."""
    d = timed(spark, sf_dir).select("source_id", "seq", "t")
    step = lambda s, r: (lambda s2, o: (s2, {"source_id": r["source_id"], "seq": r["seq"], **o}))(*state.sampled(s, r))
    return folded(d, ["source_id"], ["seq"], step, "source_id long, seq long, taken boolean")


@query(
    "WITH RECURSIVE "
    + cte("positions")[5:]
    + _T
    + """, g AS (SELECT *, CASE seq % 4 WHEN 0 THEN 10.0 WHEN 1 THEN 10.0 WHEN 2 THEN 100.0 ELSE 100000.0 END::DOUBLE AS acc FROM e),
f AS (SELECT source_id, seq, n, TRUE AS accepted, t AS ct, acc AS ca, lat AS cl FROM g WHERE n = 1 UNION ALL
SELECT source_id, seq, n, ok, CASE WHEN ok THEN t ELSE ct END, CASE WHEN ok THEN acc ELSE ca END, CASE WHEN ok THEN lat ELSE cl END FROM
 (SELECT g.source_id, g.seq, g.n, g.t, g.acc, g.lat, f.ct, f.ca, f.cl, g.acc < f.ca OR g.t - f.ct > 30 OR (g.acc = f.ca AND g.t > f.ct) AS ok FROM f JOIN g ON g.source_id = f.source_id AND g.n = f.n + 1))
SELECT source_id, seq, accepted, round(cl, 6) AS lat, ca AS accuracy FROM f"""
)
def fsm_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of four kinds of sources fused to one current position."""
    acc = F.element_at(F.array(*map(F.lit, (state.ACCURACY_M["telemetry"], state.ACCURACY_M["network"], state.ACCURACY_M["manual"], state.ACCURACY_M["inference"]))), (F.col("seq") % 4 + 1).cast("int"))
    d = timed(spark, sf_dir).select("source_id", "seq", "t", F.col("t").alias("arrived"), acc.alias("accuracy"), "lat", "lon")

    def step(s: dict | None, r: dict) -> tuple[dict, dict]:
        s, o = state.fusion(s, r)
        return s, {"source_id": r["source_id"], "seq": r["seq"], "accepted": o["accepted"], "lat": round(o["lat"], 6), "accuracy": o["accuracy"]}

    return folded(d, ["source_id"], ["seq"], step, "source_id long, seq long, accepted boolean, lat double, accuracy double")


def _flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spark, sf_dir).select("source_id", "seq", "t", (F.col("seq") * 13 % 97).cast("double").alias("knots"), (F.col("seq") * 7 % 2500).cast("double").alias("msl"))


_TO = """CASE WHEN climb THEN 'cruise' WHEN wanted IS NULL THEN NULL WHEN want = wanted AND t - wf >= CASE WHEN phase = 'cruise' THEN 15 ELSE 2 END THEN wanted END"""


#: Phases and the throttle over g (source_id, seq, n, t, knots, msl), as f.
PHASES = f"""f AS (SELECT source_id, seq, n, t, 'ground' AS phase, t AS since, NULL::DOUBLE AS pm, CASE WHEN knots >= 40 THEN 'transition' END AS want, CASE WHEN knots >= 40 THEN t END AS wf, FALSE AS changed, 'idle' AS mode, NULL::DOUBLE AS ts FROM g WHERE n = 1 UNION ALL
SELECT source_id, seq, n, t, phase, since, pm, want, wf, changed, CASE WHEN mode = 'ramping' AND t - ts >= 30 THEN 'idle' ELSE mode END, CASE WHEN mode = 'ramping' AND t - ts < 30 THEN ts END FROM
 (SELECT source_id, seq, n, t, coalesce(go, phase) AS phase, CASE WHEN go IS NULL THEN since ELSE t END AS since, CASE WHEN go IS NULL THEN pm WHEN go = 'transition' THEN msl END AS pm, CASE WHEN go IS NULL AND NOT climb AND wanted IS NOT NULL THEN wanted END AS want,
   CASE WHEN go IS NULL AND wanted IS NOT NULL THEN CASE WHEN want = wanted THEN wf ELSE t END END AS wf, go IS NOT NULL AS changed,
   CASE WHEN go = 'transition' THEN 'held' WHEN go = 'ground' THEN 'idle' WHEN go = 'cruise' AND mode = 'held' THEN 'ramping' ELSE mode END AS mode, CASE WHEN go IN ('transition', 'ground') THEN NULL WHEN go = 'cruise' AND mode = 'held' THEN t ELSE ts END AS ts FROM
  (SELECT *, {_TO} AS go FROM
   (SELECT g.*, f.phase, f.since, f.pm, f.want, f.wf, f.mode, f.ts, f.phase = 'transition' AND (coalesce(g.msl - f.pm >= 1000, FALSE) OR g.t - f.since >= 90) AS climb,
     CASE WHEN f.phase = 'transition' THEN CASE WHEN g.knots < 40 THEN 'ground' END WHEN f.phase = 'ground' THEN CASE WHEN g.knots >= 40 THEN 'transition' END WHEN g.knots < 40 THEN 'ground' END AS wanted
    FROM f JOIN g ON g.source_id = f.source_id AND g.n = f.n + 1))))"""


@query(
    "WITH RECURSIVE "
    + cte("positions")[5:]
    + _T
    + f""", g AS (SELECT source_id, seq, n, t, CAST(seq * 13 % 97 AS DOUBLE) AS knots, CAST(seq * 7 % 2500 AS DOUBLE) AS msl FROM e),
{PHASES}
SELECT source_id, seq, phase, changed, mode, round(CASE mode WHEN 'idle' THEN 1 WHEN 'held' THEN 0 ELSE 0.25::DOUBLE + (t - ts) / 30 * 0.75::DOUBLE END, 6) AS share FROM f"""
)
def fsm_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flight phases and the throttle that follows them, row by row."""

    def step(s: dict | None, r: dict) -> tuple[dict, dict]:
        s, o = state.phase_and_throttle(s, r)
        return s, {"source_id": r["source_id"], "seq": r["seq"], "phase": o["phase"], "changed": o["changed"], "mode": o["mode"], "share": round(o["share"], 6)}

    return folded(_flights(spark, sf_dir), ["source_id"], ["seq"], step, "source_id long, seq long, phase string, changed boolean, mode string, share double")


@query(
    "WITH RECURSIVE "
    + cte("positions")[5:]
    + _T
    + """, g AS (SELECT source_id, n, seq, t * 20 AS t, ['submit', 'absent', 'on_disk', 'touch', 'submit', 'absent', 'absent'][CAST(seq % 7 AS INT) + 1] AS ev FROM e),
z AS (SELECT source_id, n, seq, CASE WHEN ev = 'submit' THEN 'in_progress' ELSE 'absent' END AS state, CASE WHEN ev = 'submit' THEN t END AS since, 0 AS attempts FROM g WHERE n = 1 UNION ALL
SELECT source_id, n, seq, CASE WHEN ev = 'submit' AND state = 'absent' THEN 'in_progress' WHEN ev = 'on_disk' AND stale THEN 'prefetched' WHEN ev = 'absent' AND stale THEN CASE WHEN attempts >= 2 THEN 'no_coverage' ELSE 'absent' END ELSE state END,
 CASE WHEN (ev = 'submit' AND state = 'absent') OR (ev IN ('on_disk', 'absent') AND stale) THEN t ELSE since END, CASE WHEN ev = 'absent' AND stale THEN attempts + 1 ELSE attempts END
 FROM (SELECT g.*, z.state, z.since, z.attempts, z.state = 'in_progress' AND g.t - z.since >= 120 AS stale FROM z JOIN g ON g.source_id = z.source_id AND g.n = z.n + 1))
SELECT source_id, seq, state, CAST(attempts AS INT) AS attempts FROM z"""
)
def fsm_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefetch states of a cell (here: a source) under submissions and sweeps."""
    kinds = ["submit", "absent", "on_disk", "touch", "submit", "absent", "absent"]
    d = timed(spark, sf_dir).select("source_id", "seq", (F.col("t") * 20).alias("t"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("seq") % 7 + 1).cast("int")).alias("event"))

    def step(s: dict | None, r: dict) -> tuple[dict, dict]:
        s, o = state.lifecycle(s, r)
        return s, {"source_id": r["source_id"], "seq": r["seq"], **o}

    return folded(d, ["source_id"], ["seq"], step, "source_id long, seq long, state string, attempts int")


@query(
    "WITH RECURSIVE "
    + cte("tile_requests")[5:]
    + """, g AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n, CAST(seq % 3 AS INT) AS tile, ['started', 'completed', 'completed', 'started', 'completed', 'failed'][CAST(seq * 7 % 6 AS INT) + 1] AS ev FROM tile_requests),
f AS (SELECT session_id, seq, n, ev = 'started' AS alive, CASE WHEN ev = 'started' THEN 1 ELSE 0 END AS total, 0 AS done, CASE WHEN ev = 'started' AND tile = 0 THEN 0 END AS o0, CASE WHEN ev = 'started' AND tile = 1 THEN 0 END AS o1, CASE WHEN ev = 'started' AND tile = 2 THEN 0 END AS o2 FROM g WHERE n = 1 UNION ALL
SELECT session_id, seq, n, NOT gone, CASE WHEN gone THEN 0 ELSE total END, CASE WHEN gone THEN 0 ELSE done END, o0, o1, o2 FROM
 (SELECT *, NOT alive OR (ev <> 'started' AND o0 IS NULL AND o1 IS NULL AND o2 IS NULL AND done >= total) AS gone FROM
  (SELECT session_id, seq, n, ev, alive OR ev = 'started' AS alive, CASE WHEN ev = 'started' AND cur IS NULL THEN total + 1 WHEN ev = 'failed' AND cur IS NOT NULL THEN greatest(0, total - 1) ELSE total END AS total, CASE WHEN ev = 'completed' AND cur = 1 THEN done + 1 ELSE done END AS done,
    CASE WHEN tile = 0 THEN new ELSE o0 END AS o0, CASE WHEN tile = 1 THEN new ELSE o1 END AS o1, CASE WHEN tile = 2 THEN new ELSE o2 END AS o2 FROM
   (SELECT *, CASE ev WHEN 'started' THEN coalesce(cur, 0) WHEN 'completed' THEN CASE WHEN cur = 0 THEN 1 END END AS new FROM
    (SELECT g.*, f.alive, f.total, f.done, f.o0, f.o1, f.o2, CASE g.tile WHEN 0 THEN f.o0 WHEN 1 THEN f.o1 ELSE f.o2 END AS cur FROM f JOIN g ON g.session_id = f.session_id AND g.n = f.n + 1)))))
SELECT session_id, seq, total, done FROM f"""
)
def fsm_tile_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles in work per session, row by row."""
    kinds = ["started", "completed", "completed", "started", "completed", "failed"]
    e = tables.tile_requests(spark, sf_dir)
    d = e.select("session_id", "seq", (F.col("seq") % 3).alias("tile"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("seq") * 7 % 6 + 1).cast("int")).alias("event"))

    def step(s: dict | None, r: dict) -> tuple[dict | None, dict]:
        s, o = state.progress(s, r)
        return s, {"session_id": r["session_id"], "seq": r["seq"], **o}

    return folded(d, ["session_id"], ["seq"], step, "session_id long, seq long, total int, done int")


@query(
    cte("positions")
    + """, l AS (SELECT source_id, list(heading ORDER BY seq) AS h FROM positions GROUP BY source_id)
SELECT source_id, round(list_reduce(h, lambda a, x: (a + 0.3 * (CASE WHEN x - a > 180 THEN x - a - 360 WHEN x - a < -180 THEN x - a + 360 ELSE x - a END) + 360) % 360), 3) AS heading FROM l"""
)
def fsm_heading_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a source smoothed on the circle; the last one of each."""
    d = tables.positions(spark, sf_dir).select("source_id", "seq", "heading")

    def step(s: float | None, r: dict) -> tuple[float, dict]:
        h = state.smoothed(s, r["heading"])
        return h, {"source_id": r["source_id"], "seq": r["seq"], "heading": h}

    g = folded(d, ["source_id"], ["seq"], step, "source_id long, seq long, heading double")
    return g.groupBy("source_id").agg(F.round(F.max_by("heading", "seq"), 3).alias("heading"))
