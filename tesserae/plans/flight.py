"""Position sources put together, gates and cycles of the look-ahead, frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import generate, geo
from tesserae.operators import flight, state
from tesserae.operators.fold import folded
from tesserae.plans.agg import _EDGE, _LAT, _LON, with_cells
from tesserae.plans.fsm import _T, timed
from tesserae.registry import query
from tesserae.sources import tables
from tesserae.sources.tables import cte

_KIND = "['telemetry', 'network', 'manual', 'inference', 'inference'][CAST(seq % 5 AS INT) + 1]"
_ACC = "[10.0, 10.0, 100.0, 100000.0, 100000.0][CAST(seq % 5 AS INT) + 1]::DOUBLE"
_KINDS = ("telemetry", "network", "manual", "inference", "inference")


@query(
    "WITH RECURSIVE "
    + cte("positions")[5:]
    + _T
    + f""", g AS (SELECT source_id, seq, n, t, heading, {_KIND} AS kind, {_ACC} AS acc FROM e),
f AS (SELECT source_id, seq, n, t, TRUE AS accepted, t AS ct, acc AS ca, CASE WHEN kind = 'telemetry' THEN t END AS tel, t AS sent_at, TRUE AS sent, CASE WHEN kind IN ('telemetry', 'network') THEN heading END AS track FROM g WHERE n = 1 UNION ALL
SELECT source_id, seq, n, t, ok, CASE WHEN ok THEN t ELSE ct END, CASE WHEN ok THEN acc ELSE ca END, CASE WHEN kind = 'telemetry' THEN t ELSE tel END, CASE WHEN ok AND t - sent_at >= 1 THEN t ELSE sent_at END, ok AND t - sent_at >= 1,
  CASE WHEN NOT ok THEN track WHEN kind IN ('telemetry', 'network') THEN heading END FROM
 (SELECT g.*, f.ct, f.ca, f.tel, f.sent_at, f.track, g.acc < f.ca OR g.t - f.ct > 30 OR (g.acc = f.ca AND g.t > f.ct) AS ok FROM f JOIN g ON g.source_id = f.source_id AND g.n = f.n + 1))
SELECT source_id, seq, accepted, coalesce(t - tel <= 5, FALSE) AS connected, sent, track FROM f"""
)
def fsm_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of updates of a flight: what is accepted and sent on, whether telemetry is connected, the track in use."""
    at = (F.col("seq") % 5 + 1).cast("int")
    kind, acc = F.element_at(F.array(*map(F.lit, _KINDS)), at), F.element_at(F.array(*[F.lit(state.ACCURACY_M[k]) for k in _KINDS]), at)
    d = timed(spark, sf_dir).select("source_id", "seq", "t", kind.alias("kind"), acc.alias("accuracy"), "lat", "lon", "heading")

    def step(s: dict | None, r: dict) -> tuple[dict, dict]:
        s, o = flight.aggregated(s, r)
        return s, {"source_id": r["source_id"], "seq": r["seq"], **o}

    return folded(d, ["source_id"], ["seq"], step, "source_id long, seq long, accepted boolean, connected boolean, sent boolean, track double")


def _sims(p: DataFrame) -> DataFrame:
    """Values as the simulator sends them; some are missing."""
    entry = lambda k, of, least: F.when(F.col("seq") % of >= least, F.struct(F.lit(k), (F.col("seq") % 2).cast("double")))
    v = F.filter(F.array(entry("paused", 3, 1), entry("on_ground", 5, 2), entry("scenery_loading", 7, 4), entry("replay", 11, 9), entry("sim_speed", 4, 2)), lambda x: x.isNotNull())
    return p.withColumn("sim", flight.sim_state(F.map_from_entries(v)))


_ODD = "(seq % {of} >= {least} AND seq % 2 <> 0)"


@query(
    cte("positions")
    + f""", s AS (SELECT *, {_ODD.format(of=3, least=1)} AS paused, {_ODD.format(of=5, least=2)} AS on_ground, {_ODD.format(of=7, least=4)} AS scenery_loading, {_ODD.format(of=11, least=9)} AS replay,
  CAST(CASE WHEN seq % 4 >= 2 THEN seq % 2 ELSE 1 END AS INT) AS sim_speed FROM positions)
SELECT seq, paused, on_ground, scenery_loading, replay, sim_speed, NOT scenery_loading AND NOT replay AS may, ground_speed >= 30 AS fast, TRUE AS always, FALSE AS never FROM s"""
)
def name_sim_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulator's state and the gates that follow from it and the speed."""
    s = _sims(tables.positions(spark, sf_dir))
    speed = F.col("ground_speed")
    return s.select("seq", "sim.*", flight.may_look_ahead(F.col("sim")).alias("may"), *[flight.fast_enough(speed, c).alias(n) for c, n in (("speed", "fast"), ("always", "always"), ("never", "never"))])


@query(
    cte("positions")
    + """, c AS (SELECT seq, seq % 11 / CAST(10 AS DOUBLE) AS conf, CAST(seq % 9 AS INT) AS depth, ['forward_center', 'forward_edge', 'lateral_buffer', 'rear_buffer'][CAST(seq % 4 AS INT) + 1] AS zone FROM positions)
SELECT seq, CASE WHEN conf < 0.5 THEN 60.0::DOUBLE ELSE 45.0::DOUBLE END AS half_angle, CAST(ceil(depth * 1.75::DOUBLE) AS INT) AS lateral, CAST((seq % 4) * 100 + depth AS INT) AS priority FROM c"""
)
def name_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of the cone by confidence, depth to the sides, priorities by zone and distance."""
    p = tables.positions(spark, sf_dir)
    depth = (F.col("seq") % 9).cast("int")
    zone = F.element_at(F.array(*map(F.lit, flight.ZONES.values())), (F.col("seq") % 4 + 1).cast("int"))
    return p.select("seq", flight.half_angle(F.col("seq") % 11 / F.lit(10.0)).alias("half_angle"), flight.lateral_depth(depth).alias("lateral"), (zone + depth).cast("int").alias("priority"))


_TILES = """t AS (SELECT DISTINCT session_id, "row" // 40 AS r, col // 40 AS c FROM tile_requests), b AS (SELECT *, min(r) OVER p AS r0, max(r) OVER p AS r1, min(c) OVER p AS c0, max(c) OVER p AS c1 FROM t WINDOW p AS (PARTITION BY session_id)),
k AS (SELECT *, r = r0 AND r <> r1 AS n, r = r1 AND r <> r0 AS s, c = c0 AND c <> c1 AS w, c = c1 AND c <> c0 AS e, r - (r0 + r1) // 2 AS dr, c - (c0 + c1) // 2 AS dc FROM b),
l AS (SELECT *, CASE WHEN n THEN 'N' WHEN s THEN 'S' ELSE '' END AS a, CASE WHEN w THEN 'W' WHEN e THEN 'E' ELSE '' END AS b FROM k),"""


def _tiles(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    r = tables.tile_requests(spark, sf_dir)
    return r.select("session_id", *more, F.floor(F.col("row") / 40).alias("row"), F.floor(F.col("col") / 40).alias("col")).distinct()


@query(
    cte("tile_requests")
    + f""", {_TILES} d AS (SELECT session_id, r, c, {_EDGE} AS direction FROM l),
x AS (SELECT session_id, r + i.range * CASE WHEN contains(direction, 'N') THEN -1 WHEN contains(direction, 'S') THEN 1 ELSE 0 END AS r, c + i.range * CASE WHEN contains(direction, 'W') THEN -1 WHEN contains(direction, 'E') THEN 1 ELSE 0 END AS c, i.range AS d
  FROM d, range(1, 5) i WHERE direction IS NOT NULL)
SELECT session_id, r AS "row", c AS col, CAST(min(d) + 100 AS INT) AS priority FROM x ANTI JOIN t USING (session_id, r, c) WHERE r >= 0 AND c >= 0 GROUP BY ALL"""
)
def gen_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four steps outwards from the frontier of each session's tiles."""
    t = _tiles(spark, sf_dir)
    return flight.expanded(flight.frontier(t, ["session_id"]), t, ["session_id"])


_SIDES = ", ".join(f"CAST(count(*) FILTER (direction = '{k}') AS BIGINT) AS \"{k}\"" for k in flight.STEPS)
_WAS = ", ".join(f'first_value("{c}") OVER h AS "was_{c}"' for c in ("r0", "r1", "c0", "c1", *flight.STEPS))
_GROWN = {"N": "(was_r0 - r0)", "S": "(r1 - was_r1)", "E": "(c1 - was_c1)", "W": "(was_c0 - c0)"}
_SCORES = " UNION ALL ".join(f"""SELECT session_id, day, {i} AS place, '{k}' AS direction, "{k}" - "was_{k}" + 2 * ({' + '.join(_GROWN[x] for x in k)}) AS score FROM h WHERE seen > 1""" for i, k in enumerate(flight.STEPS))


@query(
    cte("tile_requests")
    + f""", t AS (SELECT DISTINCT session_id % 50 AS session_id, CAST(date_trunc('day', ts) AS DATE) AS day, "row" // 40 AS r, col // 40 AS c FROM tile_requests),
b AS (SELECT *, min(r) OVER p AS r0, max(r) OVER p AS r1, min(c) OVER p AS c0, max(c) OVER p AS c1 FROM t WINDOW p AS (PARTITION BY session_id, day)),
k AS (SELECT *, r = r0 AND r <> r1 AS n, r = r1 AND r <> r0 AS s, c = c0 AND c <> c1 AS w, c = c1 AND c <> c0 AS e, r - (r0 + r1) // 2 AS dr, c - (c0 + c1) // 2 AS dc FROM b),
l AS (SELECT *, CASE WHEN n THEN 'N' WHEN s THEN 'S' ELSE '' END AS a, CASE WHEN w THEN 'W' WHEN e THEN 'E' ELSE '' END AS b FROM k), d AS (SELECT session_id, day, r0, r1, c0, c1, {_EDGE} AS direction FROM l),
o AS (SELECT session_id, day, r0, r1, c0, c1, {_SIDES} FROM d GROUP BY session_id, day, r0, r1, c0, c1),
h AS (SELECT *, {_WAS}, count(*) OVER h AS seen FROM o WINDOW h AS (PARTITION BY session_id ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
s AS ({_SCORES}), best AS (SELECT session_id, day, arg_max(direction, score * 10 - place) AS direction, max(score) AS score FROM s WHERE score > 0 GROUP BY session_id, day)
SELECT o.session_id, CAST(o.day AS VARCHAR) AS day, direction, CAST(coalesce(score, 0) AS BIGINT) AS score FROM o LEFT JOIN best USING (session_id, day)"""
)
def win_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way a session's frontier moves from day to day, over its last ten snapshots."""
    t = tables.tile_requests(spark, sf_dir).select((F.col("session_id") % 50).alias("session_id"), F.to_date("ts").alias("day"), F.floor(F.col("row") / 40).alias("row"), F.floor(F.col("col") / 40).alias("col")).distinct()
    f = flight.frontier(t, ["session_id", "day"])
    s = f.groupBy("session_id", "day", "r0", "r1", "c0", "c1").agg(*[F.count_if(F.col("direction").eqNullSafe(k)).alias(k) for k in flight.STEPS])
    return flight.movement(s, "session_id", "day").withColumns({"score": F.coalesce("score", F.lit(0).cast("long")), "day": F.col("day").cast("string")})


@query(
    cte("positions")
    + """, p AS (SELECT seq AS cycle, lat, lon, (seq % 7 >= 4 AND seq % 2 <> 0) OR (seq % 11 >= 9 AND seq % 2 <> 0) AS held, ['disabled', 'opportunistic', 'aggressive'][CAST(seq % 3 AS INT) + 1] AS mode, ['ground', 'transition', 'cruise', 'cruise'][CAST(seq % 4 AS INT) + 1] AS phase,
  [0.25, 0.5, 1.0][CAST(seq % 3 AS INT) + 1]::DOUBLE AS share FROM positions),
c AS (SELECT cycle, share, CAST(floor(lat) AS INT) + r.range AS a, CAST(floor(lon) AS INT) + k.range AS o0, abs(r.range) + abs(k.range) AS near FROM p, range(-1, 2) r, range(-1, 2) k WHERE NOT held AND mode <> 'disabled' AND phase <> 'transition'),
g AS (SELECT cycle, share, near, CAST(least(greatest(a, -90), 89) AS INT) AS dsf_lat, CAST(((o0 + 180) % 360 + 360) % 360 - 180 AS INT) AS dsf_lon FROM c),
x AS (SELECT cycle, share, dsf_lat, dsf_lon, min(near) AS near FROM g WHERE (dsf_lat * 7 + dsf_lon * 3 + 1000) % 5 <> 0 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY near, dsf_lat, dsf_lon) AS place, count(*) OVER (PARTITION BY cycle) AS n FROM x)
SELECT cycle, dsf_lat, dsf_lon, CAST(place AS INT) AS place FROM n WHERE place <= ceil(n * share)"""
)
def join_coordinator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of all cycles: gate, mode and phase, the cells around, those not done yet, the nearest first, the throttle's share."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("seq") % len(values) + 1).cast("int"))
    p = _sims(tables.positions(spark, sf_dir)).withColumns({"cycle": F.col("seq"), "mode": pick(["disabled", "opportunistic", "aggressive"]), "phase": pick(["ground", "transition", "cruise", "cruise"]), "share": pick([0.25, 0.5, 1.0])})
    cells = p.select("cycle", geo.degree("lat").alias("a"), geo.degree("lon").alias("o"), F.posexplode(generate.grid("lat", "lon", 3, 3)).alias("i", "c"))
    near = F.abs(F.floor(F.col("i") / 3) - 1) + F.abs(F.col("i") % 3 - 1)
    cells = cells.select("cycle", "c.*", near.alias("near")).groupBy("cycle", "dsf_lat", "dsf_lon").agg(F.min("near").alias("near"))
    done = cells.select("dsf_lat", "dsf_lon").distinct().where((F.col("dsf_lat") * 7 + F.col("dsf_lon") * 3 + 1000) % 5 == 0)
    return flight.coordinated(p.select("cycle", "sim", "mode", "phase", "share"), cells, done)


@query(cte("tile_requests") + f""", c AS (SELECT session_id, {_LAT} AS lat, {_LON} AS lon FROM tile_requests) SELECT session_id, round((min(lat) + max(lat)) / 2, 6) AS lat, round((min(lon) + max(lon)) / 2, 6) AS lon, 100000.0::DOUBLE AS accuracy FROM c GROUP BY session_id""")
def agg_inferred_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of what a session has loaded, as a position of low accuracy."""
    t = with_cells(tables.tile_requests(spark, sf_dir))
    middle = lambda c: F.round((F.min(c) + F.max(c)) / 2, 6).alias(c)
    return t.groupBy("session_id").agg(middle("lat"), middle("lon")).withColumn("accuracy", F.lit(state.ACCURACY_M["inference"]))
