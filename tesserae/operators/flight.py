"""Operators over flights: position sources put together, gates of the look-ahead, the frontier of what is loaded and where it moves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import geo
from tesserae.operators import state

# Names of simulator values; seconds; knots; priorities of zones; degrees, tiles and shares of the cone.
SIM_FLAGS = ("paused", "on_ground", "scenery_loading", "replay")
TELEMETRY_TIMEOUT_S, BROADCAST_S = 5.0, 1.0
LEAST_KT = 30.0
ZONES = {"forward_center": 0, "forward_edge": 100, "lateral_buffer": 200, "rear_buffer": 300}
CONE, WIDER, CONFIDENT, LATERAL, DEPTH = 45.0, 15.0, 0.5, 1.75, 4
HISTORY = 10
STEPS = {"N": (-1, 0), "NE": (-1, 1), "E": (0, 1), "SE": (1, 1), "S": (1, 0), "SW": (1, -1), "W": (0, -1), "NW": (-1, -1)}


def aggregated(s: dict | None, r: dict) -> tuple[dict, dict]:
    """Updates of all kinds of sources to one position: r (t, kind, accuracy, lat, lon, heading). Telemetry connects, and what is read five seconds
    after the last of it is not connected; others never connect. Accepted updates are sent on, once a second at most. Only a position of
    telemetry or a network has a track."""
    s = dict(s or {"model": None, "telemetry": None, "sent": None, "track": None})
    if r["kind"] == "telemetry":
        s["telemetry"] = r["t"]
    s["model"], o = state.fusion(s["model"], r | {"arrived": r["t"]})
    sent = o["accepted"] and (s["sent"] is None or r["t"] - s["sent"] >= BROADCAST_S)
    if sent:
        s["sent"] = r["t"]
    if o["accepted"]:
        s["track"] = r["heading"] if r["kind"] in ("telemetry", "network") else None
    return s, {"accepted": o["accepted"], "connected": s["telemetry"] is not None and r["t"] - s["telemetry"] <= TELEMETRY_TIMEOUT_S, "sent": sent, "track": s["track"]}


def sim_state(values: Column) -> Column:
    """struct of the simulator's flags and speed from a map of values; what is missing does not hold anything back."""
    flag = lambda k: F.coalesce(F.try_element_at(values, F.lit(k)).cast("int") != 0, F.lit(False)).alias(k)
    return F.struct(*map(flag, SIM_FLAGS), F.coalesce(F.try_element_at(values, F.lit("sim_speed")).cast("int"), F.lit(1)).alias("sim_speed"))


def may_look_ahead(sim: Column) -> Column:
    """Not while scenery loads or a replay runs; pauses and the ground do not matter."""
    return ~sim["scenery_loading"] & ~sim["replay"]


def fast_enough(speed: Column, condition: str = "speed") -> Column:
    return {"speed": speed >= LEAST_KT, "always": F.lit(True), "never": F.lit(False)}[condition]


def half_angle(confidence: Column) -> Column:
    return F.when(confidence < CONFIDENT, F.lit(CONE + WIDER)).otherwise(F.lit(CONE))


def lateral_depth(depth: Column) -> Column:
    return F.ceil(depth * LATERAL).cast("int")


def frontier(tiles: DataFrame, by: list[str]) -> DataFrame:
    """tiles (by, row, col), distinct, with their bounds (r0, r1, c0, c1) and the side of them that a tile is on; null inside."""
    b = tiles.groupBy(*by).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    return tiles.join(b, by).withColumn("direction", geo.edge_direction("row", "col", "r0", "r1", "c0", "c1"))


def expanded(edges: DataFrame, tiles: DataFrame, by: list[str], depth: int = DEPTH, base: int = ZONES["forward_edge"]) -> DataFrame:
    """(by, row, col, priority): the tiles `depth` steps outwards of the frontier's, without those that are there already. A tile that more than
    one step reaches has the nearest one's priority."""
    step = F.create_map(*(x for k, v in STEPS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("dr"), F.lit(v[1]).alias("dc")))))[F.col("direction")]
    d = edges.where("direction is not null").withColumn("step", step).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(depth))))
    d = d.select(*by, (F.col("row") + F.col("step.dr") * F.col("d")).alias("row"), (F.col("col") + F.col("step.dc") * F.col("d")).alias("col"), "d").where("row >= 0 and col >= 0")
    return d.groupBy(*by, "row", "col").agg((F.min("d") + base).cast("int").alias("priority")).join(tiles, [*by, "row", "col"], "left_anti")


def movement(snapshots: DataFrame, key: str, order: str, history: int = HISTORY) -> DataFrame:
    """(key, order, direction, score) of the way the frontier grows from the oldest of the last snapshots to each: its tiles on that side, and twice
    the move of the bounds. Null where nothing grows; of equal scores the first from north clockwise counts.

    snapshots: key, order, r0, r1, c0, c1 and one column of tiles per direction.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - history, 0)
    was = {c: F.first(c).over(w) for c in ("r0", "r1", "c0", "c1", *STEPS)}
    s = snapshots.select("*", *[c.alias(f"was_{k}") for k, c in was.items()], F.count("*").over(w).alias("seen"))
    grown = {"N": F.col("was_r0") - F.col("r0"), "S": F.col("r1") - F.col("was_r1"), "E": F.col("c1") - F.col("was_c1"), "W": F.col("was_c0") - F.col("c0")}
    score = {k: F.col(k) - F.col(f"was_{k}") + 2 * reduce(Column.__add__, (grown[x] for x in k)) for k in STEPS}
    best = F.greatest(*(F.struct(c.cast("long").alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("direction")) for i, (k, c) in enumerate(score.items())))
    best = F.when((F.col("seen") > 1) & (best["score"] > 0), best)
    return s.select(key, order, best["direction"].alias("direction"), best["score"].alias("score"))


def coordinated(cycles: DataFrame, cells: DataFrame, done: DataFrame) -> DataFrame:
    """One plan per cycle: cycles (cycle, sim, mode, phase, share), their cells (cycle, dsf_lat, dsf_lon, near) and the cells that are prefetched or in
    progress (dsf_lat, dsf_lon). Gives cycle, dsf_lat, dsf_lon, place of the cells to submit.

    A cycle plans while the simulator lets it, the mode is not disabled and the flight is not in transition; cells that are done are left out,
    the nearest come first, and the share of them that the throttle allows is sent. What is not sent is in the next cycle's cells again,
    as long as it is in its box, and is filtered there once more.
    """
    open_ = cycles.where(may_look_ahead(F.col("sim")) & (F.col("mode") != "disabled") & (F.col("phase") != "transition"))
    plan = cells.join(done.select("dsf_lat", "dsf_lon").distinct(), ["dsf_lat", "dsf_lon"], "left_anti").join(open_.select("cycle", "share"), "cycle")
    w = Window.partitionBy("cycle")
    plan = plan.withColumn("place", F.row_number().over(w.orderBy("near", "dsf_lat", "dsf_lon"))).withColumn("n", F.count("*").over(w))
    return plan.where(F.col("place") <= F.ceil(F.col("n") * F.col("share"))).select("cycle", "dsf_lat", "dsf_lon", "place")
