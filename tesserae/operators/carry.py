"""Look-ahead cycles with what is left over: a flight's cycles in order, the cells not sent yet carried from one to the next and filtered again there."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from math import atan2, ceil, degrees, hypot

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import flight, state
from tesserae.ship import ship

# Loads beyond which a cycle is put off, or sends this share; samples of a flight path, seconds between them, degrees it must span.
DEFER, REDUCE, REDUCED = 0.8, 0.5, 0.5
SAMPLES, SAMPLE_S, LEAST_DEG = 30, 1.0, 0.001


def scanned(df: DataFrame, keys: list[str], order: list[str], passed: list[str], args: list[str], step: Callable, schema: str) -> DataFrame:
    """For every row its columns `passed` and what step(state, *args) gives beside the new state; state is None at a key's first row. order must be
    total within a key. Columns are read as lists, a batch at a time; rows stream by and no group is gathered."""
    ship(df.sparkSession)
    d = df.select(*dict.fromkeys([*keys, *order, *passed, *args])).repartition(*keys).sortWithinPartitions(*keys, *order)
    types = d.select(*passed).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, s = None, None
        for b in batches:
            if not len(b):
                continue
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            ks, xs, out = zip(*(column(c).to_pylist() for c in keys)), zip(*(column(c).to_pylist() for c in args)), []
            for k, x in zip(ks, xs):
                if k != key:
                    key, s = k, None
                s, o = step(s, *x)
                out.append(o)
            yield pa.RecordBatch.from_arrays([*(column(c) for c in passed), *(pa.array(x, t) for x, t in zip(zip(*out), kinds))], [*passed, *names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string(schema)
    arrow = to_arrow_schema(made)
    names, kinds = arrow.names, [f.type for f in arrow]
    return d.mapInArrow(run, StructType([*types.fields, *made.fields]))


def sent(pending: list, cells: list | None, opens: bool, now, load: float, share: float) -> tuple[list, tuple]:
    """One cycle: (what is pending, (strategy, considered, planned, sent cells, deferred)).

    What the cycle before left comes first, and nothing new is planned before it is done, so what is carried never outgrows one plan. Both kinds of
    plans leave out the cells that are there by now (gone: since when). A high load puts the plan off, a lesser one and the throttle send the first
    part of it.
    """
    strategy, cells = ("pending", pending) if pending else ("box", cells or []) if opens else (None, [])
    plan = [c for c in cells if c["gone"] is None or c["gone"] > now]
    if load > DEFER and plan:
        return plan, (strategy, len(cells), len(plan), [], True)
    most = ceil(len(plan) * REDUCED) if load > REDUCE else len(plan)
    most = ceil(most * share) if share < 1 else most
    return plan[most:], (strategy, len(cells), len(plan), plan[:most], False)


def around(lat: float, lon: float, edges: tuple, gone: dict) -> list[dict]:
    """The cells between edges (south, north, west, east), nearest to a position first, with the time from when on they are there."""
    if None in edges:
        return []
    south, north, west, east = edges
    ys, xs = [(lat - (a + 0.5), a) for a in range(south, north + 1)], [(lon - (o + 0.5), o) for o in range(west, east + 1)]
    return [{"dsf_lat": a, "dsf_lon": o, "gone": gone.get((a, o))} for _, a, o in sorted((y * y + x * x, a, o) for y, a in ys for x, o in xs)]


def cycles(flights: DataFrame, layers: list[DataFrame], key: str = "source_id", order: str = "seq") -> DataFrame:
    """(key, order, phase, strategy, considered, planned, submitted, pending, deferred, cells): every cycle of every flight.

    flights: key, order, t (seconds), ts, knots, msl, load, opens (whether the cycle may plan), lat, lon, and south, north, west, east: first and last
    degrees of the cells around, to be sent by distance. layers: dsf_lat, dsf_lon, since: from when on a cell need not be fetched. Phase and
    throttle follow from knots and msl. cells of the output are those sent, in order.

    Rows travel as they are and get their cells where they are folded. The layers' cells go to all tasks: of the earth's 64,800, each once.
    """
    gone = None
    for x in layers:
        x = x.select("dsf_lat", "dsf_lon", "since")
        gone = x if gone is None else gone.unionByName(x)
    first = gone.groupBy("dsf_lat", "dsf_lon").agg(F.min("since").alias("gone")).toArrow()
    since = flights.sparkSession.sparkContext.broadcast(dict(zip(zip(first["dsf_lat"].to_pylist(), first["dsf_lon"].to_pylist()), first["gone"].to_pylist())))

    def step(s: tuple | None, t, ts, knots, msl, load, opens, lat, lon, *edges):
        machine, pending = s or (None, [])
        machine, o = state.phase_and_throttle(machine, {"t": t, "knots": knots, "msl": msl})
        cells = around(lat, lon, edges, since.value) if opens and not pending else None
        pending, (strategy, considered, planned, out, deferred) = sent(pending, cells, opens, ts, load, o["share"])
        return (machine, pending), (o["phase"], strategy, considered, planned, len(out), len(pending), deferred, ",".join(f"{x['dsf_lat']}:{x['dsf_lon']}" for x in out))

    schema = "phase string, strategy string, considered int, planned int, submitted int, pending int, deferred boolean, cells string"
    args = ["t", "ts", "knots", "msl", "load", "opens", "lat", "lon", "south", "north", "west", "east"]
    return scanned(flights, [key], [order], [key, order], args, step, schema)


def bearing(a: tuple[float, float], b: tuple[float, float]) -> float:
    d = degrees(atan2(b[1] - a[1], b[0] - a[0]))
    return d + 360.0 if d < 0 else d


def aggregated(s: dict | None, t: float, kind: str, accuracy: float, lat: float, lon: float, heading: float, track: float | None) -> tuple[dict, tuple]:
    """`flight.aggregated` with a flight path: updates of telemetry and networks are sampled, once a second at most and the last 30, and one without
    a track gets the direction from the oldest sample to the newest, if they lie far enough apart. Beside the rest: the track in use (the
    heading where there is none), where it comes from, and whether the position has vectors at all."""
    s = dict(s or {"inner": None, "path": deque(maxlen=SAMPLES), "at": None, "used": (None, None, False)})
    source = "given" if track is not None else None
    if kind in ("telemetry", "network"):
        if s["at"] is None or t - s["at"] >= SAMPLE_S:
            s["path"].append((lat, lon))
            s["at"] = t
        if track is None and len(s["path"]) > 1:
            a, b = s["path"][0], s["path"][-1]
            if hypot(b[0] - a[0], b[1] - a[1]) >= LEAST_DEG:
                track, source = bearing(a, b), "derived"
    s["inner"], o = flight.aggregated(s["inner"], {"t": t, "kind": kind, "accuracy": accuracy, "lat": lat, "lon": lon, "heading": heading})
    if o["accepted"]:
        vectors = kind in ("telemetry", "network")
        s["used"] = (track if track is not None else heading, source or "heading", True) if vectors else (None, None, False)
    return s, (o["accepted"], o["connected"], o["sent"], *s["used"])
