"""Transitions of the state machines: pure functions from (state, row) to (state, output), for batch folds and streams alike."""

from __future__ import annotations

# Thresholds in knots, feet and seconds, shares, metres of accuracy by source.
GROUND_KT = 40.0
CLIMB_FT = 1000.0
TAKEOFF_S, HOLD_S, LANDING_S = 90.0, 2.0, 15.0
RAMP_S, RAMP_START = 30.0, 0.25
STALE_S = 30.0
SAMPLE_S = 1.0
ACCURACY_M = {"telemetry": 10.0, "network": 10.0, "manual": 100.0, "inference": 100_000.0}
ATTEMPTS = 3
REGION_STALE_S = 120.0


def phase(state: dict | None, r: dict) -> tuple[dict, dict]:
    """Ground, transition, cruise. r: t, knots, msl. Leaving the ground always leads through transition; climbing out of it or staying long
    enough leads to cruise at once, slowing down must last."""
    s = dict(state or {"phase": "ground", "since": r["t"], "msl": None, "want": None, "from": None})
    raw = "ground" if r["knots"] < GROUND_KT else "cruise"
    to = None
    if s["phase"] == "transition" and (s["msl"] is not None and r["msl"] - s["msl"] >= CLIMB_FT or r["t"] - s["since"] >= TAKEOFF_S):
        to = "cruise"
    else:
        if s["phase"] == "transition":
            want = "ground" if raw == "ground" else None
        else:
            want = None if raw == s["phase"] else "transition" if s["phase"] == "ground" else raw
        if want is None:
            s["want"] = s["from"] = None
        elif s["want"] == want:
            if r["t"] - s["from"] >= (LANDING_S if s["phase"] == "cruise" else HOLD_S):
                to = want
        else:
            s["want"], s["from"] = want, r["t"]
    if to:
        s = {"phase": to, "since": r["t"], "msl": r["msl"] if to == "transition" else None, "want": None, "from": None}
    return s, {"phase": s["phase"], "changed": bool(to)}


def throttle(state: dict | None, r: dict) -> tuple[dict, dict]:
    """Held in transition, a ramp after it, else free. r: t, phase, changed. Gives the share of a plan to send."""
    s = dict(state or {"mode": "idle", "since": None})
    if r["changed"]:
        if r["phase"] == "transition":
            s = {"mode": "held", "since": None}
        elif r["phase"] == "ground":
            s = {"mode": "idle", "since": None}
        elif s["mode"] == "held":
            s = {"mode": "ramping", "since": r["t"]}
    if s["mode"] == "ramping" and r["t"] - s["since"] >= RAMP_S:
        s = {"mode": "idle", "since": None}
    share = {"idle": 1.0, "held": 0.0}.get(s["mode"])
    if share is None:
        share = RAMP_START + (r["t"] - s["since"]) / RAMP_S * (1 - RAMP_START)
    return s, {"mode": s["mode"], "share": share}


def phase_and_throttle(state: dict | None, r: dict) -> tuple[dict, dict]:
    a, b = (state["phase"], state["throttle"]) if state else (None, None)
    a, out = phase(a, r)
    b, more = throttle(b, {"t": r["t"], **out})
    return {"phase": a, "throttle": b}, out | more


def fusion(state: dict | None, r: dict) -> tuple[dict, dict]:
    """The current position: r (t, accuracy, lat, lon) replaces it if it is more accurate, equally accurate and newer, or the current one is
    stale. Staleness is measured at the row's arrival."""
    ok = state is None or r["accuracy"] < state["accuracy"] or r["arrived"] - state["t"] > STALE_S or r["accuracy"] == state["accuracy"] and r["t"] > state["t"]
    s = {k: r[k] for k in ("t", "accuracy", "lat", "lon")} if ok else state
    return s, {"accepted": ok, "lat": s["lat"], "lon": s["lon"], "accuracy": s["accuracy"]}


def sampled(state: dict | None, r: dict) -> tuple[dict, dict]:
    """A sample is taken a second or more after the last that was taken."""
    ok = state is None or r["t"] - state["t"] >= SAMPLE_S
    return ({"t": r["t"]} if ok else state), {"taken": ok}


def lifecycle(state: dict | None, r: dict) -> tuple[dict, dict]:
    """A cell's prefetch: r (t, event). submit: in progress; on_disk and absent are sweeps that found its tiles or did not.

    A sweep acts on cells in progress for long enough: found ones are prefetched, others go back and may be submitted again, until the third
    time, when there is no coverage. touch leaves all as it is.
    """
    s = dict(state or {"state": "absent", "since": None, "attempts": 0})
    stale = s["state"] == "in_progress" and r["t"] - s["since"] >= REGION_STALE_S
    if r["event"] == "submit" and s["state"] == "absent":
        s |= {"state": "in_progress", "since": r["t"]}
    elif r["event"] == "on_disk" and stale:
        s |= {"state": "prefetched", "since": r["t"]}
    elif r["event"] == "absent" and stale:
        s["attempts"] += 1
        s |= {"state": "no_coverage" if s["attempts"] >= ATTEMPTS else "absent", "since": r["t"]}
    return s, {"state": s["state"], "attempts": s["attempts"]}


def progress(state: dict | None, r: dict) -> tuple[dict | None, dict]:
    """A cell's tiles in work: r (tile, event). started adds a tile, the second completed finishes it, failed takes it out; a cell that has
    nothing left is forgotten."""
    s = {"total": state["total"], "done": state["done"], "open": dict(state["open"])} if state else None
    tile = r["tile"]
    if r["event"] == "started":
        s = s or {"total": 0, "done": 0, "open": {}}
        if tile not in s["open"]:
            s["total"] += 1
            s["open"][tile] = 0
    elif s:
        if r["event"] == "completed":
            if tile in s["open"]:
                s["open"][tile] += 1
                if s["open"][tile] >= 2:
                    s["done"] += 1
                    del s["open"][tile]
        elif tile in s["open"]:
            del s["open"][tile]
            s["total"] = max(0, s["total"] - 1)
        if not s["open"] and s["done"] >= s["total"]:
            s = None
    return s, {"total": s["total"] if s else 0, "done": s["done"] if s else 0}


def ladder(state: dict | None, r: dict) -> tuple[dict, dict]:
    """Recalibration: r (t, throughput, samples, baseline, mode). At most every 900 s with ten samples the mode moves one step down below 0.7 of
    the baseline, one up above 0.9."""
    modes = ["disabled", "opportunistic", "aggressive"]
    s = dict(state or {"last": None, "mode": r["mode"]})
    if (s["last"] is None or r["t"] - s["last"] >= 900.0) and r["samples"] >= 10:
        s["last"] = r["t"]
        i = modes.index(s["mode"])
        step = -1 if r["throughput"] < 0.7 * r["baseline"] else 1 if r["throughput"] > 0.9 * r["baseline"] else 0
        s["mode"] = modes[min(2, max(0, i + step))]
    return s, {"mode": s["mode"]}


def smoothed(heading: float | None, new: float, weight: float = 0.3) -> float:
    """A heading moved towards a new one by a share of the shorter turn between them."""
    if heading is None:
        return new
    d = new - heading
    d = d - 360 if d > 180 else d + 360 if d < -180 else d
    return (heading + weight * d + 360) % 360
