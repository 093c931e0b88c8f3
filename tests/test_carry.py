"""What cycles leave to the next, and tracks from the way flown."""

from tesserae.operators import carry
from tesserae.plans.carry import fsm_coordinator


def cells(*names, gone=None):
    return [{"dsf_lat": n, "dsf_lon": 0, "gone": gone} for n in names]


def test_left_over_comes_first():
    left, o = carry.sent([], cells(1, 2, 3, 4), True, 10, 0.6, 1.0)
    assert [c["dsf_lat"] for c in o[3]] == [1, 2] and [c["dsf_lat"] for c in left] == [3, 4]
    left[0]["gone"] = 11
    left, o = carry.sent(left, cells(7, 8), True, 12, 0.0, 1.0)  # 3 is there by now; the new box waits
    assert o[:3] == ("pending", 2, 1) and [c["dsf_lat"] for c in o[3]] == [4] and left == []
    left, o = carry.sent(left, cells(7, 8), True, 13, 0.0, 1.0)
    assert o[0] == "box" and len(o[3]) == 2


def test_held_and_put_off():
    left, o = carry.sent([], cells(1, 2), True, 0, 0.9, 1.0)
    assert len(left) == 2 and o[4] and o[3] == []
    left, o = carry.sent(left, [], False, 0, 0.1, 0.0)  # the throttle holds all back; a cycle that may not plan drains all the same
    assert len(left) == 2 and not o[4] and o[0] == "pending"
    left, o = carry.sent(cells(1, gone=3), cells(5), True, 3, 0.1, 1.0)
    assert left == [] and o[:3] == ("pending", 1, 0)  # all are there: the cycle is over
    assert carry.sent([], cells(1), False, 0, 0.1, 1.0) == ([], (None, 0, 0, [], False))


def test_carry_over_happens(spark, sf):
    got = fsm_coordinator(spark, sf).toPandas().sort_values(["source_id", "seq"])
    before = got.groupby("source_id")["pending"].shift(fill_value=0)
    assert (got["strategy"][before > 0] == "pending").all() and (before > 0).sum() > 20
    assert (got["considered"][before > 0] == before[before > 0]).all()
    assert (got["submitted"] + got["pending"] == got["planned"]).all()


def test_cycles_travel_without_their_cells(spark, sf):
    plan = fsm_coordinator(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 2 and "Join" not in plan and "Generate" not in plan, plan
    got = carry.around(50.5, 8.25, (50, 51, 7, 8), {(50, 7): 5})
    assert [(c["dsf_lat"], c["dsf_lon"], c["gone"]) for c in got] == [(50, 8, None), (50, 7, 5), (51, 8, None), (51, 7, None)]
    assert carry.around(None, 8.0, (None, None, 7, 8), {}) == []


def test_derived_track():
    s = None
    for i in range(40):
        s, o = carry.aggregated(s, float(i) / 2, "telemetry", 10.0, 50.0 + i * 0.01, 8.0, 123.0, None)
    assert len(s["path"]) == 20 and o[3:] == (0.0, "derived", True)
    for i in range(40, 200):
        s, o = carry.aggregated(s, float(i), "telemetry", 10.0, 50.4, 8.0 + i * 0.01, 123.0, None)
    assert len(s["path"]) == carry.SAMPLES and round(o[3], 6) == 90.0
    s, o = carry.aggregated(s, 201.0, "telemetry", 10.0, 50.4, 11.0, 123.0, 77.0)
    assert o[3:] == (77.0, "given", True)
    s, o = carry.aggregated(None, 0.0, "network", 10.0, 1.0, 1.0, 33.0, None)
    assert o[3:] == (33.0, "heading", True)
    s, o = carry.aggregated(None, 0.0, "manual", 100.0, 1.0, 1.0, 33.0, None)
    assert o[3:] == (None, None, False)
