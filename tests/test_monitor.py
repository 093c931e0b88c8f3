"""The debug map is JSON that says what its tables hold, also where these are empty; the log keeps its beat."""

import json

from tesserae.operators import index, monitor

AIR = "latitude double, longitude double, heading double, track double, ground_speed double, altitude double"
BOX = "lat_min double, lat_max double, lon_min double, lon_max double"
REGIONS = "dsf_lat int, dsf_lon int, state string, fuse_hits long, fuse_misses long, prefetch_generated long"
TILES = "row long, col long, zoom int, origin string, hit boolean"


def _map(spark, air, box, regions, tiles):
    sim = spark.createDataFrame([(True, False, False, False, 2)], "paused boolean, on_ground boolean, scenery_loading boolean, replay boolean, sim_speed int")
    stats = spark.createDataFrame([(0.25, 7, 1, "Aggressive", "")], "memory_cache_hit_rate double, tiles_submitted long, deferred_cycles long, prefetch_mode string, active_strategy string")
    make = spark.createDataFrame
    lines = monitor.debug_map(make(air, AIR), sim, make(box, BOX), make(regions, REGIONS), make(tiles, TILES), stats).sort("n").collect()
    assert [r.n for r in lines] == list(range(len(lines)))
    return json.loads("\n".join(r.line for r in lines))


def test_debug_map(spark):
    regions = [(-3, 17, "mixed", 4, 0, 2), (-3, -20, "patched", 0, 0, 0), (48, 2, "in_progress", 0, 1, 0)]
    got = _map(spark, [(12.5, -7.25, 41.0, None, 130.0, 5200.0)], [(11.0, 14.0, -9.0, -5.0)], regions, [(9, 4, 12, "fuse", True), (200, 3, 12, "prefetch", False), (9, 3, 12, "fuse", False)])
    assert got["aircraft"] == {"latitude": 12.5, "longitude": -7.25, "heading": 41.0, "track": None, "ground_speed": 130.0, "altitude": 5200.0}
    assert got["regions"] == [{"lat": -3, "lon": -20, "state": "patched"}, {"lat": -3, "lon": 17, "state": "mixed", "fuse_hits": 4, "prefetch_generated": 2}, {"lat": 48, "lon": 2, "state": "in_progress", "fuse_misses": 1}]
    assert [(t["row"], t["col"], t["origin"], t["result"]) for t in got["tiles"]] == [(9, 3, "fuse", "generated"), (9, 4, "fuse", "cache_hit"), (200, 3, "prefetch", "generated")]
    assert got["sim_state"]["sim_speed"] == 2 and got["stats"]["tiles_submitted"] == 7 and got["prefetch_box"]["lat_max"] == 14.0
    empty = _map(spark, [], [], [], [])
    assert empty["aircraft"] is None and empty["prefetch_box"] is None and empty["regions"] == empty["tiles"] == []


def test_position_log(spark):
    rows = [(1, 1, 30.0, 12.5, -7.25, 41.0, 130.0, 5200.5, 10.0, "Telemetry"), (1, 2, 40.0, 12.6, -7.5, 42.0, 131.0, 5201.5, 10.0, "Telemetry"), (1, 3, 95.0, 0.0, 0.0, 0.0, 0.0, 0.0, 10.0, "Manual")]
    d = spark.createDataFrame(rows, "source_id long, seq long, t double, lat double, lon double, heading double, ground_speed double, altitude double, accuracy double, source string")
    got = [(r.tick, r.line) for r in monitor.position_log(d).sort("tick").collect()]
    assert [k for k, _ in got] == [0, 1, 2, 3, 4] and all("no position" in x for _, x in got[:2])
    assert got[2][1] == 'APT position update lat="12.60000" lon="-7.50000" hdg="42.0" gs_kt="131" alt_ft="5202" accuracy_m="10" source=Telemetry telemetry=Connected dsf_tile=+12-008'
    assert all("telemetry=Disconnected" in x and "+12-008" in x for _, x in got[3:])
    assert monitor.position_log(d.where("false")).count() == 0


def test_kept_and_submitted(spark):
    pre = spark.createDataFrame([(1, 1, "prefetched"), (2, 2, "in_progress"), (3, 3, "no_coverage")], "dsf_lat int, dsf_lon int, state string")
    some = spark.createDataFrame([(3, 3), (3, 3)], "dsf_lat int, dsf_lon int")
    assert sorted(r.dsf_lat for r in index.kept_regions(pre, some).collect()) == [2, 3]
    assert sorted(r.dsf_lat for r in index.kept_regions(pre, some.where("false")).collect()) == [1, 2, 3]
    plan = spark.createDataFrame([(c, 5, o, r, 1, 12) for c in (1, 2, 3) for o, r in ((6, 1), (6, 2), (7, 3))], "cycle long, dsf_lat int, dsf_lon int, row long, col long, zoom int")
    sent = plan.where("not (cycle = 1 and row = 2)")
    assert sorted((r.cycle, r.dsf_lon, r.tiles) for r in index.fully_submitted(plan, sent, plan.where("cycle = 3")).collect()) == [(1, 7, 1), (2, 6, 2), (2, 7, 1)]
