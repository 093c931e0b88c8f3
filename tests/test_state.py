"""State machines, overlaps, gauges, image kernels and streams."""

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import index, metrics, overlap, pixels, state
from tesserae.operators.fold import folded


def run(step, rows):
    s, out = None, []
    for r in rows:
        s, o = step(s, r)
        out.append(o)
    return out


def test_phase_needs_time_and_leaves_by_climb():
    rows = [{"t": 0.0, "knots": 50, "msl": 100}, {"t": 1.0, "knots": 50, "msl": 100}, {"t": 2.0, "knots": 50, "msl": 100}, {"t": 3.0, "knots": 90, "msl": 1100}, {"t": 4.0, "knots": 10, "msl": 1100}, {"t": 18.0, "knots": 10, "msl": 0}, {"t": 19.0, "knots": 10, "msl": 0}]
    assert [o["phase"] for o in run(state.phase, rows)] == ["ground", "ground", "transition", "cruise", "cruise", "cruise", "ground"]


def test_transition_times_out_and_the_throttle_ramps():
    rows = [{"t": float(t), "knots": 50, "msl": 0} for t in (0, 2, 91, 92, 107, 122)]
    out = run(state.phase_and_throttle, rows)
    assert [o["phase"] for o in out] == ["ground", "transition", "transition", "cruise", "cruise", "cruise"]
    assert [round(o["share"], 3) for o in out] == [1.0, 0.0, 0.0, 0.25, 0.625, 1.0]


def test_fusion_keeps_the_better_position():
    a = {"t": 0.0, "arrived": 0.0, "accuracy": 100.0, "lat": 51, "lon": 6}
    rows = [a | {"accuracy": 100_000.0, "lat": 50}, a | {"t": 1.0, "arrived": 1.0}, a | {"t": 2.0, "arrived": 2.0, "accuracy": 10.0, "lat": 52}, a | {"t": 3.0, "arrived": 3.0}, a | {"t": 40.0, "arrived": 40.0}]
    assert [o["accepted"] for o in run(state.fusion, rows)] == [True, True, True, False, True]


def test_lifecycle_gives_up_after_three():
    rows = [{"t": 200.0 * i, "event": e} for i, e in enumerate(["submit", "absent"] * 3 + ["submit"])]
    assert [o["state"] for o in run(state.lifecycle, rows)][-3:] == ["in_progress", "no_coverage", "no_coverage"]


def test_progress_counts_two_tasks():
    rows = [{"tile": 1, "event": "started"}, {"tile": 2, "event": "started"}, {"tile": 1, "event": "completed"}, {"tile": 1, "event": "completed"}, {"tile": 2, "event": "failed"}]
    assert [(o["total"], o["done"]) for o in run(state.progress, rows)] == [(1, 0), (2, 0), (2, 0), (2, 1), (0, 0)]


def test_ladder_moves_one_step():
    r = {"t": 0.0, "throughput": 1.0, "samples": 10, "baseline": 10.0, "mode": "aggressive"}
    assert [o["mode"] for o in run(state.ladder, [r, r | {"t": 10.0}, r | {"t": 900.0}, r | {"t": 1800.0, "throughput": 9.5}])] == ["opportunistic", "opportunistic", "disabled", "opportunistic"]


def test_fold_equals_plain_python(spark):
    d = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"), (F.col("id") * 37 % 11 / 4.0).alias("t"))
    step = lambda s, r: ({"x": (s or {"x": 0.0})["x"] * 0.5 + r["t"]}, {"k": r["k"], "seq": r["seq"], "x": (s or {"x": 0.0})["x"] * 0.5 + r["t"]})
    got = {(r.k, r.seq): r.x for r in folded(d, ["k"], ["seq"], step, "k long, seq long, x double").collect()}
    x = dict.fromkeys(range(7), 0.0)
    for i in range(2000):
        x[i % 7] = x[i % 7] * 0.5 + (i * 37 % 11) / 4.0
        assert got[(i % 7, i)] == x[i % 7]


def test_gauge_stops_at_zero(spark):
    kinds = ["download_completed", "download_started", "download_started", "download_completed", "download_failed", "download_failed", "download_started"]
    e = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "s int, seq int, event_type string")
    got = [r.downloads_active for r in metrics.gauge(e, ["s"], "downloads_active", ["seq"]).orderBy("seq").collect()]
    assert got == [0, 1, 2, 1, 0, 0, 1]


def tiles(spark, rows):
    return spark.createDataFrame(rows, "ref_id long, zoom int, row long, col long")


def test_overlap_needs_all_children(spark):
    low = [(-1, 16, 5, 7), (-2, 16, 6, 7)]
    high = [(i, 18, 20 + i // 4, 28 + i % 4) for i in range(16)] + [(100, 18, 24, 28), (101, 18, 24, 28), (102, 17, 10, 14)]
    t = tiles(spark, low + high)
    got = {r.ref_id: (r.children, r.coverage) for r in overlap.overlaps(t).collect()}
    assert got == {-1: (16, "complete"), -2: (1, "partial")}
    assert overlap.gaps(t).count() == 15
    ids = lambda keep: {r.ref_id for r in overlap.removals(t, keep).collect()}
    assert ids("highest") == {-1} and ids("lowest") == set(range(16)) and ids(16) == set(range(16)) and ids(18) == {-1} and ids(12) == {-1}


def test_empty_layers(spark):
    e = tiles(spark, [])
    assert overlap.overlaps(e).count() == 0 and overlap.gaps(e).count() == 0
    cells = spark.createDataFrame([(1, 2, "prefetched")], "dsf_lat int, dsf_lon int, state string")
    assert index.kept_regions(cells, cells.where("false")).count() == 1
    assert index.kept_regions(cells, cells.where("true").withColumn("dsf_lat", F.lit(9))).count() == 0


def test_versions(spark):
    v = lambda x: index.version_parts(F.lit(x))
    r = spark.range(1).select((v("1.10.0") > v("1.9.9")).alias("a"), (v("1.0.0-rc1") < v("1.0.0")).alias("b"), (v("1.0.0") >= v("1.0.0")).alias("c")).first()
    assert all(r)


def bc1_plain(px):
    q = lambda c: (c[0] >> 3 << 11) | (c[1] >> 2 << 5) | (c[2] >> 3)
    u = lambda c: [(c >> 11) << 3 | (c >> 11) >> 2, (c >> 5 & 63) << 2 | (c >> 5 & 63) >> 4, (c & 31) << 3 | (c & 31) >> 2]
    a, b = q([max(p[i] for p in px) for i in range(3)]), q([min(p[i] for p in px) for i in range(3)])
    a, b = max(a, b), min(a, b)
    x, y = u(a), u(b)
    pal = [x, y, [(2 * i + j) // 3 for i, j in zip(x, y)], [(i + 2 * j) // 3 for i, j in zip(x, y)]]
    bits = 0
    for i, p in enumerate(px):
        d = [((p[0] - c[0]) * 3) ** 2 + ((p[1] - c[1]) * 6) ** 2 + (p[2] - c[2]) ** 2 for c in pal]
        bits |= d.index(min(d)) << 2 * i
    return a.to_bytes(2, "little") + b.to_bytes(2, "little") + bits.to_bytes(4, "little")


def test_blocks():
    px = np.random.default_rng(1).integers(0, 256, (50, 16, 4), dtype=np.uint8)
    got = pixels.bc1(px)
    for g, p in zip(got, px):
        assert g.tobytes() == bc1_plain([[int(v) for v in q] for q in p])
    flat = np.full((1, 16, 4), 128, np.uint8)
    assert pixels.bc3(flat)[0, :2].tolist() == [128, 128] and pixels.bc3(px).shape == (50, 16)


def test_texture_size():
    image = np.zeros((64, 64, 4), np.uint8)
    t = pixels.texture(image, "BC1", 3)
    assert t[:4] == b"DDS " and len(t) == 128 + (256 + 64 + 16) * 8
    assert [x.shape[:2] for x in pixels.halvings(np.zeros((5, 4, 4), np.uint8))] == [(5, 4), (2, 2), (1, 1)]


def test_stream_equals_batch(spark, sf):
    from tesserae import plans  # noqa: F401  fills the registry
    from tesserae.registry import QUERIES

    got = {r.seq: r.accepted for r in QUERIES["stream_fusion"](spark, sf).collect()}
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").orderBy("o_orderkey").collect()
    acc, s = [10.0, 10.0, 100.0, 100_000.0], {}
    for c, k in o:
        s[c], out = state.fusion(s.get(c), {"t": k * 3.0, "arrived": k * 3.0, "accuracy": acc[k % 4], "lat": 0.0, "lon": 0.0})
        assert got[k] == out["accepted"]
