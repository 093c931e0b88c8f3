"""Queries on tables larger than the test data: results stay those of the SQL, and plans hold nothing that grows with the input in one place."""

import duckdb
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tesserae import plans, registry  # noqa: F401
from tesserae.functions import geo
from tesserae.operators import catalogue, index
from tesserae.sources import files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calibration_of_many_samples(spark, tmp_path):
    q = "SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_milliseconds(range * 40) AS ts, range % 2 * 20 + 3 AS user_id, 'x' AS event_type, 1.5::DOUBLE AS value FROM range(24000)"
    with duckdb.connect() as c:
        c.execute("SET timezone = 'UTC'")
        c.execute(f"COPY ({q}) TO '{tmp_path}/events.parquet' (FORMAT parquet)").fetchall()
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'").fetchall()
        want = c.execute(registry.ORACLES["agg_calibration"]).df()
    got = registry.QUERIES["agg_calibration"](spark, str(tmp_path)).toPandas()
    columns = sorted(want.columns)
    assert list(got.n) == [24000] and rows_of(got, columns) == rows_of(want, columns)


def test_radius_join_broadcasts_no_written_out_points(spark):
    p = spark.range(30).selectExpr("id AS seq", "CAST(id AS FLOAT) AS lat", "CAST(id AS FLOAT) AS lon")
    s = spark.range(30).selectExpr("id AS place", "CAST(id + 0.5 AS FLOAT) AS p_lat", "CAST(id + 0.25 AS FLOAT) AS p_lon")
    d = index.radius_join(p, s, 45.0)
    assert "Broadcast" not in plan_of(d)
    assert sorted((r.seq, r.place) for r in d.collect()) == [(i, i) for i in range(30)]


def test_radius_join_finds_all_places_towards_the_poles(spark):
    p = spark.range(400).selectExpr("id AS seq", "CAST(id * 37 % 1800 / 10 - 90 AS FLOAT) AS lat", "CAST(id * 7919 % 3600 / 10 - 180 AS FLOAT) AS lon")
    s = spark.range(4000).selectExpr("id AS place", "CAST(id * 7727 % 18000 / 100 - 90 AS FLOAT) AS p_lat", "CAST(id * 6151 % 36000 / 100 - 180 AS FLOAT) AS p_lon")
    ends = [(-1, 90.0, 0.0), (-2, -90.0, 10.0), (-3, 60.0, 0.0), (-4, 89.25, -179.5), (-5, 80.0, 0.0)]
    p = p.union(spark.createDataFrame(ends, "seq long, lat float, lon float"))
    s = s.union(spark.createDataFrame([(-1, 90.0, 180.0), (-2, -89.5, -180.0), (-3, 60.0, 1.49), (-4, 89.5, -130.0), (-5, 80.0, -4.25)], "place long, p_lat float, p_lon float"))
    d = index.radius_join(p, s, 45.0)
    want = p.crossJoin(s).where(geo.flat_nm("lat", "lon", "p_lat", "p_lon") <= F.lit(45.0).cast("float"))
    got = sorted((r.seq, r.place) for r in d.collect())
    assert got == sorted((r.seq, r.place) for r in want.select("seq", "place").collect())
    assert {(-1, -1), (-2, -2), (-3, -3), (-4, -4), (-5, -5)} <= set(got)


@pytest.mark.parametrize("names", [["b", "a", "ab", "aé"], ["same-head-2", "same-head-10", "same-head-1", "same-hea"], ["\U0001f600", "￮", "é", "z", ""]])
def test_union_of_patches_sorts_no_files(spark, names):
    rows = [(n, f"Earth nav data/{i % 2}/{x}.dsf") for i, n in enumerate(names) for x in "xy"] + [(n, "readme.txt") for n in names] + [("0", "Earth nav data"), ("0", "readme.txt")]
    f = spark.createDataFrame(rows, "patch string, path string")
    d = catalogue.union_of_patches(f, catalogue.patches(f))
    assert "SortAggregate" not in plan_of(d)
    valid, want = set(names), {}
    for patch, path in rows:
        for k in range(path.count("/") + 1):
            p = path.rsplit("/", k)[0]
            if patch in valid:
                first, is_dir = want.get(p, (patch, False))
                want[p] = (min(first, patch, key=lambda x: x.encode()), is_dir or k > 0)
    assert {r.path: (r.patch, r.is_dir) for r in d.collect()} == want


def test_terrain_is_dealt_out_before_it_is_sorted(spark):
    made = [("a_sea.ter", 0, "LOAD_CENTER 1 2 3 4"), ("a_sea.ter", 1, "LOAD_CENTER 5.5 6.5 3 4"), ("a_sea.ter", 2, "BASE_TEX ../t/16_32_BI16.dds"), ("a_sea.ter", 3, "BASE_TEX none.png"), ("a_sea.ter", 4, "x"),
            ("b.ter", 0, "LOAD_CENTER 1 2"), ("b.ter", 1, "LOAD_CENTER x y"), ("b.ter", 2, "BASE_TEX 16_32_BI16.dds"), ("c.ter", 0, "LOAD_CENTER 1 2"), ("d.ter", 0, "x")]
    lines = spark.createDataFrame(made, "file string, n int, line string")
    d = files.terrain_of(lines)
    assert [tuple(r) for r in d.collect()] == [("a_sea.ter", 16, 32, 16, "BI", 5.5, 6.5, True)]
    tiles = files.terrain_tiles(lines.withColumn("file", F.regexp_replace("file", "^.", "16_32_BI18")), (0.0, 9.0, 0.0, 9.0))
    for plan in (plan_of(d), plan_of(tiles)):
        assert "SortAggregate" in plan and "SortAggregate" not in plan[plan.rindex("Exchange hashpartitioning(file") :], plan
