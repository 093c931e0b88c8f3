"""Known values and properties of the tile functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import geo, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_new_york_and_limits(spark):
    t = one(spark, geo.try_tile(F.lit(40.7128), F.lit(-74.006), F.lit(16)).alias("a"), geo.try_tile(F.lit(85.06), F.lit(0.0), F.lit(3)).alias("b"), geo.try_tile(F.lit(0.0), F.lit(180.0), F.lit(4)).alias("c"))
    assert tuple(t.a) == (24640, 19295) and t.b is None and t.c.col == 15


def test_strict_raises(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(geo.tile(F.lit(0.0), F.lit(0.0), F.lit(19))).collect()


def test_quadkeys(spark):
    r = one(spark, geo.quadkey(F.lit(5), F.lit(3), F.lit(3)).alias("a"), geo.quadkey(F.lit(0), F.lit(0), F.lit(0)).alias("b"), geo.try_from_quadkey(F.lit("213")).alias("c"), geo.try_from_quadkey(F.lit("214")).alias("d"), geo.try_from_quadkey(F.lit("")).alias("e"))
    assert (r.a, r.b, tuple(r.c), r.d, tuple(r.e)) == ("213", "", (5, 3, 3), None, (0, 0, 0))


def test_names(spark):
    r = one(spark, geo.cell_name(F.lit(0), F.lit(0)).alias("a"), geo.cell_name(F.lit(33), F.lit(-119)).alias("b"), geo.cell_label(F.lit(53), F.lit(9)).alias("c"), geo.grid_name(F.lit(-3), F.lit(-119)).alias("d"), text.cell_of_name(F.lit("+33-119.dsf")).alias("e"), text.tile_id(F.lit("zOrtho4XP_-05+012")).alias("f"))
    assert (r.a, r.b, r.c, r.d, tuple(r.e), tuple(r.f)) == ("+00+000", "+33-119", "N53E9", "-10-120", (33, -119), (-5, 12))


def test_file_names(spark):
    r = one(spark, text.dds_name(F.lit("100000_125184_BI18.dds")).alias("a"), text.dds_name(F.lit("25264_10368_GO216.dds")).alias("b"), text.dds_parts(F.lit("25264_10368_GO216.dds")).alias("c"), text.dds_name(F.lit("1_2_BI18.png")).alias("d"), text.ter_tile(F.lit("1600_3200_BI18_sea.ter")).alias("e"))
    assert tuple(r.a) == (100000, 125184, "BI", 18) and tuple(r.b) == (25264, 10368, "GO2", 16) and r.c.provider == "GO2" and r.d is None and tuple(r.e) == (100, 200, 14)


def test_sizes(spark):
    r = one(spark, text.parse_size(F.lit(" 2 gb ")).alias("a"), text.parse_size(F.lit("x")).alias("b"), text.binary_bytes(F.lit(1536)).alias("c"), text.binary_bytes(F.lit(2 << 30)).alias("d"), text.clock(F.lit(3725)).alias("e"))
    assert (r.a, r.b, r.c, r.d, r.e) == (2 << 30, None, "1.5 KB", "2 GB", "01:02:05")


@settings(max_examples=1, deadline=None, derandomize=True)
@given(st.integers(0, 2**30))
def test_round_trips_within_a_tile(spark, seed):
    p = spark.range(2000).select((F.rand(seed) * 170 - 85).alias("lat"), (F.rand(seed + 1) * 360 - 180).alias("lon"), (F.rand(seed + 2) * 18.99).cast("int").alias("zoom"))
    p = p.withColumn("t", geo.try_tile("lat", "lon", "zoom"))
    n = F.pow(F.lit(2.0), F.col("zoom"))
    bad = p.where((F.col("t.row") < 0) | (F.col("t.row") >= n) | (F.col("t.col") < 0) | (F.col("t.col") >= n))
    north, south = geo.lat_of("t.row", "zoom"), geo.lat_of("t.row", "zoom", 1.0)
    off = p.where((F.col("lat") > north + 1e-9) | (F.col("lat") < south - 1e-9) | (F.abs(F.col("lon") - geo.lon_of("t.col", "zoom", 0.5)) > 180 / n + 1e-9))
    assert bad.count() == 0 and off.count() == 0


@settings(max_examples=1, deadline=None, derandomize=True)
@given(st.just(0))
def test_every_heading_has_one_direction(spark, _):
    d = spark.range(-1440, 1440).select((F.col("id") / 2.0).alias("h"), geo.direction_index(F.col("id") / 2.0).alias("i"))
    assert d.where("i is null or i < 0 or i > 7").count() == 0
    for h, i in d.sample(0.05, 1).collect():
        assert i == int(((h % 360) + 22.5) // 45) % 8


def test_distances(spark):
    r = one(spark, geo.distance_nm(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d"), geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"))
    assert math.isclose(r.d, 60.04, abs_tol=0.01) and math.isclose(r.b, 90.0, abs_tol=1e-4)
