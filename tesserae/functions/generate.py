"""Generators: rows of cells and tiles around points, along rays, in cones and boxes, as array columns to explode."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import geo

# Distances in nautical miles at which a flight path is looked ahead, and the most tiles of a disc's radius.
RINGS_NM = (5.0, 10.0, 20.0, 35.0, 50.0, 65.0, 80.0, 100.0)
MOST_RADIUS = 200


def grid(lat, lon, rows: int, cols: int) -> Column:
    """Array of (dsf_lat, dsf_lon): rows by cols cells around a point's own; even sizes reach one further to the south and west."""
    span = lambda n: F.sequence(F.lit(-(n // 2)), F.lit(n - n // 2 - 1))

    def cell(d_lat: Column, d_lon: Column) -> Column:
        a, o = geo.shifted(geo.degree(lat), geo.degree(lon), d_lat, d_lon)
        return F.struct(a.cast("int").alias("dsf_lat"), o.cast("int").alias("dsf_lon"))

    return F.flatten(F.transform(span(rows), lambda r: F.transform(span(cols), lambda c: cell(r, c))))


def box(lat, lon, track, extent, bias: float = 0.8) -> tuple[Column, Column, Column, Column]:
    """(min_lat, max_lat, min_lon, max_lon) of a box `extent` degrees wide that reaches further the way the track points."""
    out = []
    for x, part in ((lat, F.cos(F.radians(geo._c(track)))), (lon, F.sin(F.radians(geo._c(track))))):
        share = 0.5 + (bias - 0.5) * F.abs(part)
        e, at = geo._c(extent), geo._c(x)
        out += [at - e * F.when(part >= 0, 1 - share).otherwise(share), at + e * F.when(part >= 0, share).otherwise(1 - share)]
    return out[0], out[1], out[2], out[3]


def edges(bounds: tuple[Column, Column, Column, Column], buffer: int = 0) -> tuple[Column, Column, Column, Column]:
    """(south, north, west, east): the first and last whole degrees of the cells a box touches; an upper edge on a whole degree does not count. No
    wrapping."""
    s, n, w, e = bounds
    low = lambda x: F.floor(x).cast("int") - buffer
    high = lambda x: F.floor(x - 1e-9).cast("int") + buffer
    return low(s), high(n), low(w), high(e)


def box_cells(bounds: tuple[Column, Column, Column, Column], buffer: int = 0) -> Column:
    """Array of (dsf_lat, dsf_lon) of the cells a box touches, as `edges` has it."""
    s, n, w, e = edges(bounds, buffer)
    return F.flatten(F.transform(F.sequence(s, n), lambda a: F.transform(F.sequence(w, e), lambda o: F.struct(a.alias("dsf_lat"), o.alias("dsf_lon")))))


def boxed(df: DataFrame, bounds: tuple[Column, Column, Column, Column], buffer: int = 0) -> DataFrame:
    """(dsf_lat, dsf_lon) of the same cells for all rows, as rows: two sequences, one exploded after the other, in generated code. A bound is made once."""
    s, n, w, e = edges(bounds, buffer)
    d = df.select(F.inline(F.array(F.struct(s.alias("s"), n.alias("n"), w.alias("w"), e.alias("e")))))
    return d.select("w", "e", F.explode(F.sequence("s", "n")).alias("dsf_lat")).select("dsf_lat", F.explode(F.sequence("w", "e")).alias("dsf_lon"))


def sample_grid(lat, lon, zoom: int = 14) -> Column:
    """Array of the distinct tiles at four by four sample points of a one-degree cell."""
    at = F.sequence(F.lit(0), F.lit(3))
    tile = lambda r, c: geo.try_tile(geo._c(lat) + r * 0.25 + 0.125, geo._c(lon) + c * 0.25 + 0.125, F.lit(zoom))
    return F.array_distinct(F.filter(F.flatten(F.transform(at, lambda r: F.transform(at, lambda c: tile(r, c)))), lambda t: t.isNotNull()))


def ray(df: DataFrame, lat: str, lon: str, heading: str, nm: float, zoom: int, least_nm: float = 0.0) -> DataFrame:
    """df with one row (step, row, col) per tile that a ray meets, sampled at half a tile; a tile's step is its first."""
    f = lambda x: x.cast("float")
    every = f(f(geo.tile_size_nm(lat, F.lit(zoom))) * F.lit(0.5).cast("float"))
    first, last = F.floor(F.lit(least_nm).cast("float") / every).cast("int"), F.ceil(F.lit(nm).cast("float") / every).cast("int")
    d = df.withColumn("_every", every).withColumn("_i", F.explode(F.sequence(first, last))).withColumn("_d", f(f(F.col("_i")) * F.col("_every")))
    d = d.where((F.col("_d") <= nm) & (F.col("_d") >= least_nm))
    a, o = geo.projected(lat, lon, heading, F.col("_d"))
    # Inline one list of one element, so that the place is made once and not for each use in the tile's formula.
    d = d.select(*df.columns, "_i", F.inline(F.array(F.struct(a.alias("_a"), o.alias("_o")))))
    d = d.select(*df.columns, "_i", F.explode(F.array(geo.try_tile(F.col("_a"), F.col("_o"), F.lit(zoom)))).alias("_t")).where("_t is not null")
    return d.groupBy(*df.columns, F.col("_t.row").alias("row"), F.col("_t.col").alias("col")).agg(F.min("_i").alias("step"))


def _off(lat: Column, lon: Column, heading: Column, degrees: Column) -> tuple[Column, Column]:
    o = lon + degrees * F.sin(heading) / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    return geo._clamped(lat + degrees * F.cos(heading)), geo._wrapped(o)


def tile_nm(lat: Column, zoom: int) -> Column:
    return F.lit(360.0 / 2**zoom * 60) * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(0.1))


def predicted(df: DataFrame, zoom: int, key: str = "seq", angle: float = 30.0, cone_nm: float = 60.0, radius_nm: float = 60.0) -> DataFrame:
    """(key, row, col, priority) of the tiles a flight may need: its own (0), those of each ring of a cone ahead (1 and on), then a disc
    in bands of ten tiles. A tile that comes up more than once keeps its first, lowest priority."""
    rings = [d for d in RINGS_NM if d <= cone_nm]
    lat, lon, h = F.col("lat"), F.col("lon"), F.radians("heading")
    own = geo.try_tile(lat, lon, F.lit(zoom))
    base = df.where(own.isNotNull()).select(F.col(key).alias("key"), "lat", "lon", "heading", own.alias("own"), tile_nm(lat, zoom).alias("nm"))
    ring = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("priority"), F.lit(d).alias("d")) for i, d in enumerate(rings)]))
    cone = base.withColumn("ring", ring)
    a, o = _off(lat, lon, h, F.col("ring.d") / 60)
    cone = cone.select("*", F.inline(F.array(F.struct(a.alias("mid_lat"), o.alias("mid_lon"))))).withColumns({"spread": F.ceil(F.col("ring.d") * math.tan(math.radians(angle)) / F.col("nm")).cast("int")})
    cone = cone.withColumn("k", F.explode(F.sequence(-F.col("spread"), F.col("spread"))))
    a, o = _off(F.col("mid_lat"), F.col("mid_lon"), h + F.signum("k") * math.pi / 2, F.abs("k") * F.col("nm") / 60)
    mid = F.col("k") == 0
    cone = cone.select("key", "ring", F.inline(F.array(F.struct(F.when(mid, F.col("mid_lat")).otherwise(a).alias("a"), F.when(mid, F.col("mid_lon")).otherwise(o).alias("o")))))
    side = geo.try_tile(F.col("a"), F.col("o"), F.lit(zoom))
    cone = cone.select("key", side.alias("t"), F.col("ring.priority").alias("priority"))
    r = F.least(F.ceil(F.lit(radius_nm) / F.col("nm")), F.lit(MOST_RADIUS)).cast("int")
    disc = base.withColumn("r", r).withColumn("dr", F.explode(F.sequence(-F.col("r"), F.col("r")))).withColumn("dc", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    far = F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double"))
    n = 2**zoom
    place = F.struct((F.col("own.row") + F.col("dr")).alias("row"), (F.col("own.col") + F.col("dc")).alias("col"))
    disc = disc.where((far > 0) & (far <= F.col("r"))).select("key", place.alias("t"), (F.lit(len(rings) + 1) + F.floor(F.ceil(far) / 10)).cast("int").alias("priority"))
    disc = disc.where(F.col("t.row").between(0, n - 1) & F.col("t.col").between(0, n - 1))
    mine = base.select("key", F.col("own").alias("t"), F.lit(0).alias("priority"))
    every = mine.unionByName(cone.where("t is not null")).unionByName(disc)
    return every.groupBy("key", "t.row", "t.col").agg(F.min("priority").alias("priority")).withColumnRenamed("key", key)


def square(row, col, zoom, radius: int) -> Column:
    """Array of (2 * radius + 1) squared tiles, moved in to the nearest one where the map ends, so with repeats there."""
    top = F.pow(F.lit(2.0), geo._c(zoom)).cast("long") - 1
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    at = lambda x, d: F.least(F.greatest(geo._c(x) + d, F.lit(0)), top)
    return F.flatten(F.transform(steps, lambda r: F.transform(steps, lambda c: F.struct(at(row, r).alias("row"), at(col, c).alias("col")))))
