"""Web-Mercator tiles, chunks, quadkeys, one-degree cells, bearings and distances as column expressions.

Rows count from the north, columns from the west. A chunk is a sixteenth of a tile's side, four zoom levels deeper. Strict
functions raise on invalid input, those named try_* give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_LAT = 85.05112878
MAX_ZOOM = 18
CHUNKS = 16
CHUNK_LEVELS = 4
EARTH_NM = 3440.065
DIRECTIONS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
#: code: inclusive latitude and longitude ranges; Antarctica's latitude is open at -60.
REGIONS = {
    "ant": [(-90, -61, -180, 180)],
    "afr": [(-35, 37, -18, 52)],
    "asia": [(0, 80, 52, 180), (0, 80, -180, -170)],
    "aus": [(-50, 0, 110, 180)],
    "eur": [(35, 72, -25, 52)],
    "na": [(15, 85, -170, -50)],
    "sa": [(-60, 15, -90, -30)],
}


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _side(zoom: Column) -> Column:
    return F.pow(F.lit(2.0), zoom)


def valid(lat, lon, zoom) -> Column:
    lat, lon, zoom = map(_c, (lat, lon, zoom))
    return lat.between(-MAX_LAT, MAX_LAT) & lon.between(-180, 180) & zoom.between(0, MAX_ZOOM)


def _cell(fraction: Column, zoom: Column) -> Column:
    n = _side(zoom)
    return F.greatest(F.lit(0), F.least(F.floor(fraction * n).cast("long"), (n - 1).cast("long")))


def _row(lat: Column, zoom: Column) -> Column:
    return _cell((F.lit(1.0) - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2, zoom)


def _col(lon: Column, zoom: Column) -> Column:
    return _cell((lon + 180) / 360, zoom)


def try_tile(lat, lon, zoom) -> Column:
    """struct(row, col) of the tile that holds a point; null where the point or the zoom is out of range."""
    a, o, z = map(_c, (lat, lon, zoom))
    return F.when(valid(a, o, z), F.struct(_row(a, z).alias("row"), _col(o, z).alias("col")))


def tile(lat, lon, zoom) -> Column:
    """As try_tile, but an error where there is no tile."""
    t = try_tile(lat, lon, zoom)
    return F.when(t.isNotNull(), t).otherwise(F.raise_error(F.lit("point or zoom out of range")).cast("struct<row:bigint,col:bigint>"))


def try_chunk(lat, lon, zoom) -> Column:
    """struct(row, col, chunk_row, chunk_col): the tile and the chunk within it."""
    a, o, z = map(_c, (lat, lon, zoom))
    r, c = _row(a, z + CHUNK_LEVELS), _col(o, z + CHUNK_LEVELS)
    return F.when(valid(a, o, z), F.struct(_row(a, z).alias("row"), _col(o, z).alias("col"), F.pmod(r, F.lit(CHUNKS)).alias("chunk_row"), F.pmod(c, F.lit(CHUNKS)).alias("chunk_col")))


def lat_of(row, zoom, within: float = 0.0) -> Column:
    """Latitude of a tile's northern edge, or of a place `within` it (0 to 1 from the north)."""
    r, z = map(_c, (row, zoom))
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - 2 * (r + within) / _side(z)))))


def lon_of(col, zoom, within: float = 0.0) -> Column:
    c, z = map(_c, (col, zoom))
    return (c + within) / _side(z) * 360 - 180


def quadkey(row, col, zoom) -> Column:
    """One digit per level, the column's bit plus twice the row's; empty at zoom 0."""
    r, c, z = map(_c, (row, col, zoom))
    digit = lambda i: F.call_function("shiftright", r, i - 1).bitwiseAND(F.lit(1)) * 2 + F.call_function("shiftright", c, i - 1).bitwiseAND(F.lit(1))
    return F.when(z > 0, F.array_join(F.transform(F.sequence(F.greatest(z, F.lit(1)), F.lit(1), F.lit(-1)), lambda i: digit(i).cast("string")), "")).when(z == 0, "")


def try_from_quadkey(key) -> Column:
    """struct(row, col, zoom); null where a digit is not 0 to 3 or there are over 18."""
    k = _c(key)
    digits = F.filter(F.split(k, ""), lambda d: d != "")
    start = F.struct(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"))
    step = lambda a, d: F.struct((a["row"] * 2 + F.floor(d.cast("int") / 2)).alias("row"), (a["col"] * 2 + d.cast("int") % 2).alias("col"))
    at = F.aggregate(digits, start, step)
    return F.when(k.rlike("^[0-3]{0,18}$"), F.struct(at["row"].alias("row"), at["col"].alias("col"), F.length(k).alias("zoom")))


def parent(x, levels) -> Column:
    """Row or column of the ancestor an even, positive number of levels up; null otherwise."""
    n = _c(levels)
    return F.when((n > 0) & (n % 2 == 0), F.call_function("shiftright", _c(x), n))


def tile_of_chunk(x) -> Column:
    return F.call_function("shiftright", _c(x), F.lit(CHUNK_LEVELS))


def zoom_of_chunk(zoom) -> Column:
    return F.greatest(_c(zoom) - CHUNK_LEVELS, F.lit(0))


def degree(x) -> Column:
    """South or west corner of the one-degree cell that holds a coordinate."""
    return F.floor(_c(x)).cast("int")


def cell_name(lat, lon) -> Column:
    """+33-119."""
    return F.printf(F.lit("%+03d%+04d"), _c(lat).cast("int"), _c(lon).cast("int"))


def cell_label(lat, lon) -> Column:
    """N53E9."""
    a, o = map(_c, (lat, lon))
    return F.concat(F.when(a >= 0, "N").otherwise("S"), F.abs(a).cast("string"), F.when(o >= 0, "E").otherwise("W"), F.abs(o).cast("string"))


def grid_name(lat, lon) -> Column:
    """Name of the ten-degree block of a cell."""
    return cell_name(F.floor(_c(lat) / 10) * 10, F.floor(_c(lon) / 10) * 10)


def shifted(lat, lon, d_lat, d_lon) -> tuple[Column, Column]:
    """A cell moved by degrees: latitude stays within -90 to 89, longitude wraps."""
    return F.least(F.greatest(_c(lat) + d_lat, F.lit(-90)), F.lit(89)), F.pmod(_c(lon) + d_lon + 180, F.lit(360)) - 180


def lon_tiles(lat, extent: float = 3.0) -> Column:
    """One-degree columns that span as much ground as `extent` degrees at the equator; the shrinking stops at a tenth."""
    return F.ceil(F.lit(extent) / F.greatest(F.abs(F.cos(F.radians(_c(lat)))), F.lit(0.1)))


def tile_size_nm(lat, zoom) -> Column:
    return F.lit(2 * math.pi * EARTH_NM) / _side(_c(zoom)) * F.cos(F.radians(F.abs(_c(lat))))


def _wrapped(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


def _clamped(lat: Column) -> Column:
    return F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT))


def projected(lat, lon, heading, nm) -> tuple[Column, Column]:
    """Great-circle destination after nm nautical miles on an initial heading."""
    a, o, h, d = F.radians(_c(lat)), F.radians(_c(lon)), F.radians(_c(heading)), _c(nm) / EARTH_NM
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(h))
    lon2 = F.degrees(o + F.atan2(F.sin(h) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to)))
    return _clamped(F.degrees(to)), _wrapped(lon2)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing, 0 to 360, as float."""
    a, b, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    x = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.when(x < 0, x + 360).otherwise(x).cast("float")


def distance_nm(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance as float."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    half = lambda p, q: F.pow(F.sin(F.radians(_c(q) - _c(p)) / 2), 2)
    return (F.lit(2 * EARTH_NM) * F.asin(F.sqrt(half(lat1, lat2) + F.cos(a) * F.cos(b) * half(lon1, lon2)))).cast("float")


def flat_nm(lat1, lon1, lat2, lon2) -> Column:
    """Flat-earth distance in float steps, by the first point's latitude."""
    f = lambda x: x.cast("float")
    a, o, b, p = (f(_c(x)) for x in (lat1, lon1, lat2, lon2))
    y = f(f(b - a) * F.lit(60.0).cast("float"))
    x = f(f(f(p - o) * F.lit(60.0).cast("float")) * f(F.cos(f(F.radians(a)))))
    return f(F.sqrt(f(f(y * y) + f(x * x))))


def turn(bearing_: Column, heading) -> Column:
    """Difference of a bearing from a heading, within -180 to 180."""
    d = bearing_ - _c(heading)
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def heading(x) -> Column:
    return F.pmod(_c(x), F.lit(360.0))


def flat_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Direction on the plate, 0 to 360."""
    return heading(F.degrees(F.atan2(_c(lon2) - _c(lon1), _c(lat2) - _c(lat1))))


def ahead(lat, lon, heading_, knots, seconds) -> tuple[Column, Column]:
    """Dead reckoning on the flat earth."""
    d = _c(knots) / 3600 * _c(seconds) / 60
    h = F.radians(_c(heading_))
    return _clamped(_c(lat) + d * F.cos(h)), _wrapped(_c(lon) + d * F.sin(h) / F.cos(F.radians(_c(lat))))


def changed(lat, lon, heading_, knots, lat0, lon0, heading0, knots0) -> Column:
    """Over 15 degrees of heading, a fifth of the old speed, or a hundredth of a degree."""
    h = F.abs(_c(heading_) - _c(heading0))
    h = F.when(h > 180, 360 - h).otherwise(h)
    v = (_c(knots0) > 1) & (F.abs(_c(knots) - _c(knots0)) > _c(knots0) * 0.2)
    return (h > 15) | v | (F.abs(_c(lat) - _c(lat0)) > 0.01) | (F.abs(_c(lon) - _c(lon0)) > 0.01)


def extent(knots, slow: float = 40, fast: float = 450, least: float = 3.5, most: float = 7.0) -> Column:
    """Degrees to look ahead: from least to most between the two speeds."""
    t = F.lit(1.0) if fast <= slow else F.least(F.greatest((_c(knots) - slow) / (fast - slow), F.lit(0.0)), F.lit(1.0))
    return F.lit(least) + t * (most - least)


def direction_index(heading_) -> Column:
    """0 to 7, clockwise from north, each 45 degrees wide about its middle."""
    return F.pmod(F.floor((heading(heading_) + 22.5) / 45), F.lit(8)).cast("int")


def direction(heading_) -> Column:
    return F.element_at(F.array(*map(F.lit, DIRECTIONS)), direction_index(heading_) + 1)


def seconds_to_trigger(lat, knots) -> Column:
    """Until the cell's northern edge plus 0.6 degrees, as if northbound; null when almost still."""
    v = _c(knots) * 1.852 / (111.0 * 3600.0)
    return F.when(v >= 0.0001, (F.lit(1.6) - (_c(lat) - F.floor(_c(lat)))) / v)


def fits_in_time(lat, knots, required_ms, margin: float) -> Column:
    t = seconds_to_trigger(lat, knots)
    return t.isNull() | (_c(required_ms) / 1000 <= t * margin)


def regions_of(lat, lon) -> Column:
    """Codes of all world regions whose boxes hold a cell, in code order of REGIONS."""
    a, o = map(_c, (lat, lon))
    hit = [F.when(_any(a, o, boxes), F.lit(code)) for code, boxes in REGIONS.items()]
    return F.filter(F.array(*hit), lambda x: x.isNotNull())


def _any(a: Column, o: Column, boxes: list[tuple[int, int, int, int]]) -> Column:
    out = F.lit(False)
    for s, n, w, e in boxes:
        out = out | (a.between(s, n) & o.between(w, e))
    return out


def edge_direction(row, col, min_row, max_row, min_col, max_col) -> Column:
    """On which side of its bounding box a tile lies, null inside.

    A corner is its own direction. Elsewhere an edge counts as itself within a third of the box's width of the middle, and as the
    nearer corner beyond. Opposite edges at once (a box one tile wide) give no direction on that axis.
    """
    r, c, r0, r1, c0, c1 = map(_c, (row, col, min_row, max_row, min_col, max_col))
    north, south, west, east = (r == r0) & (r != r1), (r == r1) & (r != r0), (c == c0) & (c != c1), (c == c1) & (c != c0)
    dr, dc = r - F.floor((r0 + r1) / 2), c - F.floor((c0 + c1) / 2)
    mid_c, mid_r = F.abs(dc) < F.floor((c1 - c0) / 3), F.abs(dr) < F.floor((r1 - r0) / 3)
    on_row, on_col = north | south, west | east
    rows = F.when(north, "N").when(south, "S").otherwise("")
    cols = F.when(west, "W").when(east, "E").otherwise("")
    return (
        F.when(on_row & on_col, F.concat(rows, cols))
        .when(on_row & mid_c, rows)
        .when(on_col & mid_r, cols)
        .when(on_row, F.concat(rows, F.when(dc < 0, "W").otherwise("E")))
        .when(on_col, F.concat(F.when(dr < 0, "N").otherwise("S"), cols))
    )
