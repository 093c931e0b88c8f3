"""Names and texts: file names of tiles and cells, cache keys, sizes, durations, packages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import geo

U32 = 4294967295
# Backoff defaults in milliseconds, package type letters.
FIRST_DELAY_MS, MOST_DELAY_MS, GROWTH = 100.0, 30_000.0, 2.0
SORT_PREFIX = {"Z": "zz", "Y": "yz"}
FOLDER = {"Z": "ortho", "Y": "overlay"}


def _u32(text: Column) -> Column:
    """The number a text of digits stands for, null if it is not one or too large for 32 bits."""
    n = F.when(text.rlike(r"^\+?[0-9]+$"), text).try_cast("decimal(38,0)")
    return F.when(n <= U32, n.cast("long"))


def dds_name(name: Column) -> Column:
    """struct(row, col, map_type, zoom) of `..row_col_TYPEzoom.dds`; text before the row does not matter, case of the ending does."""
    p = r"([0-9]+)_([0-9]+)_([A-Za-z]+[0-9]?)([0-9]{2})\.dds$"
    g = lambda i: F.regexp_extract(name, p, i)
    row, col = _u32(g(1)), _u32(g(2))
    ok = name.rlike(p) & row.isNotNull() & col.isNotNull()
    return F.when(ok, F.struct(row.alias("row"), col.alias("col"), F.upper(g(3)).alias("map_type"), g(4).try_cast("int").alias("zoom")))


def _stem(name: Column, ending: str) -> Column:
    return F.when(F.endswith(name, F.lit(ending)), F.substring(name, F.lit(1), F.length(name) - len(ending)))


def _parts(stem: Column, exactly: bool, shortest: int) -> tuple[Column, Column, Column, Column, Column]:
    p = F.split(stem, "_")
    third = F.get(p, F.lit(2))
    zoom = F.right(third, F.lit(2))
    zoom = F.when(zoom.rlike("^[0-9]{2}$"), zoom).try_cast("int")
    row, col = _u32(F.get(p, F.lit(0))), _u32(F.get(p, F.lit(1)))
    n = (F.size(p) == 3) if exactly else (F.size(p) >= 3)
    return n & (F.length(third) >= shortest) & row.isNotNull() & col.isNotNull() & zoom.isNotNull(), row, col, third, zoom


def dds_parts(name: Column) -> Column:
    """struct(row, col, zoom, provider) by splitting: three parts or more, the zoom in the last two signs of the third, the provider
    (upper case) before it, null where that is empty."""
    ok, row, col, third, zoom = _parts(_stem(name, ".dds"), False, 2)
    provider = F.nullif(F.upper(F.substring(third, F.lit(1), F.length(third) - 2)), F.lit(""))
    return F.when(ok, F.struct(row.alias("row"), col.alias("col"), zoom.alias("zoom"), provider.alias("provider")))


def _less(stem: Column, *endings: str) -> Column:
    out = stem
    for e in reversed(endings):
        out = F.when(F.endswith(stem, F.lit(e)), F.substring(stem, F.lit(1), F.length(stem) - len(e))).otherwise(out)
    return out


def ter_tile(name: Column) -> Column:
    """struct(row, col, zoom) of the tile of a terrain file, whose name has chunk coordinates; _sea and _sea_overlay are left out."""
    ok, row, col, _, zoom = _parts(_less(_stem(name, ".ter"), "_sea_overlay", "_sea"), True, 2)
    return F.when(ok, F.struct(geo.tile_of_chunk(row).alias("row"), geo.tile_of_chunk(col).alias("col"), geo.zoom_of_chunk(zoom).alias("zoom")))


def scenery_cell(name: Column) -> Column:
    """struct(dsf_lat, dsf_lon) of the middle of the chunk a scenery file's name has, whatever its ending."""
    dots = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    ok, row, col, _, zoom = _parts(_less(dots, "_sea"), True, 3)
    return F.when(ok & name.contains("."), F.struct(geo.degree(geo.lat_of(row, zoom, 0.5)).alias("dsf_lat"), geo.degree(geo.lon_of(col, zoom, 0.5)).alias("dsf_lon")))


def cell_of_name(name: Column, ending: str = ".dsf") -> Column:
    """struct(dsf_lat, dsf_lon) of a seven-sign name such as +33-119.dsf."""
    stem = _stem(name, ending)
    return F.when(stem.rlike(r"^[+-]?[0-9]{2,3}[+-]?[0-9]{3,4}$") & (F.length(stem) == 7), F.struct(F.substring(stem, 1, 3).try_cast("int").alias("dsf_lat"), F.substring(stem, 4, 4).try_cast("int").alias("dsf_lon")))


def tile_id(name: Column, prefix: str = "zOrtho4XP_") -> Column:
    """struct(dsf_lat, dsf_lon) of a signed pair with or without a prefix, within the globe."""
    p = F.when(F.startswith(name, F.lit(prefix)), F.substring(name, F.lit(len(prefix) + 1), F.length(name))).otherwise(name)
    pat = r"^([+-]?[0-9]+)([+-][0-9]+)$"
    a, o = F.regexp_extract(p, pat, 1).try_cast("int"), F.regexp_extract(p, pat, 2).try_cast("int")
    return F.when(p.rlike(pat) & (F.length(p) >= 7) & a.between(-90, 90) & o.between(-180, 180), F.struct(a.alias("dsf_lat"), o.alias("dsf_lon")))


def cache_key(zoom, row, col) -> Column:
    return F.concat_ws(":", F.lit("tile"), geo._c(zoom).cast("string"), geo._c(row).cast("string"), geo._c(col).cast("string"))


def key_file(key: Column) -> Column:
    return F.concat(F.replace(key, F.lit(":"), F.lit("_")), F.lit(".cache"))


def file_key(name: Column) -> Column:
    stem = _stem(name, ".cache")
    return F.replace(stem, F.lit("_"), F.lit(":"))


def key_region(key: Column) -> Column:
    """Name of the cell of a key's tile; null for other keys."""
    p = F.split(key, ":")
    z, r, c = (F.get(p, F.lit(i)).try_cast("long") for i in (1, 2, 3))
    known = (F.get(p, F.lit(0)) == "tile") & (F.size(p) == 4) | (F.get(p, F.lit(0)) == "chunk") & (F.size(p) == 6)
    ok = known & z.isNotNull() & r.isNotNull() & c.isNotNull()
    return F.when(ok, geo.cell_name(geo.degree(geo.lat_of(r, z, 0.5)), geo.degree(geo.lon_of(c, z, 0.5))))


def key_path(key: Column) -> Column:
    return F.concat_ws("/", key_region(key), key_file(key))


def decimal_bytes(n: Column, per_second: bool = False) -> Column:
    """1.5 MB; units of a thousand."""
    end = "/s" if per_second else ""
    one = lambda k, unit: F.format_string(f"%.1f {unit}{end}", n.cast("double") / k)
    return F.when(n >= 1e9, one(1e9, "GB")).when(n >= 1e6, one(1e6, "MB")).when(n >= 1e3, one(1e3, "KB")).otherwise(F.format_string(f"%.0f B{end}", n.cast("double")))


def binary_bytes(n: Column) -> Column:
    """Units of 1024, without a decimal where it is whole."""
    def one(k: int, unit: str) -> Column:
        return F.when(n % k == 0, F.concat(F.floor(n / k).cast("string"), F.lit(f" {unit}"))).otherwise(F.format_string(f"%.1f {unit}", n.cast("double") / k))

    return F.when(n >= 1 << 30, one(1 << 30, "GB")).when(n >= 1 << 20, one(1 << 20, "MB")).when(n >= 1 << 10, one(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def parse_size(text: Column) -> Column:
    """Bytes of `2 GB`, `512k`, `100`; null for what is none."""
    t = F.upper(F.trim(text))
    p = r"^([0-9]+)\s*(GB|G|MB|M|KB|K)?$"
    unit = F.substring(F.regexp_extract(t, p, 2), 1, 1)
    k = F.when(unit == "G", 1 << 30).when(unit == "M", 1 << 20).when(unit == "K", 1 << 10).otherwise(1).cast("decimal(20,0)")
    return F.when(t.rlike(p), (F.regexp_extract(t, p, 1).try_cast("decimal(18,0)") * k).try_cast("long"))


def clock(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def delay_ms(attempt: Column, attempts: int) -> Column:
    """Exponential backoff before attempt 1, 2, ..; null from the last attempt on."""
    return F.when(attempt < attempts, F.least(F.lit(FIRST_DELAY_MS) * F.pow(F.lit(GROWTH), attempt - 1), F.lit(MOST_DELAY_MS)))


def mountpoint(region: Column, kind: Column, tag: str = "") -> Column:
    pick = lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), kind)
    return F.concat(pick(SORT_PREFIX), F.lit(f"{tag}_" if tag else ""), F.lower(region), F.lit("_"), pick(FOLDER))


def bumped(version: Column, part: str) -> Column:
    n = F.transform(F.split(F.substring_index(version, "-", 1), r"\."), lambda x: x.cast("long"))
    i = ("major", "minor", "patch").index(part)
    return F.concat_ws(".", *[(F.get(n, F.lit(k)) + (1 if k == i else 0) if k <= i else F.lit(0)).cast("string") for k in range(3)])


# Addresses of chunks by provider; q is the quadkey, v the session or version of the credentials.
URLS = {
    "bing": "https://ecn.t0.tiles.virtualearth.net/tiles/a{q}.jpeg?g=1",
    "arcgis": "https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/{z}/{y}/{x}",
    "usgs": "https://basemap.nationalmap.gov/arcgis/rest/services/USGSImageryOnly/MapServer/tile/{z}/{y}/{x}",
    "mapbox": "https://api.mapbox.com/v4/mapbox.satellite/{z}/{x}/{y}.jpg?access_token={key}",
    "google": "https://tile.googleapis.com/v1/2dtiles/{z}/{x}/{y}?session={v}&key={key}",
    "apple": "https://sat-cdn.apple-mapkit.com/tile?style=7&size=1&scale=1&z={z}&x={x}&y={y}&v={v}&accessKey={key}",
}


def chunk_url(provider: Column, row: Column, col: Column, zoom: Column, quadkey: Column, key: str = "", session: str = "") -> Column:
    """The address of a chunk's picture; null for an unknown provider."""
    url = F.element_at(F.create_map(*(F.lit(x) for kv in URLS.items() for x in kv)), provider)
    for name, value in {"q": quadkey, "z": zoom, "y": row, "x": col, "v": F.lit(session), "key": F.lit(key)}.items():
        url = F.replace(url, F.lit("{" + name + "}"), value.cast("string"))
    return url
