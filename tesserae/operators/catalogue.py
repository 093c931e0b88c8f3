"""Lookups in catalogues: package lists, patches and sources, airports, cache layouts, and the progress of work on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import geo, text


def find(entries: DataFrame, region: str, package_type: str | None = None) -> DataFrame:
    """The entries of a region, in any case, of one type or all."""
    hit = F.lower("title") == region.lower()
    return entries.where(hit if package_type is None else hit & (F.col("package_type") == package_type))


def regions(entries: DataFrame) -> DataFrame:
    return entries.select("title").distinct()


def airport(airports: DataFrame, icao: Column | str) -> DataFrame:
    """The airports of a code in any case."""
    return airports.where(F.upper("icao") == F.upper(icao if isinstance(icao, Column) else F.lit(icao)))


def valid_icao(code: Column) -> Column:
    """Three or four letters or digits; blanks around do not count."""
    return F.coalesce(F.trim(code).rlike("^[A-Za-z0-9]{3,4}$"), F.lit(False))


def patches(files: DataFrame) -> DataFrame:
    """(patch, dsf, ter, dds, has_nav, error) of the files (patch, path) below each patch: a patch needs a folder of navigation data with a cell file. Folders
    whose names begin with a dot are none."""
    files = files.where(~F.startswith("patch", F.lit(".")))
    top = F.substring_index("path", "/", 1)
    count = lambda folder, ending: F.count_if((top == folder) & F.endswith(F.lower("path"), F.lit(ending)))
    g = files.groupBy("patch").agg(count("Earth nav data", ".dsf").alias("dsf"), count("terrain", ".ter").alias("ter"), count("textures", ".dds").alias("dds"), F.max(top == "Earth nav data").alias("has_nav"))
    return g.withColumn("error", F.when(~F.col("has_nav"), "no_nav_data").when(F.col("dsf") == 0, "no_cells"))


def discovered(patch_states: DataFrame, packages: DataFrame) -> DataFrame:
    """(sort_key, name, is_patch) of the sources in use: valid patches, and enabled ortho packages (region, package_type, enabled, present), patches before packages, then
    by name."""
    p = patch_states.where("error is null").select(F.concat(F.lit("_patches/"), "patch").alias("sort_key"), F.col("patch").alias("name"), F.lit(True).alias("is_patch"))
    k = packages.where((F.col("package_type") == "Z") & F.col("enabled") & F.col("present")).select(F.lower("region").alias("sort_key"), F.col("region").alias("name"), F.lit(False).alias("is_patch"))
    return p.unionByName(k)


def union_of_patches(files: DataFrame, patch_states: DataFrame) -> DataFrame:
    """(path, patch, is_dir) of the valid patches' files and folders: of equal paths the first patch's. A minimum per path and no window, so that a
    path that many have costs one row per task. It is taken of patches' places in the order of names, which are numbers: Spark would sort all rows for a
    minimum of names."""
    head = F.conv(F.rpad(F.substring(F.hex("patch"), 1, 14), 14, "0"), 16, 10).cast("decimal(38,0)")  # seven bytes
    ok = patch_states.where("error is null").select("patch", head.alias("_h"))
    place = F.col("_h") * 10**15 + F.row_number().over(Window.partitionBy("_h").orderBy("patch"))
    ok = ok.select("patch", place.cast("decimal(38,0)").alias("_place"))
    f = files.join(ok.hint("shuffle_hash"), "patch").select("_place", "path")
    names = F.split("path", "/")
    up = F.when(F.size(names) > 1, F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    every = f.select("_place", F.inline(F.concat(F.array(F.struct(F.col("path").alias("path"), F.lit(False).alias("is_dir"))), F.transform(up, lambda x: F.struct(x.alias("path"), F.lit(True).alias("is_dir"))))))
    first = every.groupBy("path").agg(F.min("_place").alias("_place"), F.max("is_dir").alias("is_dir"))
    return first.join(ok, "_place").select("path", "patch", "is_dir")


def in_cell(tiles: DataFrame, cell: tuple[int, int] | None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The tiles of one cell; without a cell all."""
    return tiles if cell is None else tiles.where((geo.degree(lat) == cell[0]) & (geo.degree(lon) == cell[1]))


def ter_in_bounds(name: Column, bounds: list[tuple[int, int, int, int, int]]) -> Column:
    """struct(row, col, zoom) of a terrain file's name as it stands, if one of (zoom, min_row, max_row, min_col, max_col) holds it."""
    stem = text._less(text._stem(name, ".ter"), "_sea")
    ok, row, col, _, zoom = text._parts(stem, True, 2)
    inside = F.lit(False)
    for z, r0, r1, c0, c1 in bounds:
        inside = inside | ((zoom == z) & row.between(r0, r1) & col.between(c0, c1))
    return F.when(ok & inside, F.struct(row.alias("row"), col.alias("col"), zoom.alias("zoom")))


def job_tile(job: Column) -> Column:
    """struct(row, col, zoom) of a job's name such as dds-12_34_ZL16."""
    p = r"^dds-(\+?[0-9]+)_(\+?[0-9]+)_ZL(\+?[0-9]+)$"
    row, col, zoom = (text._u32(F.nullif(F.regexp_extract(job, p, i), F.lit(""))) for i in (1, 2, 3))
    return F.when(row.isNotNull() & col.isNotNull() & (zoom <= 255), F.struct(row.alias("row"), col.alias("col"), zoom.cast("int").alias("zoom")))


def migrated(files: DataFrame) -> DataFrame:
    """(region, files, bytes) of the cache files (name, size_bytes) that lie flat, by the cell's folder they go to; null: those that stay, as their names tell no
    cell."""
    region = text.key_region(text.file_key(F.col("name")))
    return files.groupBy(region.alias("region")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def percent(done: Column, total: Column, parts: Column, total_parts: Column) -> Column:
    """Of bytes, or of parts where their sum is not known; without either all is done."""
    share = lambda a, b: a.cast("double") / b * 100
    return F.when(total > 0, share(done, F.nullif(total, F.lit(0)))).when(total_parts > 0, share(parts, F.nullif(total_parts, F.lit(0)))).otherwise(F.lit(100.0))


def warm_progress(total: str, done: str, to_generate: str, *others: str) -> tuple[Column, Column]:
    """(fraction of the tiles to generate, tiles in flight)."""
    fraction = F.when(F.col(to_generate) == 0, F.lit(1.0)).otherwise(F.col(done).cast("double") / F.nullif(F.col(to_generate), F.lit(0)))
    return fraction, F.greatest(F.lit(0), F.col(total) - sum((F.col(c) for c in others), F.col(done)))


def subscription(request: Column, ids: Column) -> Column:
    """The message that asks for values by their ids, as JSON."""
    refs = F.transform(ids, lambda x: F.struct(x.alias("id")))
    return F.to_json(F.struct(F.struct(refs.alias("datarefs")).alias("params"), request.alias("req_id"), F.lit("dataref_subscribe_values").alias("type")))
