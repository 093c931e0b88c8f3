"""Layer tables, first-source-wins unions, lookups, radius joins and the filter pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import generate, geo

CELL = ["dsf_lat", "dsf_lon"]


def upserted(layer: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The layer after inserts: of each key the row of the highest order. Both sides have the same columns."""
    both = layer.unionByName(changes)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def removed(layer: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return layer.join(gone.select(*key).distinct(), key, "left_anti")


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the row of the smallest order; combined before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def resolved(paths: DataFrame, indexed: DataFrame, probed: DataFrame) -> DataFrame:
    """paths (path) with the source of the index, or else the first source in which a lazy path is found.

    indexed: path, source_idx; probed: path, source_idx of files under the lazily listed folders terrain and textures.
    """
    lazy = probed.where(F.substring_index("path", "/", 1).isin("terrain", "textures")).groupBy("path").agg(F.min("source_idx").alias("lazy_idx"))
    hit = indexed.groupBy("path").agg(F.min("source_idx").alias("own_idx"))
    out = paths.join(hit, "path", "left").join(lazy, "path", "left")
    return out.select("path", F.coalesce("own_idx", "lazy_idx").alias("source_idx"))


def resolved_near_patches(paths: DataFrame, files: DataFrame, patched: DataFrame) -> DataFrame:
    """paths (path, dsf_lat, dsf_lon) with the source of each: in a patched cell patches come first, elsewhere source order decides.

    files: path, source_idx, is_patch; patched: dsf_lat, dsf_lon.
    """
    p = paths.join(patched.select(*CELL).distinct().withColumn("patched", F.lit(True)), CELL, "left")
    rank = F.struct((~(F.coalesce("patched", F.lit(False)) & F.col("is_patch"))).alias("late"), F.col("source_idx"))
    return p.join(files, "path").groupBy("path", *CELL).agg(F.min(rank)["source_idx"].alias("source_idx"))


def radius_join(points: DataFrame, places: DataFrame, nm: float, lat: str = "lat", lon: str = "lon", p_lat: str = "p_lat", p_lon: str = "p_lon", size: float = 1.0) -> DataFrame:
    """points joined to all places within nm nautical miles on the flat earth (float steps; longitudes as they are, without wrapping), by buckets.

    Places are written to the bucket of their own, points to every bucket they reach; the exact distance filters the rest. A band of `size`
    degrees of latitude has buckets as many degrees wide as `size` is at the equator, so that a point reaches as few of them towards the poles.
    Longitudes lie within 360 degrees of each other. Both sides are shuffled: Spark takes points for as small as they were before they were written
    to their buckets, and would broadcast them.
    """
    reach = nm / 60.0 * 1.0001  # more than what float steps may round off
    double = lambda c: F.col(c).cast("double")
    whole = lambda x: F.floor(x).cast("int")
    edge = F.least(F.greatest(F.abs("_a"), F.abs(F.col("_a") + 1)) * size, F.lit(90.0))
    column = lambda x: whole(x * F.cos(F.radians(edge)) / size)
    wide = F.least(reach / F.greatest(F.abs(F.cos(F.radians(F.col(lat).cast("float")).cast("float")).cast("double")), F.lit(1e-6)), F.lit(360.0))
    q = points.withColumn("_a", F.explode(F.sequence(whole((double(lat) - reach) / size), whole((double(lat) + reach) / size))))
    q = q.withColumn("_o", F.explode(F.sequence(column(double(lon) - wide), column(double(lon) + wide))))
    s = places.withColumn("_a", whole(double(p_lat) / size)).withColumn("_o", column(double(p_lon)))
    d = geo.flat_nm(lat, lon, p_lat, p_lon)
    return q.hint("merge").join(s, ["_a", "_o"]).withColumn("nm", d).where(F.col("nm") <= F.lit(nm).cast("float")).drop("_a", "_o")


def region_tiles(regions: DataFrame, scenery: DataFrame, nm: float = 45.0, within: bool = True) -> DataFrame:
    """(dsf_lat, dsf_lon, row, col, zoom) of each cell: scenery tiles near its middle, or a sample grid at zoom 14 where there are none.

    scenery: row, col (of chunks), chunk_zoom, lat, lon as float. within: only tiles of the cell itself, each once, as a plan needs
    them; otherwise all tiles within the radius, as a promotion needs them.
    """
    mid = regions.select(*CELL).distinct().withColumns({"lat": F.col("dsf_lat") + F.lit(0.5), "lon": F.col("dsf_lon") + F.lit(0.5)})
    s = scenery.select(geo.tile_of_chunk("row").alias("row"), geo.tile_of_chunk("col").alias("col"), geo.zoom_of_chunk("chunk_zoom").alias("zoom"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    if within:  # no other bucket than the cell holds any
        own = s.withColumns({"dsf_lat": geo.degree("p_lat"), "dsf_lon": geo.degree("p_lon")})
        near = mid.hint("merge").join(own, CELL).where(geo.flat_nm("lat", "lon", "p_lat", "p_lon") <= F.lit(nm).cast("float"))
    else:
        near = radius_join(mid, s, nm)
    near = near.select(*CELL, "row", "col", "zoom")
    near = near.distinct() if within else near
    bare = regions.select(*CELL).distinct().join(near.select(*CELL).distinct(), CELL, "left_anti")
    return near.unionByName(bare.select(*CELL, F.inline(generate.sample_grid("dsf_lat", "dsf_lon"))).withColumn("zoom", F.lit(14)))


def files_in_cells(cells: DataFrame, tiles: DataFrame, zooms: tuple[int, ...] = (16, 17, 18)) -> DataFrame:
    """tiles (row, col, zoom) within each cell's range of rows and columns, corners included. Zoom 19 is out of the tiling's range.

    The range join runs on (zoom, coarse row, coarse column): a coarse place is that of a tile eight levels up, of which a cell
    reaches a few, so no tile meets a cell far away.
    """
    c = cells.select(*CELL).distinct().withColumn("zoom", F.explode(F.array(*map(F.lit, zooms))))
    nw, se = geo.try_tile(F.col("dsf_lat") + 1, "dsf_lon", "zoom"), geo.try_tile(F.col("dsf_lat"), F.col("dsf_lon") + 1, "zoom")
    c = c.withColumns({"nw": nw, "se": se}).where("nw is not null and se is not null")
    up = lambda x: F.shiftright(x, 8)
    c = c.withColumn("cr", F.explode(F.sequence(up("nw.row"), up("se.row")))).withColumn("cc", F.explode(F.sequence(up("nw.col"), up("se.col"))))
    t = tiles.withColumns({"cr": up("row"), "cc": up("col")})
    return t.join(c, ["zoom", "cr", "cc"]).where(F.col("row").between(F.col("nw.row"), F.col("se.row")) & F.col("col").between(F.col("nw.col"), F.col("se.col"))).drop("cr", "cc", "nw", "se")


STAGES = ("memory", "patched", "installed", "disk", "kept")


def filtered(tiles: DataFrame, memory: DataFrame, patched: DataFrame, installed: DataFrame, disk: DataFrame) -> DataFrame:
    """tiles (row, col, zoom) with the stage that takes each out: in memory, in a patched cell, installed (as chunks), on disk; or kept.

    One pass of left joins; the first stage that applies counts, so the counts are those of four filters in this order.
    """
    at = ["row", "col", "zoom"]
    mark = lambda df, key, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    t = tiles.withColumns({"dsf_lat": geo.degree(geo.lat_of("row", "zoom", 0.5)), "dsf_lon": geo.degree(geo.lon_of("col", "zoom", 0.5))})
    t = t.join(mark(memory, at, "m"), at, "left").join(mark(patched, CELL, "p"), CELL, "left")
    chunks = installed.select("row", "col", "zoom").distinct()
    own = chunks.where((F.col("row") % geo.CHUNKS == 0) & (F.col("col") % geo.CHUNKS == 0)).select(geo.tile_of_chunk("row").alias("row"), geo.tile_of_chunk("col").alias("col"), (F.col("zoom") - geo.CHUNK_LEVELS).alias("zoom"))
    t = t.join(mark(own, at, "i"), at, "left").join(mark(disk, at, "d"), at, "left")
    stage = reduce(lambda acc, c: acc.when(F.col(c[0]), c[1]), zip("pid", STAGES[1:4]), F.when(F.col("m"), STAGES[0])).otherwise(STAGES[4])
    return t.select(*at, stage.alias("stage"))


def all_present(tiles: DataFrame, cached: DataFrame) -> DataFrame:
    """Cells of which every tile is cached; cells without tiles are not among them."""
    at = ["row", "col", "zoom"]
    t = tiles.join(cached.select(*at).distinct().withColumn("c", F.lit(True)), at, "left")
    return t.groupBy(*CELL).agg(F.bool_and(F.coalesce("c", F.lit(False))).alias("done")).where("done").select(*CELL)


def kept_regions(prefetched: DataFrame, retained: DataFrame) -> DataFrame:
    """prefetched (dsf_lat, dsf_lon, state) without what is outside the retained cells; while none is retained, and for cells in progress, all
    stays."""
    r = retained.select(*CELL).distinct().withColumn("r", F.lit(True))
    p = prefetched.join(r, CELL, "left")
    some = F.broadcast(retained.limit(1).select(F.lit(True).alias("some")))  # one row or none
    p = p.join(some, F.col("r").isNull(), "left")
    return p.where(F.col("r").isNotNull() | F.col("some").isNull() | (F.col("state") == "in_progress")).select(*prefetched.columns)


def fully_submitted(plan: DataFrame, submitted: DataFrame, deferred: DataFrame) -> DataFrame:
    """(cycle, dsf_lat, dsf_lon, tiles) of the planned cells all of whose tiles were submitted by the same cycle.

    plan: cycle, dsf_lat, dsf_lon, row, col, zoom; submitted: cycle, row, col, zoom; deferred: cycles that mark nothing. Repeated rows count once.
    """
    at = ["cycle", "row", "col", "zoom"]
    p = plan.join(deferred.select("cycle").distinct(), "cycle", "left_anti").select(*at, *CELL).distinct()
    p = p.join(submitted.select(*at).distinct().withColumn("s", F.lit(True)), at, "left")
    return p.groupBy("cycle", *CELL).agg(F.count("*").alias("tiles"), F.bool_and(F.coalesce("s", F.lit(False))).alias("all")).where("all").drop("all")


def region_states(prefetched: DataFrame, activity: DataFrame, patched: DataFrame, retained: DataFrame) -> DataFrame:
    """One state per cell from four layers. activity: dsf_lat, dsf_lon and the four counters.

    Prefetched layers come first and become mixed where reads touched them; then what activity alone says; then patched; then
    retained.
    """
    touched = (F.col("fuse_generated") > 0) | (F.col("fuse_cache_hits") > 0)
    ahead = (F.col("prefetch_generated") > 0) | (F.col("prefetch_cache_hits") > 0)
    alone = F.when(touched & ahead, "mixed").when(touched, "fuse_loaded").when(ahead, "prefetched")
    mark = lambda df, name: df.select(*CELL).distinct().withColumn(name, F.lit(True))
    j = prefetched.select(*CELL, F.col("state").alias("own")).join(activity, CELL, "full").join(mark(patched, "p"), CELL, "full").join(mark(retained, "r"), CELL, "full")
    first = F.when((F.col("own") == "prefetched") & touched, "mixed").otherwise(F.col("own"))
    state = F.coalesce(first, alone, F.when(F.col("p"), "patched"), F.when(F.col("r"), "retained"))
    n = lambda c, name: F.when(F.col("own").isNotNull() | alone.isNotNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(name)
    return j.select(*CELL, state.alias("state"), n("fuse_cache_hits", "fuse_hits"), n("fuse_generated", "fuse_misses"), n("prefetch_generated", "prefetch_generated")).where("state is not null")


def version_parts(v: Column) -> Column:
    """A version as comparable numbers, with a version of its own before the release of the same numbers where it has a pre-release tag."""
    core, tag = F.substring_index(v, "-", 1), F.when(F.instr(v, "-") > 0, F.substring(v, F.instr(v, "-") + 1, F.length(v))).otherwise("")
    nums = F.transform(F.split(F.substring_index(core, "+", 1), r"\."), lambda x: x.try_cast("int"))
    return F.struct(nums.alias("numbers"), (tag == "").alias("release"), tag.alias("tag"))


def package_status(installed: DataFrame, library: DataFrame) -> DataFrame:
    """installed and library (region, package_type, version) to one row per package with its status. Regions match without case."""
    i = installed.select(F.lower("region").alias("k"), "package_type", F.col("region").alias("i_region"), F.col("version").alias("installed"))
    b = library.select(F.lower("region").alias("k"), "package_type", F.col("region").alias("l_region"), F.col("version").alias("available"))
    j = i.join(b, ["k", "package_type"], "full")
    new = version_parts(F.col("installed")) >= version_parts(F.col("available"))
    status = F.when(F.col("installed").isNull(), "not_installed").when(F.col("available").isNull(), "orphaned").when(new, "up_to_date").otherwise("update_available")
    return j.select(F.coalesce("i_region", "l_region").alias("region"), "package_type", "installed", "available", status.alias("status"))


def merged_libraries(entries: DataFrame, order: str) -> DataFrame:
    """Entries (title, package_type, ...) of several libraries: of equal titles, without case, and types the last stays."""
    e = entries.withColumn("_k", F.lower("title"))
    rest = [c for c in entries.columns if c != "package_type"]
    return e.groupBy("_k", "package_type").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("package_type", "_r.*")
