"""Reports as ordered lines that many tasks make: rows are put into bands by what they are sorted by, bands are counted and summed up,
and lines are numbered within their band. Nothing gathers the lines; only counts of bands, pairs of zooms and zooms pass one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import overlap
from tesserae.sources.files import LIST_HEAD

#: Bands a degree of latitude, for lists by latitude; rows of a band for lists by row.
PER_DEGREE, ROWS = 512, 64
BAND, PLACE = ["section", "k", "sub", "band"], ["a", "b", "c"]
#: Fixed value: removed tiles that the text names for each zoom.
NAMED = 50
#: Fixed value: gaps that the text tells of.
TOLD = 20


def numbered(lines: DataFrame) -> DataFrame:
    """(n, line), n from 0 in the order of section, k, sub, band, a, b, c, title and text. No lines give no rows."""
    g = lines.groupBy(*BAND).agg(F.count("*").alias("rows"))
    g = g.select(*BAND, (F.sum("rows").over(Window.orderBy(*BAND)) - F.col("rows")).alias("before"))
    n = F.row_number().over(Window.partitionBy(*BAND).orderBy(*PLACE, "title", "line")) - 1 + F.col("before")
    return lines.join(g, BAND).select(n.cast("long").alias("n"), "line")


def _lines(df: DataFrame, line: Column | str, section: int, **keys) -> DataFrame:
    """Lines with their keys; those not given are 0."""
    key = lambda x, kind: keys.get(x, F.lit(0)).cast(kind).alias(x)
    line = F.lit(line) if isinstance(line, str) else line
    return df.select(F.lit(section).alias("section"), *[key(x, "long") for x in BAND[1:]], *[key(x, "double") for x in PLACE], keys.get("title", F.lit("")).alias("title"), line.alias("line"))


def _put(parts: list[DataFrame]) -> DataFrame:
    return numbered(reduce(DataFrame.unionByName, parts))


def write(lines: DataFrame, path: str) -> None:
    """Numbered lines as files of ranges, whose names sort in order."""
    lines.repartitionByRange("n").sortWithinPartitions("n").select("line").write.text(path)


def _size(n: Column) -> Column:
    one = lambda k, unit: F.format_string(f"%.2f {unit}", n.cast("double") / k)
    return F.when(n >= 1 << 30, one(1 << 30, "GB")).when(n >= 1 << 20, one(1 << 20, "MB")).when(n >= 1 << 10, one(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def _deduped(tiles: DataFrame, keep: str | int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One row of totals, pairs of zooms with their overlaps and whether one follows, removed tiles, and zooms of these."""
    gone = tiles.join(overlap.removals(tiles, keep), "ref_id", "left_semi")
    gone = gone.withColumn("path", F.concat(F.col("row").cast("string"), F.lit("_"), F.col("col").cast("string"), F.lit("_"), "provider", F.col("zoom").cast("string"), F.lit(".ter")))
    pairs = overlap.overlaps(tiles).groupBy("high", "low").agg(F.count("*").alias("tiles"))
    pairs = pairs.withColumn("more", F.lead("tiles").over(Window.orderBy("high", "low")).isNotNull())  # of two dozen zooms
    zooms = gone.groupBy("zoom").agg(F.count("*").alias("tiles"), F.sum(overlap.saved_bytes(F.col("zoom"))).alias("saved"), F.max(F.struct("row", "col", "ref_id")).alias("last"))
    zooms = zooms.withColumn("more", F.lead("tiles").over(Window.orderBy("zoom")).isNotNull())
    one = tiles.agg(F.count("*").alias("tiles"), F.array_sort(F.collect_set("zoom")).alias("zooms"))
    one = one.join(zooms.agg(F.coalesce(F.sum("tiles"), F.lit(0)).alias("gone"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))).join(pairs.agg(F.count("*").alias("pairs")))  # one row each
    return one, pairs, gone, zooms


def _text(x: str) -> Column:
    return F.col(x).cast("string")


def _comma(more: Column) -> Column:
    return F.when(more, ",").otherwise("")


def _zoom_list() -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform("zooms", lambda z: z.cast("string")), ", "), F.lit("]"))


def dedupe_json(tiles: DataFrame, keep: str | int = "highest", dry_run: bool = False, mode: str = "highest", cell: tuple[int, int] | None = None) -> DataFrame:
    """(n, line) of the JSON report of a deduplication; removed tiles by zoom, row, column."""
    one, pairs, gone, zooms = _deduped(tiles, keep)
    zoom = F.col("zoom")
    is_last = F.struct("row", "col", "ref_id") == F.col("last")
    paths = gone.join(F.broadcast(zooms.select("zoom", "last")), "zoom")
    where = f'"{cell[0]},{cell[1]}"' if cell else "null"
    return _put([
        _lines(one, "{", 0),
        _lines(one, F.concat(F.lit('  "tiles_analyzed": '), _text("tiles"), F.lit(",")), 1),
        _lines(one, F.concat(F.lit('  "zoom_levels_present": '), _zoom_list(), F.lit(",")), 2),
        _lines(one, '  "overlaps_by_pair": {', 3),
        _lines(one.where("pairs = 0"), "", 4),
        _lines(pairs, F.concat(F.lit('    "'), _text("high"), F.lit("-"), _text("low"), F.lit('": '), _text("tiles"), _comma(F.col("more"))), 4, k=F.col("high"), sub=F.col("low")),
        _lines(one, "  },", 5),
        _lines(one, F.concat(F.lit('  "tiles_removed_count": '), _text("gone"), F.lit(",")), 6),
        _lines(one, F.concat(F.lit('  "tiles_preserved_count": '), (F.col("tiles") - F.col("gone")).cast("string"), F.lit(",")), 7),
        _lines(one, f'  "dry_run": {str(dry_run).lower()},', 8),
        _lines(one, f'  "priority_mode": "{mode}",', 9),
        _lines(one, f'  "tile_filter": {where},', 10),
        _lines(one, '  "removed_by_zoom": {', 11),
        _lines(one.where("gone = 0"), "", 12),
        _lines(zooms, F.concat(F.lit('    "ZL'), _text("zoom"), F.lit('": [')), 12, k=zoom),
        _lines(paths, F.concat(F.lit('        "'), "path", F.lit('"'), _comma(~is_last)), 12, k=zoom, sub=F.lit(1), band=F.floor(F.col("row") / ROWS), a=F.col("row"), b=F.col("col"), c=F.col("ref_id")),
        _lines(zooms, F.concat(F.lit("    ]"), _comma(F.col("more"))), 12, k=zoom, sub=F.lit(2)),
        _lines(one, "  }", 13),
        _lines(one, "}", 14),
    ])


def dedupe_text(tiles: DataFrame, keep: str | int = "highest", dry_run: bool = False, mode: str = "highest", cell: tuple[int, int] | None = None) -> DataFrame:
    """(n, line) of the text report; it names the first NAMED removed tiles of a zoom by row and column."""
    one, pairs, gone, zooms = _deduped(tiles, keep)
    zoom, some = F.col("zoom"), one.where("gone > 0")
    # The first of each band, then of the zoom: no task ranks a whole zoom.
    band = F.floor(F.col("row") / ROWS)
    by = [F.col("row"), F.col("col"), F.col("ref_id")]
    first = gone.withColumn("r", F.row_number().over(Window.partitionBy("zoom", band).orderBy(*by))).where(F.col("r") <= NAMED)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("zoom").orderBy(*by))).where(F.col("r") <= NAMED)
    head = ["Deduplication Audit Report", "==========================", "", "Configuration", "-------------", f"Priority mode: {mode}", f"Dry run: {str(dry_run).lower()}", f"Tile filter: {cell[0]},{cell[1]}" if cell else "Tile filter: None (all tiles)", "", "Summary", "-------"]
    counts = [F.concat(F.lit("Tiles analyzed: "), _text("tiles")), F.concat(F.lit("Zoom levels: "), _zoom_list()), F.concat(F.lit("Tiles removed: "), _text("gone")), F.concat(F.lit("Tiles preserved: "), (F.col("tiles") - F.col("gone")).cast("string"))]
    fixed = lambda df, section, *lines: [_lines(df, x, section, k=F.lit(i)) for i, x in enumerate(lines)]
    return _put([
        *fixed(one, 0, *head, *counts, "", "Overlaps Detected", "-----------------"),
        _lines(one.where("pairs = 0"), "  No overlapping tiles found.", 1),
        _lines(pairs, F.concat(F.lit("  ZL"), _text("high"), F.lit(" overlaps ZL"), _text("low"), F.lit(": "), _text("tiles"), F.lit(" tiles")), 1, k=F.col("high"), sub=F.col("low")),
        _lines(one, "", 2),
        *fixed(some, 3, "Removed Tiles by Zoom Level", "---------------------------"),
        _lines(zooms, "", 4, k=zoom),
        _lines(zooms, F.concat(F.lit("  ZL"), _text("zoom"), F.lit(" ("), _text("tiles"), F.lit(" tiles):")), 4, k=zoom, sub=F.lit(1)),
        _lines(first, F.concat(F.lit("    ("), _text("row"), F.lit(", "), _text("col"), F.lit(") - "), "path"), 4, k=zoom, sub=F.lit(2), a=F.col("r")),
        _lines(zooms.where(F.col("tiles") > NAMED), F.concat(F.lit("    ... and "), (F.col("tiles") - NAMED).cast("string"), F.lit(" more")), 4, k=zoom, sub=F.lit(3)),
        *fixed(some, 5, "", "Estimated Space Savings", "-----------------------", F.concat(F.lit("  ~"), _size(F.col("saved")), F.lit(" (estimated)")), ""),
    ])


def _totals(tiles: DataFrame, missing: DataFrame) -> DataFrame:
    one = tiles.agg(F.count("*").alias("tiles"), F.array_sort(F.collect_set("zoom")).alias("zooms"))
    g = missing.groupBy("ref_id").agg(F.count("*").alias("m"), F.max(F.struct("ref_id", "row", "col")).alias("last"))
    return one.join(g.agg(F.count("*").alias("gaps"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.max("last").alias("last")))  # one row each


def gap_json(tiles: DataFrame, missing: DataFrame, cell: tuple[int, int] | None = None) -> DataFrame:
    """(n, line) of the JSON report of missing tiles (ref_id of the tile above, row, col, zoom, lat, lon), in this order."""
    one = _totals(tiles, missing)
    at = F.format_string('    { "row": %d, "col": %d, "zoom": %d, "lat": %.4f, "lon": %.4f }', "row", "col", "zoom", F.col("lat").cast("double"), F.col("lon").cast("double"))
    more = F.struct("ref_id", "row", "col") < F.col("last")
    body = missing.join(F.broadcast(one.select("last")))  # one row
    return _put([
        _lines(one, "{", 0),
        _lines(one, F.concat(F.lit('  "tiles_analyzed": '), _text("tiles"), F.lit(",")), 1),
        _lines(one, F.concat(F.lit('  "zoom_levels_present": '), _zoom_list(), F.lit(",")), 2),
        _lines(one, F.concat(F.lit('  "gaps_count": '), _text("gaps"), F.lit(",")), 3),
        _lines(one, F.concat(F.lit('  "total_missing_tiles": '), _text("m"), F.lit(",")), 4),
        _lines(one, '  "tile_filter": ' + (f'"{cell[0]},{cell[1]}",' if cell else "null,"), 5),
        _lines(one, '  "missing_tiles": [', 6),
        _lines(one.where("m = 0"), "", 7),
        _lines(body, F.concat(at, _comma(more)), 7, band=F.floor(F.col("ref_id") / 4096), a=F.col("ref_id"), b=F.col("row"), c=F.col("col")),
        _lines(one, "  ]", 8),
        _lines(one, "}", 9),
    ])


def gap_text(tiles: DataFrame, missing: DataFrame, cell: tuple[int, int] | None = None) -> DataFrame:
    """(n, line) of the text report; it tells of the first TOLD gaps by ref_id. missing has the tile above as p_zoom, p_row, p_col, p_lat, p_lon."""
    one = _totals(tiles, missing)
    g = missing.groupBy("ref_id").agg(F.count("*").alias("m"), *[F.first(x).alias(x) for x in ("zoom", "p_zoom", "p_row", "p_col", "p_lat", "p_lon")]).orderBy("ref_id").limit(TOLD)
    expected = F.pow(F.lit(2.0), 2 * (F.col("zoom") - F.col("p_zoom"))).cast("long")
    g = g.withColumns({"i": F.row_number().over(Window.orderBy("ref_id")), "expected": expected, "there": expected - F.col("m")})
    title = F.format_string("%d. Parent ZL%d (%d, %d) at %.2f,%.2f:", "i", "p_zoom", "p_row", "p_col", F.col("p_lat").cast("double"), F.col("p_lon").cast("double"))
    part = F.format_string("   Coverage: %d/%d (%.1f%%)", "there", "expected", F.bround(F.col("there") / F.col("expected") * 100, 1))
    some = one.where("gaps > 0")
    fixed = lambda df, section, *lines: [_lines(df, x, section, k=F.lit(i)) for i, x in enumerate(lines)]
    counts = [F.concat(F.lit("Tiles analyzed: "), _text("tiles")), F.concat(F.lit("Zoom levels: "), _zoom_list()), F.concat(F.lit("Gaps found: "), _text("gaps")), F.concat(F.lit("Total missing tiles: "), _text("m"))]
    load = F.concat(F.lit("Estimated download size: ~"), _size(F.col("m") * overlap.MISSING_BYTES), F.lit(" (to generate missing tiles)"))
    rest = one.where(F.col("gaps") > TOLD)
    return _put([
        *fixed(one, 0, "Coverage Gap Analysis Report", "============================", "", "Summary", "-------", *counts, *([f"Tile filter: {cell[0]},{cell[1]}"] if cell else []), "", load, ""),
        *fixed(some, 1, "Gap Details", "-----------"),
        *[_lines(g, x, 2, k=F.col("i"), sub=F.lit(j)) for j, x in enumerate(["", title, part, F.concat(F.lit("   Missing "), _text("m"), F.lit(" tiles"))])],
        *fixed(rest, 3, "", F.concat(F.lit("... and "), (F.col("gaps") - TOLD).cast("string"), F.lit(" more gaps"))),
        _lines(some, "", 4),
    ])


def gap_coordinates(missing: DataFrame) -> DataFrame:
    """(n, line) of the list of missing tiles (ref_id of the tile above, row, col, zoom, lat, lon) by latitude and longitude."""
    one = missing.groupBy("ref_id").agg(F.count("*").alias("m")).agg(F.count("*").alias("gaps"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
    head = ["# Ortho4XP Missing Tile Coordinates", "# ==================================", F.concat(F.lit("# Generated for "), _text("gaps"), F.lit(" gaps, "), _text("m"), F.lit(" missing tiles")), "#", "# Format: latitude, longitude, zoom_level", "# Use these coordinates to regenerate tiles in Ortho4XP", "#", ""]
    line = F.format_string("%.4f, %.4f, %d", F.col("lat").cast("double"), F.col("lon").cast("double"), "zoom")
    body = _lines(missing, line, 1, band=F.floor(F.col("lat") * PER_DEGREE), a=F.col("lat"), b=F.col("lon"), c=F.col("zoom"))
    return _put([*[_lines(one, x, 0, k=F.lit(i)) for i, x in enumerate(head)], body])


def gap_cells(missing: DataFrame) -> DataFrame:
    """(n, line) of the missing tiles counted by cell, with the zoom of a cell's first by row and column."""
    one = missing.agg(F.count("*"))
    name = lambda x, digits: F.concat(F.when(F.col(x) >= 0, "+").otherwise("-"), F.lpad(F.abs(x).cast("string"), digits, "0"))
    g = missing.groupBy(F.floor("lat").alias("y"), F.floor("lon").alias("x")).agg(F.count("*").alias("m"), F.min(F.struct("row", "col", "zoom"))["zoom"].alias("zoom"))
    line = F.concat(name("y", 2), name("x", 3), F.lit(": "), _text("m"), F.lit(" missing ZL"), _text("zoom"), F.lit(" tiles"))
    head = [_lines(one, x, 0, k=F.lit(i)) for i, x in enumerate(["Missing Tiles by 1°×1° Cell", "===========================", ""])]
    return _put([*head, _lines(g, line, 1, k=F.col("y"), a=F.col("x"))])


def library_lines(entries: DataFrame, publisher: str, scope: str, sequence: int, published: str) -> DataFrame:
    """(n, line) of a package list of entries (checksum, package_type, title, version, metadata_url), by title and type."""
    one = entries.agg(F.count("*").cast("string").alias("rows"))
    head = [f"{publisher} {LIST_HEAD}", "1.0.0", scope, str(sequence), published, F.col("rows"), "", ""]
    line = F.concat_ws("  ", "checksum", "package_type", "title", "version", "metadata_url")
    title = F.coalesce("title", F.lit(""))
    band = F.ascii(title) * 0x200000 + F.ascii(F.substring(title, 2, 1))  # the first two signs
    by = F.concat(title, F.lit("\0"), F.coalesce("package_type", F.lit("")))
    return _put([*[_lines(one, x, 0, k=F.lit(i)) for i, x in enumerate(head)], _lines(entries, line, 1, band=band, title=by)])
