"""Tiles that lie under tiles of other zoom levels: overlaps, gaps, and what to remove.

A tile's descendants d levels down are 2**d by 2**d; only even differences count. Tiles of one place (another provider, a twin)
count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Estimated bytes of a removed tile by zoom, and of a missing one's download.
SAVED = [(12, 14, 100 * 1024), (15, 16, 300 * 1024), (17, 18, 800 * 1024), (19, 19, 1500 * 1024)]
SAVED_ELSE = 200 * 1024
MISSING_BYTES = 50 * 1024 * 256


def places(tiles: DataFrame) -> DataFrame:
    """One row per place: the reference of the smallest id stands for all."""
    return tiles.groupBy("zoom", "row", "col").agg(F.min("ref_id").alias("ref_id"))


def _pairs(tiles: DataFrame) -> DataFrame:
    """Children with the place of their ancestor at every even difference that occurs: an equi-join, never a comparison of all tiles."""
    p = places(tiles)
    levels = p.select("zoom").distinct()
    high = levels.withColumnRenamed("zoom", "high")
    diff = high.join(levels.withColumnRenamed("zoom", "low"), (F.col("high") > F.col("low")) & ((F.col("high") - F.col("low")) % 2 == 0))  # a few dozen levels
    c = p.join(F.broadcast(diff), F.col("zoom") == F.col("high"))
    d = F.col("high") - F.col("low")
    up = lambda x: F.call_function("shiftright", F.col(x), d)
    return c.select("high", "low", up("row").alias("row"), up("col").alias("col"), F.col("row").alias("c_row"), F.col("col").alias("c_col"), F.col("ref_id").alias("c_ref"))


def overlaps(tiles: DataFrame) -> DataFrame:
    """(ref_id, low, high, row, col, children, expected, coverage): each tile with the tiles of a higher zoom under it."""
    own = tiles.select(F.col("zoom").alias("low"), "row", "col", "ref_id")
    g = _pairs(tiles).groupBy("high", "low", "row", "col").agg(F.count("*").alias("children"))
    expected = F.pow(F.lit(2.0), 2 * (F.col("high") - F.col("low"))).cast("long")
    out = own.join(g, ["low", "row", "col"]).withColumn("expected", expected)
    return out.withColumn("coverage", F.when(F.col("children") == F.col("expected"), "complete").otherwise("partial")).select("ref_id", "low", "high", "row", "col", "children", "expected", "coverage")


def gaps(tiles: DataFrame) -> DataFrame:
    """(ref_id, high, row, col): the missing descendants of tiles that are partly covered."""
    part = overlaps(tiles).where("coverage = 'partial'")
    side = F.pow(F.lit(2.0), F.col("high") - F.col("low")).cast("long")
    grid = part.withColumn("side", side).withColumn("dr", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1))).withColumn("dc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1)))
    grid = grid.select("ref_id", "high", "low", F.col("row").alias("p_row"), F.col("col").alias("p_col"), (F.col("row") * F.col("side") + F.col("dr")).alias("row"), (F.col("col") * F.col("side") + F.col("dc")).alias("col"))
    there = places(tiles).select(F.col("zoom").alias("high"), "row", "col")
    return grid.join(there, ["high", "row", "col"], "left_anti").select("ref_id", "low", "high", "p_row", "p_col", "row", "col")


def missing_centre(lat: Column, lon: Column, row: Column, col: Column, side: Column) -> tuple[Column, Column]:
    """Estimated middle of a missing tile from that of the tile above it, as float."""
    f = lambda x: x.cast("float")
    off = lambda x: f((f(F.pmod(x, side)) - f(side) / 2 + 0.5) / f(side) * 0.5)
    return f(f(lat) - off(row)), f(f(lon) + off(col))


def removals(tiles: DataFrame, keep: str | int) -> DataFrame:
    """(ref_id) to remove: under complete coverage the lower tile ("highest" stays), or all of the higher ones ("lowest" stays), or whatever
    is not of the given zoom; a pair without that zoom keeps the highest."""
    full = overlaps(tiles).where("coverage = 'complete'")
    low = full.select("low", "high", "ref_id")
    c = _pairs(tiles).select("high", "low", "row", "col", F.col("c_ref").alias("ref_id"))
    high = c.join(full.select("high", "low", "row", "col").distinct(), ["high", "low", "row", "col"], "left_semi").select("low", "high", "ref_id")
    if keep == "highest":
        out = low
    elif keep == "lowest":
        out = high
    else:
        from_low = (F.col("low") == keep) & (F.col("high") != keep)
        out = low.where(~from_low).unionByName(high.where(from_low))
    return out.select("ref_id").distinct()


def saved_bytes(zoom: Column) -> Column:
    out = F.lit(None).cast("long")
    for a, b, n in reversed(SAVED):
        out = F.when(zoom.between(a, b), F.lit(n)).otherwise(out)
    return F.coalesce(out, F.lit(SAVED_ELSE)).cast("long")
