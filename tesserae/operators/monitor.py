"""What an observer sees: the state of cells and tiles as one JSON document of ordered lines, and the position as a log with a steady beat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import geo
from tesserae.operators.flight import TELEMETRY_TIMEOUT_S
from tesserae.operators.index import CELL
from tesserae.operators.reports import ROWS, _lines, _put

#: Fixed value: seconds between two lines of the position log.
BEAT_S = 20


def _object(**fields: Column) -> Column:
    """A JSON object of columns that are JSON already; fields that are null are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}"))


def _number(x: str) -> Column:
    """Six digits; JSON's null where there is none."""
    return F.coalesce(F.format_string("%.6f", F.col(x).cast("double")), F.lit("null"))


def _plain(x: str) -> Column:
    return F.col(x).cast("string")


def _quoted(x: str) -> Column:
    return F.concat(F.lit('"'), F.col(x), F.lit('"'))


def _listed(df: DataFrame, keys: list[str], line: Column, section: int, **at: Column) -> DataFrame:
    """Lines with a comma behind each but the last by `keys`. One row with the last place goes to every task."""
    last = F.broadcast(df.agg(F.max(F.struct(*keys)).alias("_last")))
    return _lines(df.join(last), F.concat(line, F.when(F.struct(*keys) == F.col("_last"), "").otherwise(",")), section, **at)


def debug_map(aircraft: DataFrame, sim: DataFrame, box: DataFrame, regions: DataFrame, tiles: DataFrame, stats: DataFrame) -> DataFrame:
    """(n, line) of a JSON document: one member a line, one cell and one tile a line.

    aircraft (latitude, longitude, heading, track, ground_speed, altitude) and box (lat_min, lat_max, lon_min, lon_max) have one row, or none, which
    gives null; sim (paused, on_ground, scenery_loading, replay, sim_speed) and stats (memory_cache_hit_rate, tiles_submitted, deferred_cycles,
    prefetch_mode, active_strategy) one row. regions are those of `region_states`, counters that are zero are left out; tiles: row, col, zoom,
    origin, hit. Cells come by place, tiles by row, column and zoom. Numbers with a fraction have six digits.
    """
    numbers = lambda *names: {x: _number(x) for x in names}
    plain = lambda *names: {x: _plain(x) for x in names}
    counter = lambda x: F.when(F.col(x) != 0, _plain(x))
    member = lambda name, df, value, section: _lines(df, F.concat(F.lit(f'"{name}":'), value, F.lit("" if name == "stats" else ",")), section)
    one = stats.limit(1)
    none = lambda df, name, section: member(name, df.agg(F.count("*").alias("c")).where("c = 0"), F.lit("null"), section)
    region = _object(lat=_plain("dsf_lat"), lon=_plain("dsf_lon"), state=_quoted("state"), **{x: counter(x) for x in ("fuse_hits", "fuse_misses", "prefetch_generated")})
    t = tiles.withColumns({"lat": geo.lat_of("row", "zoom", 0.5), "lon": geo.lon_of("col", "zoom", 0.5), "result": F.when(F.col("hit"), "cache_hit").otherwise("generated")})
    tile = _object(**plain("row", "col", "zoom"), **numbers("lat", "lon"), origin=_quoted("origin"), result=_quoted("result"))
    return _put([
        _lines(one, "{", 0),
        member("aircraft", aircraft, _object(**numbers("latitude", "longitude", "heading", "track", "ground_speed", "altitude")), 1),
        none(aircraft, "aircraft", 1),
        member("sim_state", sim, _object(**plain("paused", "on_ground", "scenery_loading", "replay", "sim_speed")), 2),
        member("prefetch_box", box, _object(**numbers("lat_min", "lat_max", "lon_min", "lon_max")), 3),
        none(box, "prefetch_box", 3),
        _lines(one, '"regions":[', 4),
        _listed(regions, CELL, region, 5, k=F.col("dsf_lat"), band=F.col("dsf_lon")),
        _lines(one, "],", 6),
        _lines(one, '"tiles":[', 7),
        _listed(t, ["row", "col", "zoom"], tile, 8, band=F.floor(F.col("row") / ROWS), a=F.col("row"), b=F.col("col"), c=F.col("zoom")),
        _lines(one, "],", 9),
        member("stats", stats, _object(**numbers("memory_cache_hit_rate"), **plain("tiles_submitted", "deferred_cycles"), prefetch_mode=_quoted("prefetch_mode"), active_strategy=_quoted("active_strategy")), 10),
        _lines(one, "}", 11),
    ])


def position_log(updates: DataFrame, beat: int = BEAT_S, timeout: float = TELEMETRY_TIMEOUT_S) -> DataFrame:
    """(source_id, tick, line) every `beat` seconds from 0 to a source's last update: the position known then.

    updates: source_id, seq, t (seconds), lat, lon, heading, ground_speed, altitude, accuracy, source. A tick at an update's time sees it; of updates at one time
    the last by seq counts. Before the first there is no position. Telemetry is connected while the last update is at most `timeout` old. Each update
    tells its own ticks, those before the next one, so nothing is joined.
    """
    w = Window.partitionBy("source_id").orderBy("t", "seq")
    own, nxt = F.ceil(F.col("t") / beat), F.lead("t").over(w)
    upto = F.when(nxt.isNull(), F.floor(F.col("t") / beat)).otherwise(F.ceil(nxt / beat) - 1)
    u = updates.withColumns({"_from": own, "_to": upto}).where("_from <= _to").withColumn("tick", F.explode(F.sequence("_from", "_to")))
    tile = geo.cell_name(geo.degree("lat"), geo.degree("lon"))
    state = F.when(F.col("tick") * beat - F.col("t") <= timeout, "Connected").otherwise("Disconnected")
    whole = lambda x: F.rint(F.col(x)).cast("double")  # noqa: E731  ties to even
    text = 'APT position update lat="%.5f" lon="%.5f" hdg="%.1f" gs_kt="%.0f" alt_ft="%.0f" accuracy_m="%.0f" source=%s telemetry=%s dsf_tile=%s'
    line = F.format_string(text, "lat", "lon", "heading", whole("ground_speed"), whole("altitude"), whole("accuracy"), "source", state, tile)
    first = updates.groupBy("source_id").agg(F.ceil(F.min("t") / beat).alias("n")).where("n > 0")
    none = first.select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("tick"), F.lit("APT position update (no position data) telemetry=Disconnected").alias("line"))
    return u.select("source_id", "tick", line.alias("line")).unionByName(none)
