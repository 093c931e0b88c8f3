"""Stored results with the key they hold for: the index of scenery tiles as text, and the union of sources kept up source by source."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.index import first_wins
from tesserae.sources.files import FIELDS
from tesserae.sources.shared import delete, exists, names, scratch

# The first two lines of a stored index.
CACHE_HEAD, CACHE_VERSION = "SCENERY INDEX CACHE", 1
HEAD_LINES = 5
# The most sources that have a folder each, and the most parts that further ones share before these are put together.
OWN, PARTS = 200, 8

# --- the scenery index as text ------------------------------------------------------------------------------------------------------------


def index_lines(tiles: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The head and the body of a stored index, as (n, line) and (line): tiles (row, col, zoom, lat, lon, is_sea), packages (name, path, mtime, files).

    The head has five lines, one for each package by name, and a blank one. The body has no order, so tasks write it side by side.
    """
    p = packages.select(F.concat_ws(FIELDS, "name", "path", *[F.col(c).cast("string") for c in ("mtime", "files")]).alias("line"), "name")
    count = tiles.agg(F.count("*").alias("tiles"), F.count_if("is_sea").alias("sea"))
    own = p.agg(F.sort_array(F.collect_list(F.struct("name", "line"))).alias("p"))  # one line for each package that is installed
    first = F.array(F.lit(CACHE_HEAD), F.lit(str(CACHE_VERSION)), F.size("p").cast("string"), F.col("tiles").cast("string"), F.col("sea").cast("string"))
    lines = F.concat(first, F.transform("p", lambda x: x["line"]), F.array(F.lit("")))
    head = own.crossJoin(F.broadcast(count)).select(F.posexplode(lines).alias("n", "line"))  # one row with one row
    sea = F.when(F.col("is_sea"), "1").otherwise("0")
    return head, tiles.select(F.concat_ws(FIELDS, *[F.col(c).cast("string") for c in ("row", "col", "zoom", "lat", "lon")], sea).alias("line"))


def index_heads(lines: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(file, status, reason, tiles, sea_tiles) of stored indexes (file, n, line): loaded, stale or invalid, and the counts they state.

    Stale: another version, or packages other than those that are there now (packages: file, name, path, mtime, files; None: not
    compared). Of several reasons the first in the order of the lines is given.
    """
    head = lines.where(F.col("n") < HEAD_LINES).groupBy("file").agg(*[F.max(F.when(F.col("n") == i, F.col("line"))).alias(f"h{i}") for i in range(HEAD_LINES)])
    number = [F.col(f"h{i}").try_cast("long").alias(c) for i, c in ((1, "version"), (2, "packages"), (3, "tiles"), (4, "sea_tiles"))]
    h = head.select("file", "h0", *number)
    own = lines.join(h.select("file", "packages"), "file").where((F.col("n") >= HEAD_LINES) & (F.col("n") < HEAD_LINES + F.col("packages")))
    w = F.split("line", FIELDS)
    mtime, files = F.get(w, F.lit(2)).try_cast("long"), F.get(w, F.lit(3)).try_cast("long")
    own = own.select("file", F.get(w, F.lit(0)).alias("name"), F.get(w, F.lit(1)).alias("path"), mtime.alias("mtime"), files.alias("files"), ((F.size(w) == 4) & mtime.isNotNull() & files.isNotNull()).alias("good"))
    now = packages if packages is not None else own.where("good").drop("good")
    both = own.select("*", F.lit(True).alias("was")).join(now.select("file", "name", "path", F.col("mtime").cast("long").alias("mtime2"), F.col("files").cast("long").alias("files2"), F.lit(True).alias("is")), ["file", "name", "path"], "full")
    same = F.col("was").isNotNull() & F.col("is").isNotNull() & (F.col("mtime") == F.col("mtime2")) & (F.col("files") == F.col("files2"))
    p = both.groupBy("file").agg(F.count("was").alias("held"), F.count("is").alias("there"), F.bool_and(F.coalesce("good", F.lit(True))).alias("good"), F.bool_and(F.coalesce(same, F.lit(False))).alias("same"))
    h = h.join(p, "file", "left").withColumns({"held": F.coalesce("held", F.lit(0)), "there": F.coalesce("there", F.lit(0)), "good": F.coalesce("good", F.lit(True)), "same": F.coalesce("same", F.lit(True))})
    reason = (
        F.when(F.coalesce(F.col("h0") != CACHE_HEAD, F.lit(True)), "head").when(F.col("version").isNull(), "version").when(F.col("version") != CACHE_VERSION, "other_version").when(F.col("packages").isNull(), "package_count")
        .when(F.col("packages") != F.col("there"), "other_package_count").when(F.col("tiles").isNull(), "tile_count").when(F.col("sea_tiles").isNull(), "sea_count").when((F.col("held") < F.col("packages")) | ~F.col("good"), "package_line").when(~F.col("same"), "other_packages")
    )
    status = F.when(reason.isNull(), "loaded").when(F.startswith(reason, F.lit("other")), "stale").otherwise("invalid")
    return h.select("file", status.alias("status"), reason.alias("reason"), "tiles", "sea_tiles")


def index_tiles(lines: DataFrame) -> DataFrame:
    """(file, row, col, zoom, lat, lon, is_sea) of a stored index's tile lines; lines that are none are skipped, as package lines are."""
    w = F.split("line", FIELDS)
    v = [F.get(w, F.lit(i)).try_cast(k).alias(c) for i, (c, k) in enumerate((("row", "long"), ("col", "long"), ("zoom", "int"), ("lat", "float"), ("lon", "float")))]
    t = lines.where(F.size(w) == 6).select("file", *v, F.get(w, F.lit(5)).alias("sea"))
    return t.where("row is not null and col is not null and zoom is not null and lat is not null and lon is not null and sea in ('0', '1')").select("file", "row", "col", "zoom", "lat", "lon", (F.col("sea") == "1").alias("is_sea"))


def cached_tiles(spark: SparkSession, folder: str, packages: DataFrame, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """The scenery index of the packages (name, path, mtime, files), and whether it was `loaded`, or why not: then it is built, and stored in folder.

    A stored index is used if its head states this version and these packages with these times and numbers of files, and as many tiles as there
    are. build is not called then, so no scenery file is read.
    """
    why = "not_found"
    if exists(spark, f"{folder}/head"):
        stored = spark.read.schema("n int, line string").json(f"{folder}/head").select(F.lit("index").alias("file"), "n", "line")
        head = index_heads(stored, packages.select(F.lit("index").alias("file"), "*")).first()
        if head and head.status == "loaded":
            tiles = index_tiles(spark.read.text(f"{folder}/tiles").select(F.lit("index").alias("file"), F.col("value").alias("line"))).drop("file")
            n = tiles.agg(F.count("*").alias("tiles"), F.count_if("is_sea").alias("sea")).first()
            if (n.tiles, n.sea) == (head.tiles, head.sea_tiles):
                return tiles, "loaded"
            why = "invalid: tiles"
        else:
            why = f"{head.status}: {head.reason}" if head else "invalid: head"
    tiles = build()
    delete(spark, folder)
    _, body = index_lines(tiles, packages)
    body.write.text(f"{folder}/tiles")
    tiles = index_tiles(spark.read.text(f"{folder}/tiles").select(F.lit("index").alias("file"), F.col("value").alias("line"))).drop("file")
    index_lines(tiles, packages)[0].coalesce(1).write.json(f"{folder}/head")  # last, so a broken-off run leaves no head
    return tiles, why


# --- the union index, source by source ----------------------------------------------------------------------------------------------------


def source_keys(files: DataFrame) -> DataFrame:
    """(source, key) of files (source, path, size, mtime): a number that another, a missing or a changed file changes."""
    h = F.xxhash64("path", F.col("size").cast("long"), F.col("mtime").cast("string"))
    return files.groupBy("source").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string")).alias("key"))


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    """(source, key, part) of the stored sources; the part of those that have a folder each is empty."""
    if not exists(spark, f"{folder}/keys"):
        return spark.createDataFrame([], "source string, key string, part string")
    return spark.read.schema("source string, key string, part string").parquet(f"{folder}/keys").withColumn("part", F.coalesce("part", F.lit("")))


def refreshed(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Brings the stored entries (source, path, size, mtime) in folder up to date with files, and gives (source, what): kept, changed, new or gone.

    Each source has a key of what it was made from, and only sources with another key are written; the others stay as they are. As long as
    sources are few, each is a folder. Beyond that, what a refresh writes is one part of many sources, and the keys say which part of a source
    holds; parts are put together when they become many, but for the largest one. What no longer holds is deleted. Keys are written after the
    parts they speak of, so a broken-off run is made good by the next.
    """
    at = f"{scratch(spark, 'told')}/rows"
    d = source_keys(files).join(_keys(spark, folder).withColumnRenamed("key", "old"), "source", "full")
    what = F.when(F.col("key").isNull(), "gone").when(F.col("old").isNull(), "new").when(F.col("key") == F.col("old"), "kept").otherwise("changed")
    d.select("source", what.alias("what"), "key", "part").write.parquet(at)
    told = spark.read.schema("source string, what string, key string, part string").parquet(at)
    n = {w: k for w, k in told.groupBy("what").count().collect()}
    held = {p: k for p, k in told.where("what = 'kept'").groupBy("part").count().collect()}  # parts are few
    work, own = n.get("new", 0) + n.get("changed", 0), held.pop("", 0)
    if work or "gone" in n:
        part = "" if own + work <= OWN else f"p{uuid.uuid4().hex}"
        again = sorted(held, key=held.get)[:-1] if part and len(held) >= PARTS else []
        anew = F.col("what").isin("new", "changed") | (F.col("what") == "kept") & F.col("part").isin(again)
        if work:
            rows = files.join(told.where(anew).select("source"), "source", "left_semi").select("path", "size", "mtime", "source")
            if part:
                rows.write.parquet(f"{folder}/shared/part={part}")
            else:
                rows.repartition("source").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{folder}/entries")
        left = told.where((F.col("part") == "") & ((F.col("what") == "gone") | (F.col("what") == "changed") & F.lit(bool(part))))
        for r in left.select("source").toLocalIterator():  # of the few that have a folder each
            delete(spark, f"{folder}/entries/source={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r.source)}")
        told.where("what <> 'gone'").select("source", "key", F.when(anew, part).otherwise(F.col("part")).alias("part")).write.mode("overwrite").parquet(f"{folder}/keys.new")
        delete(spark, f"{folder}/keys")
        path = spark._jvm.org.apache.hadoop.fs.Path
        path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(f"{folder}/keys.new"), path(f"{folder}/keys"))
        holds = {f"part={p}" for p in {*held, part} - {*again}}
        for name in names(spark, f"{folder}/shared"):
            if name not in holds:
                delete(spark, f"{folder}/shared/{name}")
    return told.select("source", "what")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The stored entries of all sources."""
    e, fields = spark.createDataFrame([], "path string, size long, mtime timestamp_ntz, source string, part string"), "path string, size long, mtime timestamp_ntz, source string"
    if exists(spark, f"{folder}/entries"):
        e = e.unionByName(spark.read.schema(fields).parquet(f"{folder}/entries").withColumn("part", F.lit("")))
    if exists(spark, f"{folder}/shared"):
        e = e.unionByName(spark.read.schema(f"{fields}, part string").parquet(f"{folder}/shared"))
    return e.join(_keys(spark, folder), ["source", "part"], "left_semi").select("path", "size", "mtime", "source")


def union_index(spark: SparkSession, folder: str, order: DataFrame) -> DataFrame:
    """(path, source, size): of equal paths the one of the source that comes first (source, sort_key), then by name."""
    e = entries(spark, folder).join(order.select("source", "sort_key"), "source")
    return first_wins(e, ["path"], ["sort_key", "source"]).select("path", "source", "size")
