"""Readers of scenery files, airport data, package lists and file trees; every one a plan over text or listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import binary, geo, text


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, n, line) of all files under path that match; a file is read whole, as its lines' order matters."""
    t = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return t.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n"))).withColumnsRenamed({"pos": "n", "col": "line"})


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def _number(x: Column, kind: str) -> Column:
    return x.try_cast(kind)


def terrain(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, zoom, provider, lat, lon, is_sea) of all *.ter files under path.

    The last LOAD_CENTER line with two numbers and the last texture line with a readable name count, in either order; files without one of
    them are left out. is_sea: the file's name has `_sea` in it.
    """
    return terrain_of(_lines(spark, path, "*.ter"))


def terrain_of(lines: DataFrame) -> DataFrame:
    """The same from lines (file, n, line)."""
    t = lines.withColumn("line", F.trim("line"))
    w = F.split("line", r"\s+")
    centre = F.startswith("line", F.lit("LOAD_CENTER")) & (F.size(w) >= 3)
    # Few lines tell anything; they are dealt out before they are read and sorted by file, as one split of the input may hold the lines of very many files.
    t = t.where(centre | F.startswith("line", F.lit("BASE_TEX"))).select("file", "n", "line").repartition("file")
    # A line of that kind always overwrites, with null if it has no number.
    t = t.withColumn("c", F.when(centre, F.struct("n", _number(F.get(w, F.lit(1)), "float").alias("lat"), _number(F.get(w, F.lit(2)), "float").alias("lon"))))
    t = t.withColumn("d", F.when(F.startswith("line", F.lit("BASE_TEX")), text.dds_parts(F.element_at(F.split("line", "/"), -1))))
    g = t.groupBy("file").agg(F.max("c").alias("c"), F.max(F.when(F.col("d").isNotNull(), F.struct("n", "d"))).alias("d"))
    g = g.select("file", "d.d.*", "c.lat", "c.lon", F.contains(name_of(F.col("file")), F.lit("_sea")).alias("is_sea"))
    return g.where("row is not null and lat is not null and lon is not null").select("file", "row", "col", "zoom", "provider", "lat", "lon", "is_sea")


def terrain_in(spark: SparkSession, path: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Distinct tiles (row, col, zoom), by file name, of terrain whose LOAD_CENTER in the first ten lines lies in the half-open box
    (min_lat, max_lat, min_lon, max_lon)."""
    return terrain_tiles(_lines(spark, path, "*.ter"), bounds)


def terrain_tiles(lines: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """The same from lines (file, n, line)."""
    t = lines.where(F.col("n") < 10)
    w = F.split("line", r"\s+")
    t = t.where(F.startswith("line", F.lit("LOAD_CENTER")) & (F.size(w) >= 3)).repartition("file")
    first = t.groupBy("file").agg(F.min(F.struct("n", _number(F.get(w, F.lit(1)), "double").alias("lat"), _number(F.get(w, F.lit(2)), "double").alias("lon"))).alias("c"))
    s, n, west, e = bounds
    inside = first.where((F.col("c.lat") >= s) & (F.col("c.lat") < n) & (F.col("c.lon") >= west) & (F.col("c.lon") < e))
    return inside.select(text.ter_tile(name_of(F.col("file"))).alias("t")).where("t is not null").select("t.*").distinct()


def airports(spark: SparkSession, path: str) -> DataFrame:
    """(icao, name, latitude, longitude, elevation_ft) of the airport blocks of an apt.dat file.

    Records 1, 16 and 17 begin a block; 1302 datum_lat and datum_lon give its place, else the first record 100 to 102 that comes with
    coordinates in columns ten and eleven while the place is incomplete. Blocks without a place are left out.
    """
    return airports_of(_split_lines(spark, path))


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, n, line): files are read by splits of Spark's size, so a large file is many tasks' work. n is a line's place among the lines of its
    split, split the place of its first byte in the file."""
    t = spark.read.option("recursiveFileLookup", "true").text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"\r$", "").alias("line"))


def airports_of(lines: DataFrame) -> DataFrame:
    """The same from lines (file, n, line), or (file, split, n, line) with n in the order of a split's lines.

    Blocks are numbered in two steps, as no task sees a whole file: heads within each split, and heads of the splits before.
    """
    t = lines if "split" in lines.columns else lines.withColumn("split", F.lit(0).cast("long"))
    w = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    t = t.withColumn("w", w).withColumn("code", F.get("w", F.lit(0)))
    head = F.col("code").isin("1", "16", "17") & (F.size("w") >= 6) & _number(F.get("w", F.lit(1)), "float").isNotNull()
    head = F.coalesce(head, F.lit(False))
    t = t.withColumn("head", head)
    heads = t.groupBy("file", "split").agg(F.count_if("head").alias("heads"))  # one row per split
    before = F.sum("heads").over(Window.partitionBy("file").orderBy("split")) - F.col("heads")
    blocks = Window.partitionBy("file", "split").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(heads.select("file", "split", before.alias("before")), ["file", "split"])
    t = t.withColumn("block", F.sum(F.col("head").cast("int")).over(blocks) + F.col("before")).where("block > 0").withColumn("n", F.struct("split", "n"))
    value = lambda key, most: F.when((F.col("code") == "1302") & (F.get("w", F.lit(1)) == key) & _number(F.get("w", F.lit(2)), "double").between(-most, most), _number(F.get("w", F.lit(2)), "double"))
    lat, lon = _number(F.get("w", F.lit(9)), "double"), _number(F.get("w", F.lit(10)), "double")
    runway = F.when(F.col("code").isin("100", "101", "102") & lat.between(-90, 90) & lon.between(-180, 180), F.struct("n", lat.alias("lat"), lon.alias("lon")))
    last = lambda c: F.max(F.when(c.isNotNull(), F.struct("n", c.alias("v"))))
    g = t.groupBy("file", "block").agg(F.max(F.when(F.col("head"), F.col("w"))).alias("h"), last(value("datum_lat", 90)).alias("a"), last(value("datum_lon", 180)).alias("o"), F.min(runway).alias("r"), F.max(runway).alias("r2"))
    whole = F.col("a").isNotNull() & F.col("o").isNotNull() & (F.col("r").isNull() | (F.greatest("a.n", "o.n") < F.col("r.n")))
    # A runway that comes before the datum is overwritten by it, field by field.
    pick = lambda d, f: F.when(whole, F.col(f"{d}.v")).otherwise(F.when(F.col(f"{d}.n") > F.col("r.n"), F.col(f"{d}.v")).otherwise(F.coalesce(F.col(f"r.{f}"), F.col(f"{d}.v"))))
    out = g.select(F.get("h", F.lit(4)).alias("icao"), F.array_join(F.slice("h", F.lit(6), F.greatest(F.size("h") - 5, F.lit(0))), " ").alias("name"), pick("a", "lat").alias("latitude"), pick("o", "lon").alias("longitude"), _number(F.get("h", F.lit(1)), "float").alias("elevation_ft"))
    return out.where("latitude is not null and longitude is not null")


def library(spark: SparkSession, path: str) -> DataFrame:
    """(checksum, package_type, title, version, metadata_url) of a package list: six header lines, then five fields two blanks apart."""
    return library_of(_lines(spark, path, "*"))


def library_of(lines: DataFrame) -> DataFrame:
    """The same from lines (file, n, line)."""
    t = lines.where((F.col("n") >= 6) & (F.trim("line") != ""))
    p = F.split(F.trim("line"), r"\s{2,}")
    return t.where(F.size(p) == 5).select(*[F.get(p, F.lit(i)).alias(c) for i, c in enumerate(("checksum", "package_type", "title", "version", "metadata_url"))])


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime) of all files under a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.sha2("content", 256).alias("sha256"))


def cache_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, region, size_bytes, last_accessed) of a disk cache's files."""
    f = listing(spark, path, "*.cache")
    key = text.file_key(name_of(F.col("path")))
    return f.select(key.alias("key"), text.key_region(key).alias("region"), F.col("size").alias("size_bytes"), F.col("mtime").alias("last_accessed"))


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    """(source, path, size, mtime) of files below a folder of sources: only under the roots scenery uses; what lies in the lazily listed
    folders terrain and textures is not an index entry."""
    f = listing(spark, path)
    rel = F.regexp_extract("path", r"^(?:file:)?/*" + path.strip("/") + r"/([^/]+)/(.*)$", 2)
    src = F.regexp_extract("path", r"^(?:file:)?/*" + path.strip("/") + r"/([^/]+)/(.*)$", 1)
    f = f.select(src.alias("source"), rel.alias("path"), "size", "mtime")
    return f.where(F.contains("path", F.lit("/")) & ~F.substring_index("path", "/", 1).isin("terrain", "textures"))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """(dsf_lat, dsf_lon) of the cell files under the ten-degree folders of a package tree."""
    f = listing(spark, path, "*.dsf")
    return f.select(text.cell_of_name(name_of(F.col("path"))).alias("c")).where("c is not null").select("c.*").distinct()


def geojson(cells: DataFrame) -> DataFrame:
    """One polygon feature per cell, as JSON."""
    s, w = F.col("dsf_lat"), F.col("dsf_lon")
    ring = F.array(*[F.array((w + dx).cast("int"), (s + dy).cast("int")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    f = F.struct(F.lit("Feature").alias("type"), F.struct(geo.cell_name(s, w).alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    return cells.select("dsf_lat", "dsf_lon", F.to_json(f).alias("feature"))


def packets(lines: DataFrame) -> DataFrame:
    """(seq, packet) with XGPS and XATT lines to (seq, kind, lon, lat, altitude_ft, track, knots, heading)."""
    p = F.split("packet", ",")
    n = lambda i: _number(F.get(p, F.lit(i)), "double")
    gps, att = F.startswith("packet", F.lit("XGPS")), F.startswith("packet", F.lit("XATT"))
    return lines.select(
        "seq", F.when(gps, "gps").when(att, "attitude").alias("kind"), F.when(gps, n(1)).alias("lon"), F.when(gps, n(2)).alias("lat"), F.when(gps, n(3) * 3.28084).alias("altitude_ft"),
        F.when(gps, n(4)).alias("track"), F.when(gps, n(5) * 1.94384).alias("knots"), F.when(att, n(1)).alias("heading"),
    ).where("kind is not null")


# Bytes of the head of a DATA packet and of each of its records; numbers of the records that are read.
DATA_HEAD, DATA_RECORD = 5, 36
SPEEDS, HEADINGS, POSITION = 3, 17, 20


def data_packets(packets_: DataFrame) -> DataFrame:
    """(seq, packet) with binary DATA packets to (seq, lat, lon, altitude_ft, heading, knots), decoded in generated code.

    After the head come whole records of a number and eight floats; a rest that is no whole record does not count. Of records of one number the last
    counts, and packets without any that is read are left out, as are those of another kind. Headings are from 0 to 360.
    """
    own = packets_.where((F.substring("packet", 1, 4) == F.lit(b"DATA")) & (F.length("packet") >= DATA_HEAD))
    n = F.floor((F.length("packet") - DATA_HEAD) / DATA_RECORD).cast("int")
    at = lambda i: i * DATA_RECORD + DATA_HEAD
    r = own.where(n > 0).select("seq", "packet", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).withColumn("kind", binary.word("packet", at(F.col("i"))))
    bits = [binary.word("packet", at(F.col("i")) + 4 + 4 * k).alias(f"b{k}") for k in range(4)]
    r = r.where(F.col("kind").isin(SPEEDS, HEADINGS, POSITION)).select("seq", "i", "kind", *bits)
    r = r.select("seq", "i", "kind", *[binary.float_of(F.col(f"b{k}")).alias(f"v{k}") for k in range(4)])
    last = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.struct("i", F.col(c).alias("v"))))["v"]
    g = r.groupBy("seq").agg(last(POSITION, "v0").alias("lat"), last(POSITION, "v1").alias("lon"), last(POSITION, "v3").alias("altitude_ft"), last(HEADINGS, "v2").alias("heading"), last(SPEEDS, "v3").alias("knots"))
    return g.withColumn("heading", F.pmod("heading", F.lit(360.0)))


# How the first lines of package lists and metadata end; a publisher's name is before it.
LIST_HEAD, METADATA_HEAD = "REGIONAL SCENERY PACKAGE LIBRARY", "REGIONAL SCENERY PACKAGE"


def library_head(lines: DataFrame) -> DataFrame:
    """(file, spec_version, scope, sequence, published_at, packages, ok) of package lists. The time is RFC 3339, in any zone; ok: the first line is that of a
    list, its numbers are numbers, and it has as many entries as it says."""
    at = lambda i: F.max(F.when(F.col("n") == i, F.trim("line")))
    entries = F.count_if((F.col("n") >= 6) & (F.trim("line") != ""))
    g = lines.groupBy("file").agg(*[at(i).alias(f"h{i}") for i in range(6)], entries.alias("entries"))
    sequence, packages, published = F.col("h3").try_cast("long"), F.col("h5").try_cast("long"), F.try_to_timestamp("h4")
    ok = F.endswith("h0", F.lit(LIST_HEAD)) & sequence.isNotNull() & published.isNotNull() & (packages == F.col("entries"))
    return g.select("file", F.col("h1").alias("spec_version"), F.col("h2").alias("scope"), sequence.alias("sequence"), published.alias("published_at"), packages.alias("packages"), F.coalesce(ok, F.lit(False)).alias("ok"))


# The separator of fields, the types of packages.
FIELDS, TYPES = "  ", ("Z", "Y")


def metadata_of(lines: DataFrame) -> DataFrame:
    """One row per file of package metadata (file, n, line): its fields, parts (checksum, filename, url), and error, the first reason for which it is
    none, else null.

    Eight lines: first line, version, title and version, time, type, mountpoint, file name, number of parts; then a line of
    two or three fields per part. Blank lines between are skipped, and the number must be right.
    """
    t = lines.withColumn("line", F.trim("line"))
    head = [F.max(F.when(F.col("n") == i, F.col("line"))).alias(f"h{i}") for i in range(8)]
    fields = F.split("line", FIELDS)
    part = F.when((F.col("n") >= 8) & (F.col("line") != ""), F.struct("n", F.size(fields).alias("size"), F.get(fields, F.lit(0)).alias("checksum"), F.get(fields, F.lit(1)).alias("filename"), F.coalesce(F.get(fields, F.lit(2)), F.lit("")).alias("url")))
    g = t.groupBy("file").agg(F.count("*").alias("lines"), *head, F.array_sort(F.collect_list(part)).alias("p"))
    title, count = F.split("h2", FIELDS), F.col("h7").try_cast("long")
    version = lambda c: c.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$")
    stamp = F.try_to_timestamp("h3")
    error = (
        F.when(F.col("lines") < 8, "lines").when(~F.endswith("h0", F.lit(METADATA_HEAD)), "header").when(~version(F.col("h1")), "spec_version").when((F.size(title) != 2) | ~F.coalesce(version(F.trim(F.get(title, F.lit(1)))), F.lit(False)), "title")
        .when(stamp.isNull(), "time").when(~F.substring("h4", 1, 1).isin(*TYPES), "type").when(count.isNull() | (count < 0), "count").when(F.exists("p", lambda x: ~x["size"].isin(2, 3)), "part").when(F.size("p") != count, "parts")
    )
    parts = F.transform("p", lambda x: F.struct(x["checksum"].alias("checksum"), x["filename"].alias("filename"), x["url"].alias("url")))
    return g.select("file", F.get(title, F.lit(0)).alias("title"), F.trim(F.get(title, F.lit(1))).alias("version"), stamp.alias("published_at"), F.substring("h4", 1, 1).alias("package_type"), F.col("h5").alias("mountpoint"), F.col("h6").alias("filename"), parts.alias("parts"), error.alias("error"))


def metadata_errors(packages: DataFrame, context: str) -> DataFrame:
    """(file, part, error) that keep a package from a stage: `initial` needs checksums of the parts there are, `awaiting_urls` parts too, `release` their
    addresses as well. part is null for a package without parts."""
    none = packages.where((F.size("parts") == 0) & F.lit(context != "initial")).select("file", F.lit(None).cast("int").alias("part"), F.lit("no_parts").alias("error"))
    p = packages.select("file", F.posexplode("parts").alias("part", "x"))
    found = F.array(F.when(F.col("x.checksum") == "", "empty_checksum"), F.when((F.col("x.url") == "") & F.lit(context == "release"), "missing_url"))
    return none.unionByName(p.select("file", "part", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("error")))
