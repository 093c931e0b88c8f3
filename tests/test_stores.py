"""Stored indexes, source trees and files read by splits."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tesserae.functions import binary
from tesserae.sources import caches, files, trees

PACKAGES = "name string, path string, mtime long, files long"
TILES = "row long, col long, zoom int, lat float, lon float, is_sea boolean"


def test_cached_tiles(spark, tmp_path):
    at = str(tmp_path / "index")
    packages = spark.createDataFrame([("B", "/s/b", 5, 2), ("A", "/s/a", 7, 1)], PACKAGES)
    tiles = spark.createDataFrame([(i, i * 2, 16, i / 8, -i / 4, i % 3 == 0) for i in range(100)], TILES)
    built = []

    def build():
        built.append(1)
        return tiles

    load = lambda p=packages: (lambda t, why: (sorted(map(tuple, t.collect())), why))(*caches.cached_tiles(spark, at, p, build))
    want = sorted(map(tuple, tiles.collect()))
    assert load() == (want, "not_found") and load() == (want, "loaded") and len(built) == 1  # a hit reads no source
    touched = packages.withColumn("mtime", F.col("mtime") + (F.col("name") == "A").cast("long"))
    assert load(touched) == (want, "stale: other_packages") and load(touched) == (want, "loaded") and len(built) == 2
    assert load(touched.where("name = 'A'"))[1] == "stale: other_package_count"
    spark.range(1).select(F.lit("1  2  16  0.5  0.5  0").alias("line")).write.mode("append").text(f"{at}/tiles")
    assert load(touched.where("name = 'A'")) == (want, "invalid: tiles")  # as many tiles as the head says
    head = spark.read.json(f"{at}/head").orderBy("n").select("line").toPandas()["line"].tolist()
    assert head == [caches.CACHE_HEAD, "1", "1", "100", "34", "A  /s/a  8  1", ""]


def test_refreshed(spark, tmp_path):
    at = str(tmp_path / "union")
    schema = "source string, path string, size long, mtime string"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))
    rows = [(s, f"p{i}", i, "2025-01-01 00:00:00") for s in ("a", "b", "c d") for i in range(5)]
    told = lambda rows: dict(map(tuple, caches.refreshed(spark, at, frame(rows)).collect()))
    assert told(rows) == {"a": "new", "b": "new", "c d": "new"}
    written = lambda s: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "union/entries").glob(f"source={s}/*.parquet")}
    before = written("a")
    rows = [(s, p, n, "2025-01-02 00:00:00" if (s, p) == ("b", "p1") else t) for s, p, n, t in rows if s != "c d"] + [("e", "p9", 1, "2025-01-01 00:00:00")]
    assert told(rows) == {"a": "kept", "b": "changed", "c d": "gone", "e": "new"}
    assert written("a") == before and before  # untouched
    assert told(rows) == {"a": "kept", "b": "kept", "e": "kept"}
    got = sorted((r.source, r.path, r.size) for r in caches.entries(spark, at).collect())
    assert got == sorted((s, p, n) for s, p, n, _ in rows)
    order = spark.createDataFrame([("a", "2"), ("b", "1"), ("e", "3")], "source string, sort_key string")
    assert {r.path: r.source for r in caches.union_index(spark, at, order).collect()} == {**{f"p{i}": "b" for i in range(5)}, "p9": "e"}


def test_many_sources_share_folders(spark, tmp_path, monkeypatch):
    """Folders stay few however many sources there are; only what changed is written, and what is stored is what there is."""
    monkeypatch.setattr(caches, "OWN", 3, raising=False)
    monkeypatch.setattr(caches, "PARTS", 3, raising=False)
    at, there = str(tmp_path / "union"), {}

    def refresh(**sizes):
        for s, n in sizes.items():
            there.pop(s, None) if n is None else there.update({s: n})
        rows = [(s, f"p{i}", n) for s, n in there.items() for i in range(2)]
        f = spark.createDataFrame(rows, "source string, path string, size long").withColumn("mtime", F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00")))
        told = dict(map(tuple, caches.refreshed(spark, at, f).collect()))
        assert sorted((r.source, r.path, r.size) for r in caches.entries(spark, at).collect()) == sorted(rows)
        folders = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "union").glob("[es]*/*/*.parquet")}
        assert len(folders) <= 3 + 4
        return {s: w for s, w in told.items() if w != "kept"}, folders

    refresh(a=1, b=1)
    told, one = refresh(**{f"s{i}": i for i in range(40)}, b=2)
    assert len(told) == 41 and "source=a" in one and "source=b" not in one and len(one) == 2
    told, two = refresh(s1=70, s2=None, s3=80)
    assert told == {"s1": "changed", "s2": "gone", "s3": "changed"}
    assert len(two.keys() - one.keys()) == 1 or "source=s1" in two
    assert one.items() <= two.items()  # kept ones untouched
    for i in range(6):
        refresh(**{f"s{i}": 100 + i, f"t{i}": 1, f"u{i}": 1, f"v{i}": 1})
    assert refresh()[0] == {}
    refresh(**{s: None for s in [*there][1:]})
    assert len(there) == 1 and len(list((tmp_path / "union").glob("shared/*"))) <= 1


@pytest.fixture()
def sources(tmp_path):
    for s in ("one", "two", ".hidden"):
        for p in ("Earth nav data/+10/x.dsf", "terrain/a.ter", "terrain/deep/b.ter", "textures/c.dds", "readme.txt"):
            (tmp_path / s / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / s / p).write_text(s + p)
    (tmp_path / "no folder").write_text("x")
    return str(tmp_path)


def test_tree(spark, sources):
    want = {(s, os.path.relpath(f"{d}/{f}", f"{sources}/{s}"), os.path.getsize(f"{d}/{f}")) for s in ("one", "two") for d, _, names in os.walk(f"{sources}/{s}") for f in names}
    rows = lambda d: {(r.source, r.path, r.size) for r in d.collect()}
    assert rows(trees.tree(spark, sources)) == want
    assert rows(trees.partial_index(spark, sources)) == {x for x in want if x[1].split("/")[0] not in trees.LAZY}
    assert rows(trees.lazily(spark, sources, "two", "terrain")) == {x for x in want if x[0] == "two" and x[1].startswith("terrain/")}


def test_tree_lists_what_is_asked_for(sources, monkeypatch):
    from pyspark.sql.datasource import EqualTo, In, Not

    listed, scan = [], os.scandir
    monkeypatch.setattr(trees.os, "scandir", lambda p: (listed.append(os.path.relpath(p, sources)), scan(p))[1])

    def read(*filters):
        r = trees.TreeReader(sources)
        assert list(r.pushFilters(list(filters))) == list(filters)
        listed.clear()
        return {(p.value, row[2]) for p in r.partitions() for row in r.read(p)}

    assert len(read()) == 10 and "one/terrain/deep" in listed
    assert len(read(Not(In(("folder",), trees.LAZY)))) == 4 and not [x for x in listed if "terrain" in x or "textures" in x]
    assert read(EqualTo(("source",), "two"), EqualTo(("folder",), "textures")) == {("two", "textures/c.dds")} and set(listed) == {".", "two", "two/textures"}


def test_airports_by_splits(spark, tmp_path):
    r = random.Random(4)
    lines, want = ["I", "1100 Version", ""], []
    for i in range(400):
        lines.append(f"1 {i} 0 0 Z{i:03} Field {i}")
        lines += ["20 sign " + "x" * r.randint(0, 90) for _ in range(r.randint(0, 6))]
        if i % 3 != 2:
            lines += [f"1302 datum_lat {i % 80}.5", f"1302 datum_lon -{i % 170}.25"]
            want.append((f"Z{i:03}", f"Field {i}", i % 80 + 0.5, -(i % 170) - 0.25, float(i)))
        lines += ["99"] * (i % 2)
    for n, name in ((0, "a.dat"), (1, "b.dat")):
        (tmp_path / name).write_bytes("\r\n".join([*lines, ""] if n else lines).encode())
    read = lambda: sorted(map(tuple, files.airports(spark, str(tmp_path)).collect()))
    whole = read()
    assert whole == sorted(want * 2)
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        assert files._split_lines(spark, str(tmp_path)).select("file", "split").distinct().count() > 10
        assert read() == whole
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)


def test_binary_floats(spark):
    values = [0.0, 1.0, -2.5, 0.1, 3.4e38, -1.2e-38, 65504.0, 1 / 3, 2.0**-126, 16777217.0, -0.75]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, v double")
    got = df.select("seq", F.unhex(binary.single_hex(F.col("v"))).alias("b")).orderBy("seq").collect()
    assert [struct.unpack("<f", r.b)[0] for r in got] == [struct.unpack("<f", struct.pack("<f", v))[0] for v in values]
    raw = [struct.pack("<If", 20, v) for v in [*values, 1e-40, float("inf")]]
    d = spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "seq long, packet binary").withColumn("bits", binary.word("packet", F.lit(4)))
    rows = d.select(binary.word("packet", F.lit(0)).alias("n"), binary.float_of(F.col("bits")).alias("v"), binary.word("packet", F.lit(6)).alias("none"), "seq").orderBy("seq").collect()
    assert [(r.n, r.v, r.none) for r in rows] == [(20, struct.unpack("<f", b[4:])[0], None) for b in raw]


def test_data_packets_odd(spark):
    record = lambda n, *v: struct.pack("<I8f", n, *v, *[0.0] * (8 - len(v)))
    rows = [(1, b"DATA*" + record(20, 1.5, 2.5, 0, 300.0) + record(20, 3.5, 4.5, 0, 500.0)), (2, b"DATA"), (3, b"DATA*" + record(5, 1.0)), (4, b"DATA*" + record(17, 0, 0, -90.0)[:35]), (5, None), (6, b"XGPS2,1"), (7, b"DATA*" + record(17, 0, 0, -90.0))]
    got = files.data_packets(spark.createDataFrame(rows, "seq long, packet binary")).orderBy("seq").collect()
    assert list(map(tuple, got)) == [(1, 3.5, 4.5, 500.0, None, None), (7, None, None, None, 270.0, None)]
