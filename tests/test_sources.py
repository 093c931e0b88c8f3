"""Readers over small files written here."""

from tesserae.operators import reports
from tesserae.sources import files


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_terrain(spark, tmp_path):
    put(tmp_path / "a/100_200_BI18.ter", "A\n800\nLOAD_CENTER -12.25 77.5 900 2048\nBASE_TEX_NOWRAP ../textures/1600_3200_BI18.dds\nBASE_TEX ../textures/1616_3216_GO218.dds\n")
    put(tmp_path / "a/1600_3200_BI18_sea.ter", "LOAD_CENTER 44.5 2.5 1 1\nBASE_TEX ../textures/1600_3200_BI18.dds\n")
    put(tmp_path / "a/bad.ter", "LOAD_CENTER x\n")
    got = sorted(files.terrain(spark, str(tmp_path)).select("row", "zoom", "provider", "is_sea").collect())
    assert [tuple(r) for r in got] == [(1600, 18, "BI", True), (1616, 18, "GO2", False)]
    inside = files.terrain_in(spark, str(tmp_path), (44.0, 45.0, 2.0, 3.0)).collect()
    assert [tuple(r) for r in inside] == [(100, 200, 14)]


def test_airports(spark, tmp_path):
    lines = ["I", "1100 made here", "", "1 812 0 0 QAAA Upper Meadow Field", "1302 datum_lat 12.5", "1302 datum_lon -7.25", "", "16 3 0 0 QBBB Long Lake", "101 49.0 1 08 -33.5 140.75 26 -33.6 140.8", "17 77 0 0 QCCC Without Place", "99"]
    put(tmp_path / "apt.dat", "\n".join(lines))
    got = {r.icao: r for r in files.airports(spark, str(tmp_path / "apt.dat")).collect()}
    assert set(got) <= {"QAAA", "QBBB"} and got["QAAA"].name == "Upper Meadow Field" and (got["QAAA"].latitude, got["QAAA"].longitude, got["QAAA"].elevation_ft) == (12.5, -7.25, 812)


def test_library(spark, tmp_path):
    rows = [("c1", "Z", "EUROPE", "1.0.0", "http://a"), ("c2", "Y", "ASIA", "2.0.0", "http://b")]
    e = spark.createDataFrame(rows, "checksum string, package_type string, title string, version string, metadata_url string")
    put(tmp_path / "library.txt", "\n".join(r.line for r in reports.library_lines(e, "MADE", "WORLD", 3, "2025-01-01T00:00:00Z").sort("n").collect()))
    assert sorted(tuple(r) for r in files.library(spark, str(tmp_path / "library.txt")).collect()) == sorted(rows)
    head = files.library_head(files._lines(spark, str(tmp_path / "library.txt"), "*")).first()
    assert head.ok and (head.scope, head.sequence, head.packages) == ("WORLD", 3, 2)


def test_listings(spark, tmp_path):
    put(tmp_path / "c/+53+009/tile_12_5_7.cache", "abc")
    got = files.cache_files(spark, str(tmp_path / "c")).first()
    assert got.key == "tile:12:5:7" and got.size_bytes == 3
    put(tmp_path / "p/x/Earth nav data/+50+000/+53+009.dsf", "x")
    assert [tuple(r) for r in files.coverage(spark, str(tmp_path / "p")).collect()] == [(53, 9)]
    put(tmp_path / "s/one/textures/a.dds", "x")
    put(tmp_path / "s/one/Earth nav data/a.dsf", "x")
    put(tmp_path / "s/one/readme.txt", "x")
    assert [(r.source, r.path) for r in files.source_tree(spark, str(tmp_path / "s")).collect()] == [("one", "Earth%20nav%20data/a.dsf")] or [(r.source, r.path) for r in files.source_tree(spark, str(tmp_path / "s")).collect()] == [("one", "Earth nav data/a.dsf")]
    assert len(files.checksums(spark, str(tmp_path / "s")).first().sha256) == 64


def test_packets(spark):
    d = spark.createDataFrame([(1, "XGPSq,12.5,-7.25,640.0,41.5,30.0"), (2, "XATTq,66.5,0.5,1.5"), (3, "junk")], "seq int, packet string")
    got = {r.seq: r for r in files.packets(d).collect()}
    assert set(got) == {1, 2} and got[1].lat == -7.25 and round(got[1].knots, 3) == 58.315 and got[2].heading == 66.5


def test_geojson(spark):
    d = spark.createDataFrame([(53, 9)], "dsf_lat int, dsf_lon int")
    assert '"name":"+53+009"' in files.geojson(d).first().feature
