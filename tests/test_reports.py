"""Reports with nothing to tell, and lines in order whatever the partitions."""

from tesserae.operators import reports

TILES = "ref_id long, zoom int, row long, col long, provider string"
MISSING = "ref_id long, row long, col long, zoom int, lat float, lon float, p_zoom int, p_row long, p_col long, p_lat float, p_lon float"


def text(df):
    rows = sorted(map(tuple, df.select("n", "line").collect()))
    assert [n for n, _ in rows] == list(range(len(rows)))
    return [line for _, line in rows]


def test_nothing_to_tell(spark):
    tiles, missing = spark.createDataFrame([], TILES), spark.createDataFrame([], MISSING)
    j = text(reports.dedupe_json(tiles))
    assert j[:5] == ["{", '  "tiles_analyzed": 0,', '  "zoom_levels_present": [],', '  "overlaps_by_pair": {', ""] and j[-4:] == ['  "removed_by_zoom": {', "", "  }", "}"]
    t = text(reports.dedupe_text(tiles))
    assert "  No overlapping tiles found." in t and not any("Savings" in x for x in t)
    assert text(reports.gap_json(tiles, missing))[-4:] == ['  "missing_tiles": [', "", "  ]", "}"]
    assert text(reports.gap_text(tiles, missing))[-2] == "Estimated download size: ~0 bytes (to generate missing tiles)"
    assert len(text(reports.gap_coordinates(missing))) == 8 and len(text(reports.gap_cells(missing))) == 3


def test_removed_tiles_by_zoom(spark, tmp_path):
    full = lambda r, c, z, i: [(i + 4 * a + b, z, 4 * r + a, 4 * c + b, "BI") for a in range(4) for b in range(4)]
    low = [(1000 + i, 14, i, 5, "BI") for i in range(70)]
    high = [x for i in range(70) for x in full(i, 5, 16, 16 * i - 2000)]
    df = spark.createDataFrame(low + high, TILES).repartition(7)
    lines = reports.dedupe_json(df).cache()
    got = text(lines)
    assert '    "16-14": 70' in got and '  "tiles_removed_count": 70,' in got
    at = got.index('    "ZL14": [')
    assert [x.strip(' ",') for x in got[at + 1 : at + 71]] == [f"{i}_5_BI14.ter" for i in range(70)]
    assert got[at + 69].endswith(",") and not got[at + 70].endswith(",") and got[at + 71] == "    ]"
    reports.write(lines, str(tmp_path / "out"))
    assert [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()] == got
    t = text(reports.dedupe_text(df))
    assert "    (49, 5) - 49_5_BI14.ter" in t and "    (50, 5) - 50_5_BI14.ter" not in t and "    ... and 20 more" in t


def test_cells_and_coordinates(spark):
    rows = [(1, 8, 9, 16, 1.5, -0.5, 14, 2, 2, 1.0, 1.0), (1, 9, 9, 16, -0.25, 100.5, 14, 2, 2, 1.0, 1.0), (2, 7, 7, 16, -0.25, 3.0, 14, 1, 1, 1.0, 1.0)]
    m = spark.createDataFrame(rows, MISSING).repartition(3)
    assert text(reports.gap_cells(m))[3:] == ["-01+003: 1 missing ZL16 tiles", "-01+100: 1 missing ZL16 tiles", "+01-001: 1 missing ZL16 tiles"]
    assert text(reports.gap_coordinates(m))[2] == "# Generated for 2 gaps, 3 missing tiles"
    assert text(reports.gap_coordinates(m))[8:] == ["-0.2500, 3.0000, 16", "-0.2500, 100.5000, 16", "1.5000, -0.5000, 16"]
