"""Streams in order of event time: the same rows for any batches and files, and events of timers."""

import random

import pytest
from conftest import rows_of

from tesserae.operators import state
from tesserae.streaming import ordered, streams

ROWS = "source_id long, seq long, t double, arrived double, accuracy double, lat double, lon double"


def stream(spark, tmp_path, files, schema, per_batch):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03}"))
    r = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return (r.option("maxFilesPerTrigger", per_batch) if per_batch else r).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("per_batch,arrow,shuffled", [(None, 10_000, True), (1, 100, False), (1, 30, True)])
def test_fusion_in_any_batches(spark, tmp_path, per_batch, arrow, shuffled):
    r = random.Random(arrow)
    rows = [(s, i, float(i), float(i), r.choice([10.0, 10.0, 100.0, 1e5]), r.uniform(-80, 80), 0.0) for i in range(300) for s in (1, 2)]
    held, want = {}, []
    for x in rows:
        held[x[0]], o = state.fusion(held.get(x[0]), dict(zip(("source_id", "seq", "t", "arrived", "accuracy", "lat", "lon"), x)))
        want.append((x[0], x[1], o["accepted"], round(o["lat"], 6), o["accuracy"]))
    files = [rows[i : i + 100] for i in range(0, 600, 100)]
    for f in files:
        r.shuffle(f)
    if shuffled and per_batch is None:
        r.shuffle(files)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
    try:
        got = streams.drained(streams.fused(stream(spark, tmp_path, files, ROWS, per_batch), "0 seconds" if per_batch is None else "60 seconds"), "append").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    last = 299 - (0 if per_batch is None else 60)  # what the watermark has passed
    columns = ["source_id", "seq", "accepted", "lat", "accuracy"]
    import pandas as pd

    assert rows_of(got, columns) == rows_of(pd.DataFrame([w for w in want if w[1] <= last], columns=columns), columns)


def test_gone_without_another_row(spark, tmp_path):
    """Source 1 stops in the first batch; that it is gone is said in the second, which holds no row of it. Source 2 comes back after a gap."""
    files = [[(1, 0, 1.0), (1, 1, 2.0), (2, 2, 2.0)], [(2, 3, 4.0), (2, 4, 20.0), (3, 5, 21.0)], [(3, 6, 22.0)]]
    got = streams.drained(ordered.connections(stream(spark, tmp_path, files, "source_id long, seq long, t double", 1), "0 seconds", 5.0), "append")
    assert sorted(map(tuple, got.collect())) == [(1, 1.0, True), (1, 7.0, False), (2, 2.0, True), (2, 9.0, False), (2, 20.0, True), (3, 21.0, True)]


def test_many_keys_share_states(spark, tmp_path, monkeypatch):
    """Spark's states are as many as buckets and not as keys; a key may be null or beyond what a double holds."""
    monkeypatch.setattr(ordered, "BUCKETS", 16, raising=False)
    keys = [None, 2**53 + 1, 2**53 + 3, *range(300)]
    files = [[(k, i, float(i)) for k in keys] for i in range(3)]
    step = lambda n, r: ((n or 0) + 1, [(r[1], (n or 0) + 1, None if r[1] else 2**53 + 1)])
    d = ordered.in_order(stream(spark, tmp_path, files, "k long, seq long, t double", 1), "k", "t", ["seq"], [], "0 seconds", step, None, "k long, seq long, n long, m long")
    q = d.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 17
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted(((k, i, i + 1, None if i else 2**53 + 1) for k in keys for i in range(3)), key=str)
