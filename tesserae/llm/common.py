"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.ship import ship

#: ASCII white space separates words: 0x20 and 0x09 to 0x0D. bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def pieces(texts, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of an Arrow array of texts of so many bytes together, one text at least."""
    i, size = 0, 0
    for j, x in enumerate(texts):
        n = x.as_buffer().size if x.is_valid else 0
        if j > i and size + n > most:
            yield i, j
            i, size = j, 0
        size += n
    if len(texts):
        yield i, len(texts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the cluster's shared checkpoint folder and goes on from there.

    The folder is the one in spark.checkpoint.dir. Shuffles that no plan needs any more are released on the way.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    _release(df.sparkSession)
    return out


#: Seconds between two releases; and when the last one was.
RELEASE_S = 4.0
_released = [0.0]


def _release(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files once the driver's JVM has collected the plan, which a driver with room puts off for the whole run."""
    if time.monotonic() - _released[0] > RELEASE_S:
        spark._jvm.System.gc()
        _released[0] = time.monotonic()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. On a local master, where all tasks are in this machine, a temporary folder does; on a cluster it must be set."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return where or tempfile.mkdtemp(prefix="tesserae-")


def in_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """df.mapInArrow, with this package at hand in the workers. A batch has 16 MB or so, and not only a number of rows: texts may be long."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    return df.mapInArrow(run, schema)


#: Rows of a narrow table that may go to every task; beyond, it is joined by a shuffle.
SMALL_ROWS = 500_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most so many rows; df should be cut before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, by: list[str], name: str, salts: int = 64) -> DataFrame:
    """The rows of df with the columns `by` alone, equal rows numbered from 0. Equal rows are counted, not brought together."""
    n = df.select(*by, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("_salt")).groupBy(*by, "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_salt")) - F.col("_n")
    return n.withColumn("_before", before).select(*by, F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("_n") - 1)).alias(name))


def whole(docs: DataFrame, **columns) -> DataFrame:
    """Each row of docs as the struct doc, with the given columns beside it; names of docs cannot clash with them. select("doc.*") gives docs back."""
    return docs.select(F.struct("*").alias("doc"), *[c.alias(k) for k, c in columns.items()])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: one row (node, root) per node that has an edge to another.

    root is the smallest node of the component. Alternates large-star and small-star contraction, so the number of
    rounds grows with the logarithm of the longest path. A round shuffles the edges three times: each star's minimum is taken
    where its edges lie sorted, so they stream by and spill, and none is made of more edges than there were. Whether a round
    changed anything is seen as its edges are written. Nulls and self-loops are dropped.
    """
    star = Window.partitionBy("u")
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(star))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(star)).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        said = Observation()
        e = cut(small.distinct().observe(said, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        now = said.get
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
