"""The corpus pipeline: quality, near duplicates, benchmark passages, mix, shards. Each stage gets what the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, mixing, quality, sharding, similarity, simhash
from tesserae.llm.common import components, cut, shared_folder, small, table, whole

#: Not SQL: language model scores, xxHash fingerprints and an edited slot map. The stages are tested against brute force.
ORACLE_SQL = None
ROW = ["id", "row"]


def _rows(docs: DataFrame) -> DataFrame:
    """Each document as a struct, with its doc_id and the hash of its text that the operators name it by."""
    return whole(docs, id=F.col("doc_id").cast("long"), row=F.xxhash64(F.col("text").cast("string")))


def _join(rows: DataFrame, named: DataFrame, how: str) -> DataFrame:
    """A semi or anti join by id and row, nulls compared as values. Few go to every task, and texts stay where they are."""
    named = small(cut(named.select(F.col("doc_id").alias("i"), F.col("row").alias("r")).distinct()))
    return rows.join(named, F.col("id").eqNullSafe(F.col("i")) & F.col("row").eqNullSafe(F.col("r")), how)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    bad = quality.scored(docs, table(spark, sf_dir, "labels")).where("not kept")
    return _join(_rows(docs), bad, "left_anti").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that of the smallest doc_id. Texts are linked by their SimHash, and, as 64 bits tell texts of
    similarity 0.8 apart, also where their sets of five-word shingles are as similar as that."""
    own = cut(simhash.fingerprints(docs))
    near = simhash.links(own.select("fp").distinct())
    node = lambda c: F.xxhash64(F.lit("fp"), F.col(c))  # noqa: E731  fingerprints are nodes beside the texts
    links = own.select(F.col("row").alias("a"), node("fp").alias("b")).unionByName(near.select(node("a").alias("a"), node("b").alias("b"))).unionByName(similarity.similar(docs).toDF("b", "a"))
    groups = own.join(components(links).toDF("row", "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = groups.groupBy(F.col("root").alias("of")).agg(F.min(place).alias("first"))
    groups = cut(groups.join(first, F.col("root") == F.col("of")).select("doc_id", "row", place.eqNullSafe(F.col("first")).alias("kept")))
    many = cut(groups.where("kept").groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1"))
    one = _join(_rows(docs), many, "left_semi").dropDuplicates(ROW)
    return _join(_rows(docs), groups.where("not kept").select("doc_id", "row").unionByName(many.select("doc_id", "row")), "left_anti").unionByName(one).select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bad = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), rows=True)
    return _join(_rows(docs), bad, "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, checksum, virtual slot, shard and the version of the slot map."""
    return sharding.assign(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the shared folder and read again; once the next stage's is written, it goes."""
    at, docs, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if last:
            _delete(spark, f"{at}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
