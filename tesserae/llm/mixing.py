"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order. A document's virtual finish time is the number of words its source
has sent up to its end, divided by the source's target. All queues are merged by that time. As the targets add up to the budget, the
merged stream reaches the budget at virtual time 1, and each source has then sent its target, to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, cut, whole

WEIGHTS = (5, 2, 1)
#: Budget as a share of all sizes, and the most often that any source (and so any document) is taken.
SHARE, REPEATS = 1.5, 2
#: Each source's shuffled order is cut into so many ranges, whose sums give the place of each range; so a hot source is spread.
RANGES = 1024
SEED = "mix"


def n_words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): the budget shared by weight, each target at most repeats * size.

    Sources in code point order, null last, take the weights in turn. Sorted by the level at which a source is full, the full
    ones are a prefix, found by running sums; so the resharing of what they leave needs no iteration. One row per source.
    """
    w = sizes.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * repeats).withColumn("full_at", F.col("cap").cast("double") / F.col("w"))
    whole, order = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("full_at", "rn")
    w = w.withColumn("budget", F.sum("source_size").over(whole) * F.lit(share).cast("double"))
    w = w.withColumn("before", F.sum("cap").over(order) - F.col("cap")).withColumn("rest", F.sum("w").over(whole) - F.sum("w").over(order) + F.col("w"))
    w = w.withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest")).withColumn("full", F.col("full_at") <= F.col("level"))
    w = w.withColumn("at", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("at"))
    return w.select("source", "source_size", target.alias("target"))


def schedule(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED, ranges: int = RANGES) -> DataFrame:
    """(doc_id, source, size) to the same with source_size, target, before (words of the source ahead), finish and taken.

    The shuffled order is by a hash of doc_id and seed, then doc_id and size: the same in every run. taken: the words the mix takes of the
    document, over all repeats; the document at a source's target is taken in part, its first words. finish: virtual finish
    time of the first copy, null where the target is 0. Documents without words take nothing. Rows equal in all three columns, those of a null
    doc_id among them, are counted and numbered, so that no task holds them all.
    """
    bits = 52
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, bits // 4), 16, 10).cast("long")
    own = cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("key", key).withColumn("range", F.floor(F.col("key") / F.lit((1 << bits) // ranges)).cast("int")))
    per = own.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("sum"))
    goal = targets(per.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, repeats)
    in_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.withColumn("ahead", F.coalesce(F.sum("sum").over(in_source), F.lit(0))).drop("sum")
    g = goal.withColumnRenamed("source", "s")
    ahead = ahead.join(g, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("range").alias("r"), "ahead", "source_size", "target")
    rows = own.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    in_range = Window.partitionBy("s", "r").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.col("ahead") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(in_range), F.lit(0)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("before", F.col("first") + F.col("copy") * F.col("size"))
    goal_words = F.round("target").cast("long")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), goal_words - F.col("before") - F.col("source_size") * e)) for e in range(repeats)), F.lit(0))
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("size")) / F.col("target"))
    return rows.withColumn("taken", taken.cast("long")).withColumn("finish", finish).select("doc_id", "source", "size", "source_size", "target", "before", "finish", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per row of docs in the order of the mix: doc_id, size, source_size, target, taken, finish.

    Null text has size 0, a null source is a source of its own, repeated rows count each. An empty table gives an empty result.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    return schedule(sized, **how).select("doc_id", "size", "source_size", "target", "taken", "finish").orderBy("finish", "doc_id", "size")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, rounded to whole documents; no other change.

    Documents without words stay once. Rows are matched by doc_id, source and size, and repeated rows among them are given
    their copies one each.
    """
    sized = whole(docs, d=F.col("doc_id"), s=F.col("source"), n=n_words(F.col("text")), text=F.col("text"))
    plan = schedule(sized.select(F.col("d").alias("doc_id"), F.col("s").alias("source"), F.col("n").alias("size")), **how)
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("long")
    plan = plan.groupBy("doc_id", "source", "size").agg(F.sum(times).alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    plan = plan.select(F.col("doc_id").alias("pd"), F.col("source").alias("ps"), F.col("size").alias("pn"), "copies", "rows")
    kept = sized.join(plan, F.col("d").eqNullSafe(F.col("pd")) & F.col("s").eqNullSafe(F.col("ps")) & (F.col("n") == F.col("pn")))
    # Rows equal in id, source and size, null ids among them, share the copies evenly, the first by text one more.
    rank = F.row_number().over(Window.partitionBy("d", "s", "n").orderBy(F.xxhash64("text")))
    once = kept.where("rows = 1").select("doc", F.col("copies").alias("c"))
    many = kept.where("rows > 1").select("doc", (F.floor(F.col("copies") / F.col("rows")) + F.when(rank <= F.pmod("copies", "rows"), 1).otherwise(0)).alias("c"))
    return once.unionByName(many.where("c > 0")).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c")))).select("doc.*")
