"""Similar texts by an exact prefix filter over sets of word shingles.

All shingles have one order: by a hash, and those that very many texts have come last. Of two sets whose Jaccard similarity is the
least or more, the first shingles of each in that order (a prefix a little longer than the share that may differ) have several in common, so
texts meet over the shingles of their prefixes, however short they are, and a line that everyone has is in nobody's prefix. A text that does not
share as many of its prefix as a partner would have can have none, and goes; that is said again of what is left.

Texts that are left are compared with the best connected text of each of their shingles first, which joins most families at once. Only where texts of a
shingle are not connected after that, the groups they form over the rarest shingles of their prefixes are compared whole, once for all shingles, dealt out
as pairs of chunks; large groups whose shingles have few pairs, such as long chains, are compared by these.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import components, cut, in_arrow, parts, small
from tesserae.llm.decontaminate import hashes
from tesserae.llm.simhash import _runs
from tesserae.llm.substring import CHUNK, SIMILARITY, WORDS, _alike, _dealt, _packed, _verified, mixed

#: Share of a set by which its prefix is longer than it must be, and of which as many must be shared.
MORE = 0.15
#: One text of so many is read for shingles that HOT of them or more have; the most frequent MOST of those come last in the order. What is
#: found does not depend on it.
SAMPLE, HOT, MOST = 64, 16, 1 << 17
#: Rounds in which texts that cannot have a partner are looked for, before and after the first links; each spares comparisons, and costs jobs.
ROUNDS = 1


def more(n: int) -> int:
    return max(1, ceil(MORE * n - 1e-9))


def prefix(h: np.ndarray, last: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the shingles h (different ones, sorted) in the order in which those of `last` (sorted) come last."""
    n = len(h)
    at = np.searchsorted(last, h)
    late = last[np.minimum(at, len(last) - 1)] == h if len(last) else np.zeros(n, bool)
    order = mixed(h, 7) >> np.uint64(1) | late.astype(np.uint64) << np.uint64(63)
    return h[np.argsort(order, kind="stable")[: n - ceil(similarity * n - 1e-9) + more(n)]]


def _sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    return (np.unique(hashes(t.as_buffer().to_pybytes(), words)) for t in texts)


def _prefixes(own: DataFrame, last: np.ndarray, words: int, similarity: float) -> DataFrame:
    """(h, cls, n) of each text (cls, text): the shingles of its prefix, and its number of different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            if len(seen) > 1 << 20:
                seen.clear()
            every = b.column(0).to_pylist()
            new = [k for k in range(len(b)) if every[k] not in seen and not seen.add(every[k])]
            sets = list(_sets(b.column(1).take(pa.array(new, pa.int64())), words)) if new else []
            heads = [prefix(h, last, similarity) for h in sets]
            if sum(map(len, heads)):
                of = np.repeat(np.arange(len(new)), list(map(len, heads)))
                cls, n = np.array([every[k] for k in new], np.int64), np.array(list(map(len, sets)), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(cls[of]), pa.array(n[of])], ["h", "cls", "n"])

    return in_arrow(own.select("cls", "text"), run, "h long, cls long, n int")


def _frequent(own: DataFrame, words: int) -> np.ndarray:
    """Shingles that many of the sampled texts have, the most frequent MOST at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h in _sets(b.column(0), words):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    some = own.where(F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(SAMPLE)) == 0).dropDuplicates(["cls"]).select("text")
    many = in_arrow(some, run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "h").limit(MOST)
    return np.sort(np.array([r.h for r in many.collect()], np.int64).view(np.uint64))


def _shared(rows: DataFrame, by: str = "cls") -> DataFrame:
    """Rows of shingles that texts of different `by` have."""
    w = Window.partitionBy("h")
    return rows.withColumns({"_a": F.min(by).over(w), "_b": F.max(by).over(w)}).where("_a <> _b").drop("_a", "_b")


def _viable(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows of the texts that share enough of their prefix: as many as the smallest partner's is longer than it must be."""
    few = rows.groupBy("cls", "n").agg(F.count("*").alias("c")).where(F.col("c") < _need(similarity)).select("cls")
    return rows.join(small(cut(few)), "cls", "left_anti")


def _need(similarity: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(MORE) * F.ceil(F.lit(similarity) * F.col("n") - 1e-9) - 1e-9))


def _rarest(rows: DataFrame, similarity: float) -> DataFrame:
    """Of each text's rows the rarest shingles', all but one less than it must share: of the shingles that two texts share enough of, the rarest is
    among these for both."""
    text = Window.partitionBy("cls")
    ranked = rows.withColumn("m", F.count("*").over(Window.partitionBy("h"))).withColumns({"c": F.count("*").over(text), "r": F.row_number().over(text.orderBy("m", "h"))})
    return ranked.where(F.col("r") <= F.col("c") - _need(similarity) + 1).drop("m", "c", "r")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, chunk: int = CHUNK, rounds: int = ROUNDS) -> DataFrame:
    """Pairs (low, cls) of different texts, named by their xxHash64, that connect exactly what pairs of similar texts connect.

    Texts are similar if the sets of their shingles (lower-cased A-Z; fewer words: the whole sequence) have a Jaccard similarity of `similarity` or more,
    whatever their lengths. Null texts and texts without words have no pairs. Repeated rows and equal texts count once. Other columns are not read. An
    empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    own = own.withColumn("cls", F.xxhash64("text"))
    first = cut(own.groupBy("cls").agg(F.min("doc_id").alias("first_id")))
    rows = _prefixes(own, _frequent(own, words), words, similarity).repartition(parts(docs.sparkSession), "h")
    rows = cut(_shared(rows).distinct())
    for _ in range(rounds):
        rows = cut(_shared(_viable(rows, similarity)))

    size = rows.groupBy("h").agg(F.count("*").alias("m"))
    degree = cut(rows.join(size, "h").groupBy("cls").agg(F.sum(F.col("m") - 1).alias("degree")))
    ranked = rows.join(small(degree), "cls")
    centre = ranked.groupBy("h").agg(F.max(F.struct("degree", "cls", "n")).alias("c")).select("h", F.col("c.cls").alias("low"), F.col("c.n").alias("m"))
    near = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - 1e-6
    pairs = cut(rows.join(centre, "h").where((F.col("cls") != F.col("low")) & near).select("low", "cls").distinct())
    texts = rows.select("cls").distinct().withColumn("low", F.col("cls"))
    packed = cut(_packed(own, texts, first))
    links = cut(_verified(pairs, packed, words, 0, similarity, whole=True).where(F.col("similarity") >= similarity - 1e-9).select("low", "cls"))

    root = components(links, "low", "cls").withColumnsRenamed({"node": "cls", "root": "comp"})
    open_ = cut(_shared(rows.join(root, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "comp"))
    for _ in range(rounds):  # and which share enough with texts that they are not connected with
        open_ = cut(_shared(_viable(open_, similarity), "comp"))
    open_ = cut(_shared(_rarest(open_, similarity), "comp"))
    edges = open_.select("cls", F.min("cls").over(Window.partitionBy("h")).alias("b")).distinct()
    blob = components(edges, "cls", "b").withColumnsRenamed({"node": "cls", "root": "key"})
    left = cut(open_.select("cls", "comp").distinct().join(blob, "cls"))
    main = left.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "comp")).alias("x")).select("key", F.col("x.comp").alias("main"))
    left = cut(left.join(main, "key").select("key", "cls", (F.col("comp") == F.col("main")).alias("settled")))
    counts = left.groupBy("key").agg(F.count_if(~F.col("settled")).alias("f"), F.count_if("settled").alias("s")).where("f > 0 and f + s > 1")
    # A group of many chunks costs a text for each of its own and each other chunk; if its shingles have fewer pairs than that, these are compared alone.
    cf, cs = F.ceil(F.col("f") / chunk), F.ceil(F.col("s") / chunk)
    met = open_.join(blob, "cls").groupBy("key", "h").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("met"))
    counts = cut(counts.join(met, "key").withColumn("sparse", (cf + cs > 2) & (F.col("met") < F.col("f") * (cf + cs) + F.col("s") * cf)).drop("met"))
    some = open_.join(blob, "cls").join(small(cut(counts.where("sparse").select("key"))), "key", "left_semi").select("h", "cls", "n", "comp")
    other = some.select("h", F.col("cls").alias("low"), F.col("n").alias("m"), F.col("comp").alias("of"))
    pairs = cut(some.join(other, "h").where((F.col("low") < F.col("cls")) & (F.col("comp") != F.col("of")) & near).select("low", "cls").distinct())
    met = _verified(pairs, packed, words, 0, similarity, whole=True).where(F.col("similarity") >= similarity - 1e-9).select("low", "cls")
    dealt = _dealt(left.join(small(cut(counts.where("not sparse").drop("sparse"))), "key"), chunk).join(packed, "cls").select("key", "unit", "cls", "settled", "own", "z")
    dealt = dealt.repartition(parts(docs.sparkSession), "key", "unit").sortWithinPartitions("key", "unit", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for t in _runs(batches, ["key", "unit"]):
            k = np.stack([t.column(x).to_numpy() for x in ("key", "unit")])
            at = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1), len(t)]
            out = []
            for i, j in zip(at, at[1:]):
                g = t.slice(i, j - i)
                sets = [np.unique(hashes(z.decompress(x.as_py()), words)) for x in g.column("z")]
                out += _alike(sets, g.column("cls").to_pylist(), ~g.column("settled").to_numpy(), g.column("own").to_numpy(), bool(k[1, i] < 0), similarity)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["low", "cls"])

    return links.unionByName(met).unionByName(in_arrow(dealt, run, "low long, cls long"))
