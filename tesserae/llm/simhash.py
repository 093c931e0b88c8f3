"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint holds a majority vote over the hashes of all word shingles. To find every pair of fingerprints at Hamming
distance r or less, each of the 64 bit positions gets a random non-zero vector of r + 1 bits, and each of the 2**(r+1)-1
non-zero vectors v gives one mask: the positions whose vector is not orthogonal to v over GF(2). The r positions at which a pair may
differ span a space of dimension r at most, so some v is orthogonal to all of them: its mask holds none, and under it the pair is equal.
No pair within the radius is missed; the rest is filtered by the exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import components, cut, in_arrow, parts

RADIUS = 3
WORDS = 3
SEED = 42
#: Fingerprints compared in one task at most; larger buckets are dealt out as pairs of chunks of this size.
CHUNK = 2048
_STEP = 1 << 15


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """64-bit SimHash of the lower-cased (A-Z) word shingles; 0 without words."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    h = partial(xxhash.xxh64_intdigest, seed=SEED)
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    it = map(h, map(b" ".join, zip(*(w[i:] for i in range(words))))) if len(w) >= words else iter([h(b" ".join(w))])
    while len(a := np.fromiter(islice(it, _STEP), np.uint64)):
        ones += np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, row, fp): row is a hash of the text, fp the fingerprint as a signed long. Null text counts as empty; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, words) for t in b.column(2)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(own, run, "doc_id long, row long, fp long")


def masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """The covering masks as signed 64-bit integers."""
    rng = np.random.default_rng(seed)
    own = rng.integers(1, 1 << (radius + 1), 64)  # non-zero, else a position would be in no mask
    out = []
    for v in range(1, 1 << (radius + 1)):
        m = sum(1 << i for i in range(64) if bin(int(own[i]) & v).count("1") % 2 == 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, root) that join what is connected by links within radius among fp. Each item is compared once with what is left."""
    left, xs, roots = fp.copy(), [], []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                got, left = left[near], left[~near]
                xs.append(got)
                roots.append(np.full(len(got), root))
                queue.extend(got)
    if not xs:
        return fp[:0], fp[:0]
    return np.concatenate(xs), np.concatenate(roots)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cuts sorted batches into tables that hold whole groups of equal keys."""
    kept: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([kept, t]) if kept is not None else t
        if not len(t):
            continue
        k = np.stack([t.column(c).to_numpy() for c in keys])
        new = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        at = int(new[-1]) if len(new) else 0
        if at:
            yield t.slice(0, at)
        kept = t.slice(at).combine_chunks()
    if kept is not None and len(kept):
        yield kept


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """From distinct fingerprints (column fp) the edges (a, b) of a forest that connects exactly what links connect.

    Buckets of one fingerprint are dropped, buckets of over `chunk` are dealt out as pairs of chunks, so that a task holds
    2 * chunk fingerprints of a bucket at most; within a bucket no list of pairs is written, only edges of the forest.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    size = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(size, ["t", "key"])
    c = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("c")).cast("int")
    pairs = F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda j: j != F.col("own")), lambda j: F.least(j, F.col("own")) * F.col("c") + F.greatest(j, F.col("own")))
    )
    rows = rows.withColumn("c", c).withColumn("own", own).select("t", "key", "fp", F.explode(pairs).alias("p"))
    keys = ["t", "key", "p"]
    dealt = rows.repartition(parts(fps.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, keys):
            k = np.stack([t.column(x).to_numpy() for x in keys])
            at = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1), len(t)]
            fp = t.column("fp").to_numpy().view(np.uint64)
            got = [_forest(fp[i:j], radius) for i, j in zip(at, at[1:]) if j - i > 1]
            if got:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return in_arrow(dealt, run, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id, kept, row.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable over links (radius or fewer differing
    bits), the row's own included. kept: whether the row is its component's first by doc_id, nulls last, then row, a hash of the
    text; rows equal in both are kept together. Null and empty texts have fingerprint zero and link like any other. Rows with a
    null doc_id take part; a component without any known doc_id has a null component_id. Other columns of docs are not read. An
    empty table gives an empty result.
    """
    own = cut(fingerprints(docs, id_col, text_col, words))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = cut(own.groupBy("fp").agg(F.min(place).alias("first")))
    roots = components(links(first.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first").alias("low"))
    named = named.join(lowest, "root").select("fp", "low")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low.doc_id").alias("component_id"), (place == F.col("low")).alias("kept"), "row")
