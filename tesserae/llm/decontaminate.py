"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by the number of their distinct word shingles. Each partition has a bottom-k MinHash sketch whose k
follows from the partition's largest size: an item of n shingles that a document holds to a share of `least` or more misses
at most floor((1 - least) * n) of them, so among the k = floor((1 - least) * largest) + 1 smallest hashes at least one is in the
document. Documents are read as the stream of all their shingle hashes, however long they are, so no pair is missed and the
length of a document does not thin out its sketch. Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, in_arrow

WORDS = 5
LEAST = 0.8
#: Bytes of test items up to which their shingle table goes to every task; beyond, the search is a shuffled join.
BROADCAST_BYTES = 32 << 20
#: Upper bounds of the size partitions double from here.
FIRST_SIZE = 8
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]  # odd, fixed
_SCHEMA = "doc_id long, row long, item_id long, n_item long, n_shared long, containment double"


def shingles(text: bytes | None, words: int = WORDS) -> list[bytes]:
    """Lower-cased (A-Z) word shingles in order; fewer words: the whole sequence as one; none: no shingle."""
    w = (text or b"").lower().split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)))))


def hashes(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the same shingles, made from the words' hashes."""
    w = (text or b"").lower().split()
    own = np.frombuffer(b"".join(map(xxhash.xxh64_digest, w)), ">u8").astype(np.uint64)
    if len(own) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=2)] if w else [], np.uint64)
    return combined(own, words)


def combined(own: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of so many words, from the words' hashes."""
    n = max(0, len(own) - words + 1)
    h = own[:n] * np.uint64(_MULTIPLIERS[0])
    for i in range(1, words):
        h ^= own[i : i + n]
        h *= np.uint64(_MULTIPLIERS[i % len(_MULTIPLIERS)])
        h ^= h >> np.uint64(29)
    return h


def partition_of(n: int) -> int:
    """Upper bound of the size partition of an item of n shingles."""
    u = FIRST_SIZE
    while u < n:
        u *= 2
    return u


def sketch_size(n: int, least: float = LEAST) -> int:
    return min(n, int(np.floor((1 - least) * partition_of(n) + 1e-9)) + 1)


class Searcher:
    """The sketches and shingles of the test items, as every task holds them."""

    def __init__(self, items: list[tuple[int, bytes]], words: int = WORDS, least: float = LEAST):
        self.words, self.least, self.items = words, least, []
        by: dict[int, list[int]] = {}
        for item_id, text in items:
            if sh := set(shingles(text, words)):
                for h in np.unique(hashes(text, words))[: sketch_size(len(sh), least)]:
                    by.setdefault(int(h), []).append(len(self.items))
                self.items.append((item_id, sh))
        self.by = by
        self.bits = np.zeros(1 << 20, bool)
        if by:
            self.bits[np.fromiter(by, np.uint64, len(by)) & np.uint64((1 << 20) - 1)] = True

    def find(self, text: bytes | None) -> list[tuple[int, int, int]]:
        """(item_id, shingles of the item, of those in text) for each item held to the least share."""
        h = hashes(text, self.words)
        hits = h[self.bits[h & np.uint64((1 << 20) - 1)]]
        near = {i for x in set(hits.tolist()) for i in self.by.get(x, ())}
        if not near:
            return []
        own, out = set(shingles(text, self.words)), []
        for i in sorted(near):
            item_id, sh = self.items[i]
            if (n := len(sh & own)) >= self.least * len(sh) - 1e-9:
                out.append((item_id, len(sh), n))
        return out


def contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, least: float = LEAST, bound: int = BROADCAST_BYTES, rows: bool = False) -> DataFrame:
    """One row per document and test item of which the document holds a share of `least` or more of the distinct shingles.

    docs: doc_id, text; items: item_id, text; other columns are not read. Returns doc_id, item_id, n_item (distinct shingles of
    the item), n_shared (of those in the document), containment. Null and empty texts match nothing; an item of fewer words
    than a shingle matches a document of the same words only. Repeated rows give one row (with the largest share); items of equal
    text are all reported; null ids are kept as they are. Empty tables give an empty result. With `rows`, documents of one id and
    different texts are told apart by the column row, a hash of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").where("text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    found = _held(docs, items, words, least) if size <= bound else _joined(docs, items, words, least)
    ids = ["doc_id", "row", "item_id"] if rows else ["doc_id", "item_id"]
    return found.groupBy(*ids).agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("m")).select(*ids, "m.n_item", "m.n_shared", "m.containment")


def _held(docs: DataFrame, items: DataFrame, words: int, least: float) -> DataFrame:
    """The items' size is checked: they go to the tasks, and documents are not shuffled at all."""
    sc = docs.sparkSession.sparkContext
    own = sc.broadcast([(r.item_id, r.text.encode()) for r in items.collect()])
    made: dict[str, Searcher] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = made.get("s") or made.setdefault("s", Searcher(own.value, words, least))
        for b in batches:
            rows = [(d, r, i, n, k, k / n) for d, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)) for i, n, k in search.find(t.as_buffer().to_pybytes() if t.is_valid else None)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "row", "item_id", "n_item", "n_shared", "containment"])

    return in_arrow(docs, run, _SCHEMA)


def _joined(docs: DataFrame, items: DataFrame, words: int, least: float) -> DataFrame:
    """For any size of the items: sketches are joined to the documents' shingles, then candidates are verified by a second join."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1))
    sh = F.when(F.size("w") >= words, F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.array_join(F.slice("w", i, words), " ")))
    sh = F.when(F.size("w") == 0, F.array().cast("array<string>")).otherwise(F.coalesce(sh, F.array(F.array_join("w", " "))))
    # Inline one list of one element, so that the words are made once and not for every shingle.
    split = lambda df, *keep: df.select(*keep, F.explode(F.array(w)).alias("w")).select(*keep, F.array_distinct(sh).alias("sh"))
    d = split(docs, "doc_id", "row").select("doc_id", "row", F.explode("sh").alias("s"))
    i = split(items.withColumn("item_row", F.xxhash64("text")).dropDuplicates(["item_id", "item_row"]), "item_id", "item_row").withColumn("n_item", F.size("sh").cast("long")).where("n_item > 0")
    upper = F.lit(FIRST_SIZE) * F.pow(2, F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_item") / FIRST_SIZE) - 1e-9)))
    k = F.least(F.col("n_item"), F.floor(F.lit(1 - least) * upper + 1e-9) + 1).cast("int")
    ranked = F.slice(F.array_sort(F.transform("sh", lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s")))), 1, k)
    sketch = i.select("item_id", "item_row", F.explode(ranked).alias("x")).select("item_id", "item_row", F.col("x.s").alias("s"))
    near = d.join(sketch, "s").select("doc_id", "row", "item_id", "item_row").distinct()
    held = d.join(i.select("item_id", "item_row", "n_item", F.explode("sh").alias("s")), "s")
    on = [near.doc_id.eqNullSafe(held.doc_id), near.row == held.row, near.item_id.eqNullSafe(held.item_id), near.item_row == held.item_row]
    n = held.join(near, on, "left_semi").groupBy("doc_id", "row", "item_id", "item_row", "n_item").agg(F.count_distinct("s").alias("n_shared"))
    return n.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("n_shared") >= F.lit(least) * F.col("n_item") - 1e-9).drop("item_row")

