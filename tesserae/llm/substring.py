"""Substring near-duplicates by compact windows.

The tokens of a text are its word shingles. Under one hash function, the subsequences of which a given token is the minimum are
those that start in [l, c] and end in [c, r], where c is its place and l, r reach to the next smaller hashes on both sides: a compact
window, one node of the Cartesian tree over the hashes. Windows that hold no subsequence of the least length are left out, so a text of n
tokens has about 2n / length windows for each function.

Two passages of the least similarity share a run of `least_run` shingles, word by word, somewhere: each word that is put in, left out or
replaced takes WORDS - 1 shingles or more from both, and the similarity allows few such places. Over a shared run every function has the
same minima. So windows that hold a run of that length are made under two functions, as intervals of the runs' starts; windows of both
whose intervals meet hold a run in common, and texts are joined on both minima; no pair of similar passages is missed, but for passages of which
the unshared shingles repeat within them.

Groups of equal keys are joined as stars around their smallest text, and the pairs verified by aligning the whole texts. Places of a group
that its centre does not have in common are compared with all places of the group, by the shingles around them: counts of shared
shingles, made for many pairs at once, leave those to be aligned that can be similar. Shingles that no other text of a large group has
are counted first, so that groups that have a short line and nothing else in common end there, without any pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, cut, in_arrow, parts, pieces, small
from tesserae.llm.decontaminate import combined, hashes
from tesserae.llm.simhash import _runs

WORDS = 5
SIMILARITY = 0.8
#: Words of the shortest passage that counts.
LEAST_WORDS = 50
#: Bits of a key; by chance equal ones make candidates that are not verified.
KEY_BITS = 48
#: Places of a chunk; a task compares those of two chunks.
CHUNK = 256
#: Pieces of a group from which on those that cannot link are looked for first.
LARGE = 32
#: Longest run of unshared shingles inside a passage.
GAP = 24
#: Shingles on both sides of a place that are compared: more than a passage of twice the least length reaches.
AROUND = 96
#: Texts that are verified in one task with a star's centre.
STAR = 1024
#: One text of so many is looked at to find the keys that very many texts have: those of HOT texts of the sample and a 10,000th of it or
#: more. They are dealt over SALTS tasks and brought together afterwards. The sample decides where rows are worked on, not what is found.
SAMPLE, HOT, SALTS = 64, 16, 64


def least_run(t: int, words: int, similarity: float) -> int:
    """Shingles of the shortest run that two passages of t shingles or more share, whose similarity is the least.

    Of N shingles in both passages together at most N (1 - s) / (1 + s) are unshared, and each break costs words - 1 on both sides.
    """
    share = similarity / (1 + similarity)
    found = []
    for breaks in range(64):
        both = max(2 * t, ceil(breaks * 2 * (words - 1) / (1 - 2 * share))) if similarity < 1 else 2 * t
        found.append(ceil(ceil(share * both - 1e-9) / (breaks + 1)))
        if both > 2 * t and found[-1] > min(found) or similarity >= 1:
            break
    return max(1, min(found))


def mixed(h: np.ndarray, f: int) -> np.ndarray:
    """The f-th hash function: a bijective mix of the shingle's hash."""
    x = h ^ np.uint64(0x9E3779B97F4A7C15 * (f + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PLACE = np.uint64((1 << 28) - 1)


def _argmins(x: np.ndarray, t: int) -> np.ndarray:
    """The place of the minimum of each run of t values; the low bits of x are the place."""
    n = len(x)
    m = -(-n // t) * t
    rows = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    rows[:n] = x
    rows = rows.reshape(-1, t)
    head = np.minimum.accumulate(rows, 1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(tail[: n - t + 1], head[t - 1 : n]) & PLACE).astype(np.int64)


def compact_windows(v: np.ndarray, t: int) -> np.ndarray:
    """For each start of a run of t values the place of its minimum. Starts of the same place follow each other: the runs of one compact
    window. Values are compared by their upper 36 bits, then by place: the left one of equals is the smaller."""
    return _argmins((v & ~PLACE) | np.arange(len(v), dtype=np.uint64), t) if len(v) >= t else np.zeros(0, np.int64)


def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first start of each two windows, of two functions, that hold a run in common."""
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)


def windows(docs: DataFrame, words: int = WORDS, least: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, cls, lo, hi) of docs (cls, text): for each two compact windows of the two functions with a run in common, a hash of both
    minima, and the first and last place of the minima. All texts of a batch are worked on as one sequence, cut apart by
    zeros, which no window crosses. A text that a task has met before is not made again while it is remembered."""
    t = least_run(least - words + 1, words, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            every = b.column(0).to_pylist()
            for i, j in pieces(b.column(1), 2 << 20):
                if len(seen) > 1 << 20:
                    seen.clear()
                new = [k for k in range(i, j) if every[k] not in seen and not seen.add(every[k])]
                texts = [b.column(1)[k].as_buffer().to_pybytes() for k in new]
                h, doc = _joined_hashes(texts, words)
                if len(h) < t:
                    continue
                inside = doc >= 0
                start = np.full(len(texts), len(h))
                np.minimum.at(start, doc[inside], np.flatnonzero(inside))
                x, y = (compact_windows(np.where(inside, mixed(h, f) | (PLACE + np.uint64(1)), np.uint64(0)), t) for f in range(2))
                at = met(x, y)
                at = at[inside[x[at]]]  # zeros between texts are the minimum of every run that crosses them
                x, y = x[at], y[at]
                key = mixed(h[x] * np.uint64(0x9E3779B97F4A7C15) + h[y] * np.uint64(0xC2B2AE3D27D4EB4F), 2) >> np.uint64(64 - KEY_BITS)
                of = doc[x]
                lo, hi = np.minimum(x, y) - start[of], np.maximum(x, y) - start[of]
                ids = np.array([every[k] for k in new], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[of]), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["key", "cls", "lo", "hi"])

    return in_arrow(docs.select("cls", "text"), run, "key long, cls long, lo int, hi int")


_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_FACTOR = 0x9E3779B97F4A7C15  # odd
_POWERS = [np.cumprod(np.full(1, x, np.uint64)) for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64))]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a lower-case text and where they start: polynomials of the bytes, as differences of one running sum, mixed."""
    x = np.frombuffer(text, np.uint8)
    if len(_POWERS[0]) < len(x) + 1:
        for i, f in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.full(len(x) * 5 // 4 + 1, f, np.uint64))
    inside = np.concatenate([[False], ~_GAP[x], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(x)])])
    return mixed((total[end] - total[start]) * _POWERS[1][start], 3), start


def _joined_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles in one sequence, and the text of each, -1 where a shingle would lie in two texts."""
    own, start = word_hashes(b"\n".join(texts).lower())
    first = np.cumsum([0, *(len(x) + 1 for x in texts)])
    of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, first)))
    h = combined(own, words)
    n = len(h)
    return h, np.where(of[:n] == of[words - 1 : words - 1 + n], of[:n], -1)


def passages(a: bytes, b: bytes, words: int = WORDS, least: int = LEAST_WORDS, similarity: float = SIMILARITY, gap: int = GAP) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start in a, end in a, similarity) in words, ends excluded, of the passages of b that are near-duplicates of passages of a.

    A passage has `least` words or more on both sides, and the sets of its shingles a Jaccard similarity of `similarity` or more.
    """
    t = least - words + 1
    return _aligned(Made(hashes(a, words), t), Made(hashes(b, words), t), words, t, similarity, gap)


class Made:
    """A text's hashes with what comparing it needs."""

    def __init__(self, h: np.ndarray, t: int):
        self.h, self.order = h, np.argsort(h, kind="stable")
        self.sorted = h[self.order]
        same = np.flatnonzero(self.sorted[1:] == self.sorted[:-1])
        self.before = np.full(len(h), -1)  # the place before at which the same hash is
        self.before[self.order[same + 1]] = self.order[same]
        #: Different hashes that each run of t or more holds at least; not more than the true number.
        self.least = t
        if len(same) and len(h) >= t:
            again = np.concatenate([[0], np.cumsum((self.before >= 0) & (np.arange(len(h)) - self.before < t))])
            self.least = t - int((again[t:] - again[:-t]).max())


def _aligned(a: Made, b: Made, words: int, t: int, similarity: float, gap: int = GAP) -> list[tuple[int, int, int, int, float]]:
    """The same from the texts' hashes."""
    # A passage's shared shingles are so many at least, as those of both sides are `least` or more.
    need = max(1, ceil(similarity / (1 + similarity) * (a.least + b.least) - 1e-9))
    if len(a.h) < t or len(b.h) < t:
        return []
    low = np.searchsorted(a.sorted, b.h, "left")
    hit = a.sorted[np.minimum(low, len(a.h) - 1)] == b.h
    places = np.flatnonzero(hit)
    if len(places) < need:
        return []
    where = a.order[np.minimum(low, len(a.h) - 1)]
    if len(a.h) > 1 and (a.before >= 0).any():  # of several places in a the one nearest to where the last would go on
        high = np.searchsorted(a.sorted, b.h[places], "right")
        if (high - low[places]).max() > 1:
            spots, at, last = a.order.tolist(), where.tolist(), None
            for i, x, y in zip(places.tolist(), low[places].tolist(), high.tolist()):
                if last is not None and y - x > 1:
                    want = at[last] + i - last
                    k = bisect_left(spots, want, x, y)
                    at[i] = spots[k] if k < y and (k == x or spots[k] - want <= want - spots[k - 1]) else spots[k - 1]
                last = i
            where = np.array(at)
    out, todo = [], [places]
    while todo:
        p = todo.pop()
        if len(p) < 2:
            if len(p) and t <= 1:
                out.append((int(p[0]), int(p[0]) + words, int(where[p[0]]), int(where[p[0]]) + words, 1.0))
            continue
        w = where[p]
        step = p[1:] - p[:-1]
        breaks = np.flatnonzero((step > gap) | (np.abs(w[1:] - w[:-1] - step) > gap)) + 1 if p[-1] - p[0] + 1 > t or step.max() > gap else ()
        if len(breaks):
            todo += [x for x in np.split(p, breaks) if _enough(x, b, t, similarity, need)]
            continue
        while _enough(p, b, t, similarity, need):
            s, e = int(p[0]), int(p[-1])
            x, y = int(w.min()), int(w.max())
            if min(e - s, y - x) + 1 >= t:
                both = int((b.before[p] < s).sum())
                j = both / (int((b.before[s : e + 1] < s).sum()) + int((a.before[x : y + 1] < x).sum()) - both)
                if j >= similarity - 1e-9:
                    out.append((s, e + words, x, y + words, j))
                    break
            step = p[1:] - p[:-1]
            if not len(step) or step.max() == 1:
                break
            k = int(step.argmax()) + 1  # not similar enough as a whole: try both sides of the longest gap
            todo.append(p[:k])
            p, w = p[k:], w[k:]
    return sorted(out)


def _enough(p: np.ndarray, b: Made, t: int, similarity: float, need: int) -> bool:
    """Whether the shared places p may hold a passage."""
    return len(p) >= need and p[-1] - p[0] + 1 >= t * similarity


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST_WORDS, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """Passages that repeat across documents: doc_id, start, end, other_id, other_start, other_end, similarity.

    Places are in words, ends excluded. Documents of equal text form a class, named by its smallest doc_id. Each row says that
    the passage of doc_id is a near-duplicate of that of other_id; both name their classes, and what any two classes have in common, their
    rows connect. Every other document of a class has one row, for its whole text and the class's, if it has `least` words. Null,
    empty and short texts have no rows. Rows that repeat whole give the same rows once. A null doc_id stays null and names nothing while its
    class has another. Other columns are not read. An empty table gives an empty result.
    """
    near, members, first, pairs, packed = _near(docs, id_col, text_col, words, least, similarity)
    spans = cut(_verified(pairs, packed, words, least, similarity))
    places = cut(_places(_left(near, spans, words), packed, words))
    spans = cut(spans.unionByName(_compared(_can_link(places, words, least, similarity), words, least, similarity, chunk)))
    named = [first.select(F.col("cls").alias(c), F.col("first_id").alias(i)) for c, i in (("cls", "doc_id"), ("low", "other_id"))]
    near_rows = spans.join(named[0], "cls").join(named[1], "low").select("doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity")
    copies = members.join(first.select("cls", "first_id"), "cls").where((F.col("n") >= least) & ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    whole = [F.lit(0).alias("start"), F.col("n").cast("int").alias("end"), F.col("first_id").alias("other_id"), F.lit(0).alias("other_start"), F.col("n").cast("int").alias("other_end"), F.lit(1.0).alias("similarity")]
    return near_rows.unionByName(copies.select("doc_id", *whole))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST_WORDS, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """Pairs (low, cls) of different texts that are near-duplicates as wholes, named by their xxHash64: the sets of all their shingles have a Jaccard
    similarity of `similarity` or more. Texts meet over the runs that passages of `least` words and more share, so shorter texts have no
    pairs; of a family of near-duplicates pairs are given that connect it."""
    near, _, _, pairs, packed = _near(docs, id_col, text_col, words, least, similarity)
    links = cut(_verified(pairs, packed, words, least, similarity, whole=True).where(F.col("similarity") >= similarity - 1e-9).select("low", "cls"))
    left = cut(pairs.join(links.withColumn("settled", F.lit(True)), ["low", "cls"], "left").select(F.col("low").alias("key"), "cls", F.coalesce("settled", F.lit(False)).alias("settled")))
    size = left.groupBy("key").agg(F.count_if(~F.col("settled")).alias("f"), F.count_if("settled").alias("s")).where("f > 0 and f + s > 1")
    rows = _dealt(left.join(small(cut(size)), "key"), chunk).join(packed, "cls").select("key", "unit", "cls", "settled", "own", "z")
    rows = rows.repartition(parts(docs.sparkSession), "key", "unit").sortWithinPartitions("key", "unit", "cls")

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

    return links.unionByName(in_arrow(rows, run, "low long, cls long"))


def _alike(sets: list[np.ndarray], cls: list[int], free: np.ndarray, chunk: np.ndarray, whole: bool, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of texts of similar sets that connect what was not connected before; settled ones are."""
    left, n = np.flatnonzero(free), np.array(list(map(len, sets)))
    if len(sets) < 2 or not len(left):
        return
    both = _shared(sets, left)
    may = both >= similarity * (n[left][:, None] + n[None] - both) - 1e-6
    may &= ~free[None] | (np.arange(len(sets))[None] > left[:, None])
    if not whole and len(np.unique(chunk)) > 1:
        may &= chunk[left][:, None] != chunk[None]
    root = np.arange(len(sets))
    if not free.all():
        root[~free] = np.flatnonzero(~free)[0]
    for a, y in zip(*np.nonzero(may)):
        x = left[a]
        if root[x] != root[y]:
            root[root == root[y]] = root[x]
            yield min(cls[x], cls[y]), max(cls[x], cls[y])


def _shared(sets: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """How many values each set of `left` has in common with each set."""
    of = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = count > 1
    of, col = of[many[col]], (np.cumsum(many) - 1)[col[many[col]]]
    shared, both = int(many.sum()), np.zeros((len(left), len(sets)), np.float32)
    for i in range(0, shared, _COLUMNS):
        here = (col >= i) & (col < i + _COLUMNS)
        x = np.zeros((len(sets), min(_COLUMNS, shared - i)), np.float32)
        x[of[here], col[here] - i] = 1
        both += x[left] @ x.T
    return both


def _near(docs: DataFrame, id_col: str, text_col: str, words: int, least: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows of shared keys, the documents of each class, its first document, the pairs of the stars, and the texts of those in a pair."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    own = own.withColumn("cls", F.xxhash64("text"))
    members = cut(own.groupBy("doc_id", "cls").agg(F.min(F.regexp_count("text", F.lit(WORD))).alias("n")))
    first = cut(members.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n")))
    near = _grouped(own, words, least, similarity)
    pairs = cut(near.where("cls <> low").select("low", "cls").distinct())
    return near, members, first, pairs, cut(_packed(own, pairs, first))


def _grouped(own: DataFrame, words: int, least: int, similarity: float) -> DataFrame:
    """(key, cls, lo, hi, low, n) of keys that more than one class has: the smallest class of the key and the number of rows. Rows are dealt out
    once; they are many, and most of their keys are alone. Keys of very many texts are dealt out by class too, and get their smallest class
    and number from what those parts found."""
    some = own.where(F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(SAMPLE)) == 0)
    least_texts = F.greatest(F.lit(HOT), F.lit(some.count() // 10_000))
    hot = cut(windows(some, words, least, similarity).select("key", "cls").distinct().groupBy("key").agg(F.count("*").alias("texts")).where(F.col("texts") >= least_texts).select("key", F.lit(True).alias("hot")))
    rows = windows(own, words, least, similarity).join(small(hot), "key", "left")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    w = Window.partitionBy("key", "salt")
    rows = rows.withColumns({"low": F.min("cls").over(w), "high": F.max("cls").over(w), "n": F.count("*").over(w)})
    rows = cut(rows.where("low <> high or hot").drop("salt").distinct())
    parts_ = rows.where("hot").select("key", "low", "high", "n").distinct()
    whole = small(cut(parts_.groupBy("key").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.sum("n").alias("all"))))
    rows = rows.join(whole, "key", "left").select("key", "cls", "lo", "hi", F.coalesce("first", "low").alias("low"), F.coalesce("last", "high").alias("high"), F.coalesce("all", "n").alias("n"))
    return rows.where("low <> high").drop("high")


def _packed(own: DataFrame, pairs: DataFrame, first: DataFrame) -> DataFrame:
    """(cls, z): the compressed text of each class in a pair, of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(t.as_buffer().to_pybytes()) for t in b.column(1)], pa.binary())], ["cls", "z"])

    need = pairs.select("cls").unionByName(pairs.select(F.col("low").alias("cls"))).distinct()
    need = small(cut(need.join(first.select("cls", "first_id"), "cls").select(F.col("cls").alias("k"), "first_id")))
    texts = own.join(need, (F.col("cls") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    return in_arrow(texts.select("cls", "text"), run, "cls long, z binary").groupBy("cls").agg(F.first("z").alias("z"))


_SPANS = "low long, cls long, start int, end int, other_start int, other_end int, similarity double"


def _spans(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["low", "cls", "start", "end", "other_start", "other_end", "similarity"])


def _verified(pairs: DataFrame, packed: DataFrame, words: int, least: int, similarity: float, star: int = STAR, whole: bool = False) -> DataFrame:
    """Passages of each pair (low, cls), or its similarity as a whole. A star is dealt out in parts of so many texts, each after the text of the centre."""
    size = pairs.groupBy("low").agg(F.ceil(F.count("*") / star).cast("int").alias("c"))
    body = pairs.join(size, "low").select("low", F.pmod(F.xxhash64("cls", F.lit(9)), F.col("c")).cast("int").alias("part"), "cls")
    head = body.select("low", "part").distinct().join(packed.withColumnRenamed("cls", "low"), "low")
    rows = body.join(packed, "cls").select("low", "part", "cls", "z").unionByName(head.select("low", "part", F.lit(None).cast("long").alias("cls"), "z"))
    rows = rows.repartition(parts(pairs.sparkSession), "low", "part").sortWithinPartitions("low", "part", F.col("cls").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        t = least - words + 1
        centre = Made(np.zeros(0, np.uint64), t)
        for b in batches:
            out = []
            for low, cls, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                h = Made(hashes(z.decompress(text.as_py()), words), t)
                if cls is None:
                    centre = h
                elif whole:
                    a, b = np.unique(centre.h), np.unique(h.h)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    out.append((low, cls, 0, 0, 0, 0, both / max(1, len(a) + len(b) - both)))
                else:
                    out += [(low, cls, *p) for p in _aligned(centre, h, words, t, similarity)]
            if out:
                yield _spans(out)

    return in_arrow(rows, run, _SPANS)


def _left(near: DataFrame, spans: DataFrame, words: int) -> DataFrame:
    """(key, cls, lo, hi, settled) of the groups of three classes or more, all groups of one centre together under its key, as they often hold the same
    texts; the centre is left out. Settled are a group's classes with a place inside a passage that the centre has too. Centres with
    settled ones alone are left out."""
    ends = spans.groupBy("low", "cls").agg(F.collect_set(F.struct("start", "end")).alias("own"))
    inside = F.exists("own", lambda x: (x["start"] <= F.col("lo")) & (F.col("hi") + words <= x["end"]))
    rows = near.where((F.col("n") > 2) & (F.col("cls") != F.col("low"))).join(ends, ["low", "cls"], "left").select("key", "low", "cls", "lo", "hi", F.coalesce(inside, F.lit(False)).alias("settled"))
    rows = rows.groupBy("key", "low", "cls").agg(F.max("settled").alias("settled"), F.collect_set(F.struct("lo", "hi")).alias("places"))
    rows = cut(rows.groupBy("low", "cls", "settled").agg(F.flatten(F.collect_list("places")).alias("places")))  # of one text
    open_ = rows.groupBy("low").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.min("settled").alias("s")).where("a <> b and not s").select("low")
    return rows.join(small(cut(open_)), "low").select(F.col("low").alias("key"), "cls", "settled", F.inline("places"))


def _places(rows: DataFrame, packed: DataFrame, words: int, around: int = AROUND) -> DataFrame:
    """(key, cls, settled, base, ctx): the shingles around the places in each class, as 32-bit hashes, with the place of the first one in the
    text; those of places near each other are one piece."""
    lists = rows.groupBy("cls").agg(F.collect_list(F.struct("key", "lo", "hi", "settled")).alias("x"))  # of one text, and bounded by its length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for cls, x, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                h = (hashes(z.decompress(text.as_py()), words) >> np.uint64(32)).astype(np.uint32)
                found: list[list] = []
                for e in sorted(x.as_py(), key=lambda e: (e["key"], e["settled"], e["lo"], e["hi"])):
                    base, end = max(0, e["lo"] - around), min(len(h), e["hi"] + around + 1)
                    if found and found[-1][:2] == [e["key"], e["settled"]] and base <= found[-1][3]:
                        found[-1][3] = max(end, found[-1][3])
                    else:
                        found.append([e["key"], e["settled"], base, end])
                key, settled, base, end = zip(*found)
                ctx = [h[i:j].tobytes() for i, j in zip(base, end)]
                cols = [(key, pa.int64()), ([cls] * len(found), pa.int64()), (settled, pa.bool_()), (base, pa.int32()), (ctx, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in cols], ["key", "cls", "settled", "base", "ctx"])

    return in_arrow(lists.join(packed, "cls").select("cls", "x", "z"), run, "key long, cls long, settled boolean, base int, ctx binary")


def _can_link(places: DataFrame, words: int, least: int, similarity: float, large: int = LARGE) -> DataFrame:
    """Of groups of more than `large` pieces only those of texts of which enough shingles are in another text of the group too, with the group's
    numbers f and s of pieces that are not settled and settled. It spares comparisons, and is of no effect on what they find."""
    t = least - words + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column(2)]
            sets = [np.unique(x) for x in h]
            need = [ceil(similarity * Made(x, t).least - 1e-9) for x in h]
            i = pa.array(np.repeat(np.arange(len(sets)), list(map(len, sets))))
            yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(1).take(i), pa.array(np.concatenate(sets).view(np.int32)), pa.array(need, pa.int32()).take(i)], ["key", "cls", "sh", "need"])

    size = cut(places.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large).select("key"))
    mine = places.join(small(size), "key")
    sh = in_arrow(mine.select("key", "cls", "ctx"), run, "key long, cls long, sh int, need int")
    # Shingles that one text of a group has alone; the others of it may be shared.
    alone = sh.groupBy("key", "sh").agg(F.min("cls").alias("cls"), F.max("cls").alias("high"), F.min("need").alias("need")).where("cls = high")
    alone = alone.groupBy("key", "cls").agg(F.count("*").alias("alone"), F.min("need").alias("need"))
    every = mine.groupBy("key", "cls").agg(F.sum(F.octet_length("ctx") / 4).alias("all"))
    none = cut(every.join(alone, ["key", "cls"]).where(F.col("all") - F.col("alone") < F.col("need")).select("key", "cls"))
    kept = places.join(small(none), ["key", "cls"], "left_anti")
    size = kept.groupBy("key").agg(F.count_if(~F.col("settled")).alias("f"), F.count_if("settled").alias("s")).where("f > 0 and f + s > 1")
    return kept.join(small(cut(size)), "key")


def _dealt(places: DataFrame, chunk: int) -> DataFrame:
    """places (key, cls, settled, f, s) with own, their chunk, and once for each unit that they are compared in: a pair of chunks of which one at least is
    not settled, or -1 for a group of two chunks at most."""
    cf, cs = F.ceil(F.col("f") / chunk).cast("int"), F.ceil(F.col("s") / chunk).cast("int")
    side = F.xxhash64("cls", F.lit(7))
    mine = F.when(F.col("settled"), F.col("cf") + F.pmod(side, F.col("cs"))).otherwise(F.pmod(side, F.col("cf"))).cast("int")
    all_of = F.col("cf") + F.col("cs")
    with_free = F.transform(F.sequence(F.lit(0), F.col("cf") - 1), lambda j: F.least(j, F.col("own")) * all_of + F.greatest(j, F.col("own")))
    with_settled = F.when(F.col("settled") | (F.col("cs") == 0), F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("cs") - 1), lambda j: F.col("own") * all_of + F.col("cf") + j))
    units = F.when(F.col("cf") + F.col("cs") <= 2, F.array(F.lit(-1))).otherwise(F.concat(with_free, with_settled))
    rows = places.withColumns({"cf": cf, "cs": cs}).withColumn("own", mine).withColumn("unit", F.explode(units))
    return rows


def _compared(places: DataFrame, words: int, least: int, similarity: float, chunk: int) -> DataFrame:
    """Passages around their places that two classes of a group have in common, as far as they are not connected otherwise. Those that are
    not settled are compared with all: chunks of them with each other and with the chunks of settled ones. Of a pair's passages that
    begin near each other the longest is given."""
    rows = _dealt(places, chunk)
    key = ["key", "unit"]
    rows = rows.select(*key, "cls", "settled", "own", "base", "ctx").repartition(parts(places.sparkSession), *key).sortWithinPartitions(*key, "cls", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, key):
            k = np.stack([t.column(x).to_numpy() for x in key])
            at = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1), len(t)]
            columns = [t.column(x).to_pylist() for x in ("cls", "settled", "own", "base")]
            ctx = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) for x in t.column("ctx")]
            out = []
            for i, j in zip(at, at[1:]):
                out += _linked(ctx[i:j], *(c[i:j] for c in columns), whole=bool(k[1, i] < 0), words=words, least=least, similarity=similarity)
            if out:
                yield _spans(out)

    found = in_arrow(rows, run, _SPANS)
    best = F.max_by(F.struct("start", "end", "other_start", "other_end", "similarity"), F.struct(F.col("end") - F.col("start"), -F.col("start")))
    return found.groupBy("low", "cls", F.floor(F.col("start") / 64)).agg(best.alias("x")).select("low", "cls", "x.*")


def _linked(ctx: list[np.ndarray], cls: list[int], settled: list[bool], own: list[int], base: list[int], whole: bool, words: int, least: int, similarity: float) -> Iterator[tuple]:
    """(low, cls, passage) that connect pieces that were not connected before; settled ones are. `whole`: all pairs are compared but settled ones;
    otherwise the pairs of two chunks, or those within one."""
    n, t = len(ctx), least - words + 1
    free, chunk, ids = ~np.array(settled), np.array(own), np.array(cls)
    if n < 2 or not free.any():
        return
    made = [Made(x, t) for x in ctx]
    sets = [x.sorted[np.concatenate([[True], x.sorted[1:] != x.sorted[:-1]])] for x in made]
    left = np.flatnonzero(free)
    both = _shared(sets, left)
    need = np.array([x.least for x in made])
    may = (both >= (need[left][:, None] + need[None]) * similarity / (1 + similarity) - 1e-4) & (ids[left][:, None] != ids[None])
    may &= ~free[None] | (np.arange(n)[None] > left[:, None])  # each pair once, from its first piece that is not settled
    if not whole and len(set(own)) > 1:
        may &= chunk[left][:, None] != chunk[None]
    root = np.arange(n)
    if not free.all():
        root[~free] = np.flatnonzero(~free)[0]
    uniq = np.unique(np.concatenate(sets))
    held = np.zeros((n, len(uniq)), bool) if n * len(uniq) <= _CELLS else None
    if held is not None:
        for i, x in enumerate(sets):
            held[i, np.searchsorted(uniq, x)] = True
    plain = need == t
    for a, x in enumerate(left.tolist()):
        ys = np.flatnonzero(may[a] & (root != root[x]))
        if not len(ys):
            continue
        if held is not None and plain[x]:
            hit = held[np.ix_(ys, np.searchsorted(uniq, made[x].h))]
            ys = ys[_dense(hit, t, words, similarity) | ~plain[ys]]
        for y in ys[np.argsort(-both[a, ys], kind="stable")].tolist():
            if root[x] == root[y]:
                continue
            p, q = (x, y) if cls[x] < cls[y] else (y, x)
            found = _aligned(made[p], made[q], words, t, similarity)
            if found:
                root[root == root[y]] = root[x]
                yield from ((cls[p], cls[q], base[q] + s, base[q] + e, base[p] + so, base[p] + eo, j) for s, e, so, eo, j in found)


def _dense(hit: np.ndarray, t: int, words: int, similarity: float) -> np.ndarray:
    """For each row of hit (places of a text that are shared) whether a passage may be in it: t places or more of which the shared ones make up for the
    others, and for words - 1 more on the other side at each gap, as the similarity asks."""
    if hit.shape[1] < t:
        return np.zeros(len(hit), bool)
    gap = ~hit
    gap[:, 1:] &= hit[:, :-1]
    gain = np.where(hit, (1 - similarity) / similarity, -1.0) - (words - 1) * gap
    total = np.concatenate([np.zeros((len(hit), 1)), np.cumsum(gain, 1)], 1)
    return (total[:, t:] >= np.minimum.accumulate(total, 1)[:, :-t] - 1e-9).any(1)


#: Cells of a table of texts by shingles, one byte each.
_CELLS = 64 << 20
#: Shared shingles counted at once.
_COLUMNS = 4096
