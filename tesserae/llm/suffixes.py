"""Exact repeats of long byte strings by suffix arrays of shards.

All starts of `width` bytes fall into segments: neighbouring starts that hold the same least gram (of GRAM bytes, by a hash) near. Equal
strings have the same least gram at the same place, so a segment's strings can only repeat in segments of the same gram, its key. Segments
of keys that are there once hold no repeats; equal segments are counted and kept once. The rest are dealt out by key, and each task
sorts the suffixes of its shard and reads off which strings start twice (`repeats`).

The sort is induced. Suffixes that are smaller than the next and follow a larger one (seeds) are named by their text up to the next seed,
and the shorter text of the names is sorted in turn. From the sorted seeds all other suffixes follow by two sweeps over the
first bytes: what a sweep has reached goes, with the length of the prefix it has in common with the one before, to the queue of the byte before
it, and comes out of that queue in order. Queues go to disk beyond a bound. Prefixes are compared to `width` bytes, no farther.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, in_arrow, parts, pieces, small
from tesserae.llm.substring import compact_windows, mixed

WIDTH, GRAM = 200, 32
#: Bytes of a shard, and of its queues in memory.
SHARD, MEMORY = 3 << 20, 32 << 20
#: Segments of a key from which on its strings are counted one by one.
HOT = 1 << 16
#: Suffixes that a sweep works on at once.
BLOCK = 1 << 16

_FACTOR = 0xD6E8FEB86659FD93  # odd
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


# --- sorting a shard ---------------------------------------------------------------------------------------------------------------------


class Queues:
    """First-in first-out queues of (place, common prefix), one for each first byte. Together they hold so many bytes in memory; then all go to one file,
    which the task deletes. What has been taken stays readable, as the second sweep goes back over the first one's queues."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file, self.spilled = memory, 0, None, 0
        self.blocks: list[list] = [[] for _ in range(256)]

    def put(self, byte: int, place: np.ndarray, common: np.ndarray) -> None:
        self.blocks[byte].append((place, common))
        self.held += place.nbytes + common.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="queue-")
        self.file.seek(0, 2)
        for q in self.blocks:
            kept = [i for i, b in enumerate(q) if isinstance(b[0], np.ndarray)]
            if kept:  # blocks in memory are the last ones
                place, common = (np.concatenate([q[i][k] for i in kept]) for k in range(2))
                q[kept[0] :] = [(self.file.tell(), len(place))]
                self.file.write(place.tobytes() + common.tobytes())
                self.spilled += place.nbytes + common.nbytes
        self.held = 0

    def _read(self, b: tuple, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(b[0], np.ndarray):
            return b[0][i:j], b[1][i:j]
        at, n = b
        self.file.seek(at + 4 * i)
        place = np.frombuffer(self.file.read(4 * (j - i)), np.int32)
        self.file.seek(at + 4 * n + i)
        return place, np.frombuffer(self.file.read(j - i), np.uint8)

    def size(self, byte: int) -> int:
        return sum(len(b[0]) if isinstance(b[0], np.ndarray) else b[1] for b in self.blocks[byte])

    def take(self, byte: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries first to last, the last one excluded."""
        out, at = [], 0
        for b in self.blocks[byte]:
            n = len(b[0]) if isinstance(b[0], np.ndarray) else b[1]
            if at < last and first < at + n:
                out.append(self._read(b, max(0, first - at), min(n, last - at)))
            at += n
        return (out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out))) if out else (np.zeros(0, np.int32), np.zeros(0, np.uint8))

    def close(self) -> None:
        if self.file:
            self.file.close()


def _rises(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one. The last one, of the end sign, counts as such."""
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    at = np.flatnonzero(step)
    return np.append(np.repeat(step[at] > 0, np.diff(at, prepend=-1)), True)  # the end sign is there once, so the last step is not 0


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number; text has eight more bytes than any place needs."""
    w = np.zeros(len(at), np.uint64)
    for i in range(8):
        w = w << np.uint64(8) | text[at + i]
    return w


def _refined(rank: np.ndarray, active: np.ndarray, by: np.ndarray) -> None:
    """Ranks are numbers of smaller ones. Splits those of `active`, which hold all of their equals, by the second key."""
    order = active[np.lexsort((by, rank[active]))] if len(active) else active
    if not len(order):
        return
    second = np.empty(len(rank), by.dtype)
    second[active] = by
    r, s = rank[order], second[order]
    group = np.concatenate([[True], r[1:] != r[:-1]])
    new = group | np.concatenate([[True], s[1:] != s[:-1]])
    n = np.arange(len(order))
    first = np.maximum.accumulate(np.where(group, n, 0))
    rank[order] = r + np.maximum.accumulate(np.where(new, n, 0)) - first


def _tied(rank: np.ndarray) -> np.ndarray:
    """Places of ranks that are there more than once."""
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _sorted_seeds(text: np.ndarray, seeds: np.ndarray, width: int) -> np.ndarray:
    """Seeds in the order of their suffixes, as far as `width` bytes tell."""
    length = np.append(np.diff(seeds) + 1, 1)
    rank = np.zeros(len(seeds), np.int64)
    active, done = np.arange(len(seeds)), 0
    while len(active):  # names: the text of each seed up to the next one; of two that agree so far the longer is the smaller
        left = length[active] - done
        w = _word(text, np.minimum(seeds[active] + done, len(text) - 8))
        short = np.clip(8 - left, 0, 8).astype(np.uint64)
        w = np.where(short >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), w | (np.uint64(1) << np.minimum(short, np.uint64(7)) * np.uint64(8)) - np.uint64(1))
        _refined(rank, active, w)
        done += 8
        open_ = np.zeros(len(seeds), bool)
        open_[rank[active[length[active] > done]]] = True
        active = active[open_[rank[active]]]
        active = active[np.bincount(rank[active], minlength=len(seeds))[rank[active]] > 1] if len(active) else active
    h = 1
    while 2 * h <= width and len(active := _tied(rank)):  # the text of names, two and two, four and four; a seed is two bytes at least after the last
        after = np.full(len(active), -1)
        inside = active + h < len(seeds)
        after[inside] = rank[active[inside] + h]
        _refined(rank, active, after)
        h *= 2
    return np.argsort(rank, kind="stable")


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """How many bytes the suffixes of each two places have in common, up to `width`."""
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    last = len(text) - 8
    for done in range(0, width, 8):
        x = _word(text, np.minimum(a[left] + done, last)) ^ _word(text, np.minimum(b[left] + done, last))
        same = x == 0
        part = np.zeros(len(left), np.int64)
        for i in range(1, 8):
            part += x < np.uint64(1 << 8 * (8 - i))
        out[left] += np.where(same, 8, np.minimum(part, 7))
        left = left[same]
    return np.minimum(out, width)


class _Sweep:
    """Hands what is reached on to the queues, with prefixes. since: the least common prefix since the last one handed to each queue."""

    def __init__(self, queues: Queues, width: int):
        self.queues, self.width = queues, width
        self.since, self.any = np.full(256, 255, np.int64), np.zeros(256, bool)

    def hand_on(self, place: np.ndarray, common: np.ndarray, to: np.ndarray, goes: np.ndarray) -> None:
        """place: suffixes in the sweep's order; common: with the one before; to: the byte before each; goes: whether that one is of this sweep."""
        n = len(place)
        if not n:
            return
        levels = [common]
        while (step := 1 << len(levels) - 1) * 2 <= n:
            x = levels[-1].copy()
            x[:-step] = np.minimum(x[:-step], x[step:])
            levels.append(x)
        table = np.stack(levels)

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """The least of common[a..b]."""
            k = np.frexp(b - a + 1)[1] - 1
            return np.minimum(table[k, a], table[k, b - (1 << k) + 1]).astype(np.int64)

        at = np.flatnonzero(goes)
        at = at[np.argsort(to[at], kind="stable")]
        b = to[at].astype(np.int64)
        first = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        if len(at):
            low = least(np.where(first, 0, np.concatenate([[0], at[:-1] + 1])), at)
            low[start] = np.minimum(low[start], self.since[b[start]])
            low = np.minimum(low + 1, self.width)
            low[start[~self.any[b[start]]]] = 0
        stop = np.append(start[1:], len(at))
        rest = np.full(256, -1)
        if len(start):
            rest[b[start]] = at[stop - 1]
        unseen = rest < 0
        self.since[unseen] = np.minimum(self.since[unseen], int(common.min()))
        seen = np.flatnonzero(~unseen)
        tail = seen[rest[seen] + 1 < n]
        self.since[seen] = 255
        if len(tail):
            self.since[tail] = least(rest[tail] + 1, np.full(len(tail), n - 1))
        self.any[seen] = True
        for i, j in zip(start.tolist(), stop.tolist()):
            self.queues.put(int(b[i]), (place[at[i:j]] - 1).astype(np.int32), low[i:j].astype(np.uint8))


def suffixes(text: np.ndarray, width: int = WIDTH, memory: int = MEMORY, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of text in falling order, in blocks: place, and bytes in common with the one before in that order, up to `width` (254 at most).

    text ends with a zero, its only one. Suffixes that agree in `width` bytes may come in any order.
    """
    rises = _rises(text)
    before = np.concatenate([text[:1], text[:-1]])
    seeds = np.flatnonzero(rises & np.concatenate([[False], ~rises[:-1]]))
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    order = seeds[_sorted_seeds(padded, seeds, width)]
    shared = np.concatenate([[0], common_prefix(padded, order[:-1], order[1:], width)]).astype(np.uint8)
    head = np.searchsorted(text[order], np.arange(257))
    shared[head[:-1][head[:-1] < len(order)]] = 0
    falling = Queues(memory // 2)
    sweep = _Sweep(falling, width)
    for c in range(256):
        done = 0
        while done < (size := falling.size(c)):  # it grows where a byte repeats
            place, common = falling.take(c, done, min(size, done + block))
            sweep.hand_on(place, common, before[place], (place > 0) & (before[place] >= c))
            done += len(place)
        for i in range(head[c], head[c + 1], block):
            place, common = order[i : min(i + block, head[c + 1])], shared[i : min(i + block, head[c + 1])].copy()
            if i == head[c] and done:
                common[0] = common_prefix(padded, falling.take(c, done - 1, done)[0].astype(np.int64), place[:1], width)[0]
            sweep.hand_on(place, common, before[place], place > 0)
    rising = Queues(memory // 2)
    sweep = _Sweep(rising, width)
    for c in range(255, -1, -1):
        done, last = 0, None
        while done < (size := rising.size(c)):
            place, common = rising.take(c, done, min(size, done + block))
            sweep.hand_on(place, common, before[place], (place > 0) & (before[place] <= c))
            yield place, common
            done += len(place)
            last = place[-1:]
        size = falling.size(c)
        for j in range(size, 0, -block):
            place, common = falling.take(c, max(0, j - block), min(j + 1, size))
            n = j - max(0, j - block)
            # Going down, an entry has with the one before it what that one has with it going up.
            edge = common[n] if j < size else common_prefix(padded, place[n - 1 : n].astype(np.int64), last.astype(np.int64), width)[0] if last is not None else 0
            place, common = place[:n][::-1], np.concatenate([[edge], common[1:n][::-1]]).astype(np.uint8)
            sweep.hand_on(place, common, before[place], (place > 0) & (before[place] < c))
            yield place, common
    falling.close(), rising.close()


def repeats(strings: list[bytes], width: int = WIDTH, memory: int = MEMORY) -> list[np.ndarray]:
    """For each string, whether the `width` bytes from each start on also start anywhere else in the strings."""
    # Bytes of UTF-8 are below 0xF8, so two more signs fit: 1 ends a string, 0 all of them.
    x = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(2)
    text = np.append(x, np.uint8(0))
    twice = np.zeros(len(text), bool)
    last = -1
    for place, common in suffixes(text, width, memory):
        same = np.flatnonzero(common >= width)
        twice[place[same]] = True
        twice[place[same[same > 0] - 1]] = True
        if len(same) and same[0] == 0:
            twice[last] = True
        last = int(place[-1]) if len(place) else last
    first = np.cumsum([0, *(len(s) + 1 for s in strings)])
    return [twice[i : i + max(0, len(s) - width + 1)] for i, s in zip(first.tolist(), strings)]


# --- dealing out -------------------------------------------------------------------------------------------------------------------------


def _grams(x: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on: polynomials as differences of one running sum, mixed."""
    if len(_POWERS[0]) < len(x) + 1:
        for i, f in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(x) * 5 // 4 + 1, f, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(x)])])
    return mixed((total[gram:] - total[:-gram]) * _POWERS[1][: len(x) - gram + 1], 5)


def _segments(texts: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """key, content, text, start, starts of each segment of the texts."""
    whole = b"".join(texts)
    end = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    n = len(whole) - width + 1
    h = _grams(np.frombuffer(whole, np.uint8), gram)
    low = np.where(np.arange(n) + width <= end[:n], compact_windows(h, width - gram + 1), -1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.append(first, n))
    first, size = first[low[first] >= 0], size[low[first] >= 0]
    of = np.searchsorted(np.cumsum([len(t) for t in texts]), first, "right")
    view = memoryview(whole)
    content = np.fromiter((xxhash.xxh64_intdigest(view[i:j]) for i, j in zip(first.tolist(), (first + size + width - 1).tolist())), np.uint64, len(first))
    return h[low[first]].view(np.int64), content.view(np.int64), of, first - np.cumsum([0, *map(len, texts)])[of], size


def segments(own: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(key, content, cls, start, n) of the texts (cls, text): n starts from `start` on. A text that a task has met before is not made again while remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            every = b.column(0).to_pylist()
            for i, j in pieces(b.column(1), 2 << 20):
                if len(seen) > 1 << 20:
                    seen.clear()
                new = [k for k in range(i, j) if every[k] not in seen and not seen.add(every[k])]
                texts = [b.column(1)[k].as_buffer().to_pybytes() for k in new]
                if new:
                    key, content, of, start, n = _segments(texts, width, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), pa.array(np.array([every[k] for k in new], np.int64)[of]), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["key", "content", "cls", "start", "n"])

    return in_arrow(own.where(F.octet_length("text") >= width).select("cls", "text"), run, "key long, content long, cls long, start int, n int")


def _differ(*columns: str) -> list:
    return [f(c).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("max", F.max))]


def _other(*columns: str):
    out = F.lit(False)
    for c in columns:
        out = out | (F.col(f"min_{c}") != F.col(f"max_{c}"))
    return out


def _packed(own: DataFrame, first: DataFrame, need: DataFrame) -> DataFrame:
    """(cls, z): the compressed text of each class of `need`, of one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(t.as_buffer().to_pybytes()) for t in b.column(1)], pa.binary())], ["cls", "z"])

    one = small(cut(need.join(first, "cls").select(F.col("cls").alias("k"), "first_id")))
    texts = own.join(one, (F.col("cls") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    return cut(in_arrow(texts.select("cls", "text"), run, "cls long, z binary").groupBy("cls").agg(F.first("z").alias("z")))


def _strings(contents: DataFrame, packed: DataFrame, width: int) -> DataFrame:
    """(key, content, twice, bytes) of segments (key, content, cls, start, n, twice); those of a text are cut out together."""
    lists = contents.groupBy("cls").agg(F.collect_list(F.struct("key", "content", "start", "n", "twice")).alias("x"))  # of one text, and bounded by its length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for x, packed_text in zip(b.column(0), b.column(1)):
                text, v = z.decompress(packed_text.as_py()), x.values
                cuts = [text[s : s + n + width - 1] for s, n in zip(v.field("start").to_pylist(), v.field("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([v.field("key"), v.field("content"), v.field("twice"), pa.array(cuts, pa.binary())], ["key", "content", "twice", "bytes"])

    return in_arrow(lists.join(packed, "cls").select("x", "z"), run, "key long, content long, twice boolean, bytes binary")


def _sorted_shards(strings: DataFrame, shards: int, width: int, memory: int) -> DataFrame:
    """(key, content, lo, hi): runs of starts, both included, of strings that start twice; a task is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, content, known, texts = [], [], [], []
        for b in batches:
            for c, to in zip(b.columns, (key, content, known, texts)):
                to += c.to_pylist()
        if not texts:
            return
        out = []
        for k, c, sure, x in zip(key, content, known, repeats(texts, width, memory)):
            if not sure:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], x.view(np.int8), [0]])))
                out += [(k, c, lo, hi - 1) for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["key", "content", "lo", "hi"])

    return in_arrow(strings.repartition(shards, "key"), run, "key long, content long, lo int, hi int")


def _counted(strings: DataFrame, width: int) -> DataFrame:
    """The same for keys of very many different segments: each string of `width` bytes is a row, and those of two segments start twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x.as_buffer()) - width + 1 for x in b.column(3)]
            h = (xxhash.xxh64_intdigest(m[i : i + width]) for x, k in zip(b.column(3), n) for m in [memoryview(x.as_buffer())] for i in range(k))
            of = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(np.fromiter(h, np.uint64, sum(n)).view(np.int64)), pa.array(np.concatenate([np.arange(k) for k in n]), pa.int32())], ["key", "content", "string", "lo"])

    rows = cut(in_arrow(strings, run, "key long, content long, string long, lo int"))
    many = rows.groupBy("key", "string").agg(*_differ("content")).where(_other("content")).select("key", "string")
    return rows.join(many, ["key", "string"]).select("key", "content", "lo", F.col("lo").alias("hi"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, shard: int = SHARD, memory: int = MEMORY, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Of a text's UTF-8 bytes those are removed that lie in a string of `width` bytes which also starts anywhere else, in this document or in
    another; spans are the maximal runs (start, end) of them, ends excluded. Matches never cross documents. Null counts as empty. Rows of equal
    texts, with the same or a null doc_id too, are documents each, so texts of `width` bytes and more that are there twice go whole. Other
    columns are not read. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("cls", F.xxhash64("text"))
    rows = own.select("doc_id", "cls", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha"))
    classes = cut(rows.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    every = segments(own, width, gram)
    keys = cut(every.groupBy("key").agg(*_differ("cls", "start", "content")).where(_other("cls", "start")).select("key", _other("content").alias("differ")))
    near = cut(every.join(small(keys), "key").distinct())
    contents = near.groupBy("key", "content").agg(*_differ("cls", "start"), F.max("differ").alias("differ"), F.first("cls").alias("cls"), F.first("start").alias("start"), F.max("n").alias("n"))
    contents = cut(contents.select("key", "content", "cls", "start", "n", "differ", _other("cls", "start").alias("twice")))
    packed = _packed(own, classes.select("cls", "first_id"), near.select("cls").distinct())

    open_ = contents.where("differ")  # segments of a key of which all are equal need no sorting
    crowd = cut(open_.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.col("n") + width).alias("bytes")))
    sizes = crowd.agg(F.sum(F.when(F.col("m") <= hot, F.col("bytes"))), F.max("m")).first()
    many = small(crowd.where(F.col("m") > hot).select("key"))
    shards = max(parts(docs.sparkSession), -(-(sizes[0] or 0) // shard))
    runs = contents.where("twice").select("key", "content", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))
    runs = runs.unionByName(_sorted_shards(_strings(open_.join(many, "key", "left_anti"), packed, width), shards, width, memory))
    if (sizes[1] or 0) > hot:
        runs = runs.unionByName(_counted(_strings(open_.join(many, "key", "left_semi"), packed, width), width))
    found = near.join(runs, ["key", "content"]).select("cls", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + width).alias("hi"))
    lists = found.groupBy("cls").agg(F.collect_list(F.struct("lo", "hi")).alias("x"))  # of one text, and bounded by its length
    cleaned = cut(_cleaned(lists.join(packed, "cls")))
    out = rows.join(cleaned, "cls", "left").join(classes.where("copies > 1").select("cls", F.lit(True).alias("copied")), "cls", "left")
    whole = F.col("copied").isNotNull() & (F.col("size") >= width)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    spans = F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("size").cast("int").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    return out.select("doc_id", F.col("size").alias("n_bytes"), F.when(whole, F.col("size")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"), F.size(spans).cast("long").alias("n_spans"), F.when(whole, nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"), spans.alias("spans"))


def _cleaned(rows: DataFrame) -> DataFrame:
    """(cls, removed, kept, spans) from the texts (cls, x, z) and their runs x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for cls, x, packed_text in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                text, v = z.decompress(packed_text.as_py()), x.values
                spans: list[list[int]] = []
                for lo, hi in sorted(zip(v.field("lo").to_pylist(), v.field("hi").to_pylist())):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                kept, at = hashlib.sha256(), 0
                for lo, hi in [*spans, [len(text), len(text)]]:
                    kept.update(text[at:lo])
                    at = hi
                out.append((cls, sum(hi - lo for lo, hi in spans), kept.hexdigest(), [{"start": lo, "end": hi} for lo, hi in spans]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["cls", "removed", "kept", "spans"])

    return in_arrow(rows.select("cls", "x", "z"), run, "cls long, removed long, kept string, spans array<struct<start:int,end:int>>")
