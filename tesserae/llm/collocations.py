"""Phrase collocations by hierarchical pair naming.

Texts are read in chunks; a chunk is a sequence of codes into its own list of different words. The lists are joined to the counted words of
the whole corpus, which gives each frequent word its global id. Then, length by length, adjacent places with frequent ids become pairs;
a chunk's different pairs are counted over all chunks, and pairs that are frequent get ids of their own, which take the places of their first
parts. A pair of the ids of w1..wk-1 and w2..wk is the phrase w1..wk, so a phrase's pair points to its longest beginning and its longest
end: counts of all beginnings and ends come down these pointers, and a phrase lies in a longer one if it is one of its parents.

Only lists of different words and pairs are shuffled, not places. A chunk's list of pairs is cut into buckets by the pairs' hashes, each a packed
row; a bucket's task counts the pairs of all lists, names the frequent ones and answers each list. A chunk's sequence stays in the shared
folder from one length to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import cut, in_arrow, parts, pieces, small
from tesserae.llm.simhash import _runs

LONGEST, LEAST, TOP, UNIT, COVERED = 3, 10, 2000, 1_000_000, 50
#: Bytes of text in a chunk, one text at least.
CHUNK = 4 << 20
#: Words of the corpus for which there is one more bucket of pairs.
BUCKET = 1 << 21
#: Parts of a language's phrases that are ranked first each on its own.
SALTS = 16

#: What a byte is: 0 a part of a word, 1 white space between words of a piece, 2 the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_WORDS = "chunk long, langs array<string>, of binary, words binary, n binary, seq binary"
_LISTED = "chunk long, code int, lang string, word string, n long"
_PACKED = "chunk long, bucket long, pairs binary, seq binary"
_ANSWERS = "chunk long, told binary, named binary"
_NAMED = "id long, left long, right long, f long"


def _coded(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A code for each key from 0 on, the key of each code, and how often it is there."""
    d = pa.array(key).dictionary_encode()
    code = d.indices.to_numpy()
    return code, d.dictionary.to_numpy(), np.bincount(code, minlength=len(d.dictionary))


def _packed(x: np.ndarray) -> bytes:
    """Compressed, first bytes of all numbers first."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, lower-case, the text of each, and whether the word before it is in the same piece."""
    x = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = _KIND[x]
    inside = np.concatenate([[False], kind == 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(_LOWER[x[kind == 0]]))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    breaks = np.cumsum(kind == 2)[start]
    return words, np.searchsorted(first, start, "right") - 1, np.concatenate([[False], breaks[1:] == breaks[:-1]]) if len(start) else np.zeros(0, bool)


def _unpacked(z: pa.Scalar, kind: type) -> np.ndarray:
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(z.as_buffer()), np.uint8)
    return np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _words(docs: DataFrame, most: int) -> DataFrame:
    """Chunks, numbered by how many words the task had before, so that a chunk's number plus a code is nothing else's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, columns = TaskContext.get().partitionId() << 33, ["chunk", "langs", "of", "words", "n", "seq"]
        for b in batches:
            every = b.column(0).dictionary_encode()
            for i, j in pieces(b.column(1), most):
                texts = [t.as_buffer().to_pybytes() for t in b.column(1)[i:j]]
                words, doc, on = words_of(texts)
                if not len(words):
                    continue
                d = words.dictionary_encode()
                size = len(d.dictionary)
                code, key, n = _coded(every.indices[i:j].to_numpy()[doc].astype(np.int64) * size + d.indices.to_numpy())
                seq = np.insert(code, np.flatnonzero(~on), -1).astype(np.int32)
                held = d.dictionary.take(pa.array(key % size)).to_pylist()  # no word holds a line's end
                z = zstandard.ZstdCompressor(level=1).compress("\n".join(held).encode())
                told = [_packed((key // size).astype(np.int32)), z, _packed(n.astype(np.int64)), _packed(seq)]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([every.dictionary.to_pylist()], pa.list_(pa.string())), *(pa.array([x], pa.binary()) for x in told)], columns)
                name += len(words)

    own = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text")).where("text is not null")
    return cut(in_arrow(own, run, _WORDS))


def _listed_words(packed: DataFrame) -> DataFrame:
    """(chunk, code, lang, word, n) of all chunks' lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, langs, of, words, n in zip(*(b.column(i) for i in range(5))):
                own = zstandard.ZstdDecompressor().decompress(words.as_buffer()).decode().split("\n")
                of, n = _unpacked(of, np.int32), _unpacked(n, np.int64)
                for i in range(0, len(n), 1 << 16):
                    j = min(i + (1 << 16), len(n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, chunk.as_py())), pa.array(np.arange(i, j), pa.int32()), langs.values.take(pa.array(of[i:j])), pa.array(own[i:j], pa.string()), pa.array(n[i:j])], ["chunk", "code", "lang", "word", "n"])

    return in_arrow(packed.select("chunk", "langs", "of", "words", "n"), run, _LISTED)


def _bucket(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    h = left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _paired(ids: DataFrame, seqs: DataFrame, buckets: int) -> DataFrame:
    """The pairs of adjacent places of each chunk that have frequent ids: one row per chunk with its sequence of codes into the sorted list of its pairs,
    and one per bucket of the list, packed. ids are rows (chunk, code, id) or (chunk, told), many of them packed."""
    both = ids.unionByName(seqs.select("chunk", "seq"), allowMissingColumns=True)
    both = both.repartition(parts(ids.sparkSession), "chunk").sortWithinPartitions("chunk")
    valid = lambda x: x.filter(pa.compute.is_valid(x))

    def lists(g: pa.Table, chunk: int) -> Iterator[tuple]:
        if "told" in g.column_names:
            told = [_unpacked(z, np.int64).reshape(2, -1) for z in valid(g.column("told"))]
            code, ident = np.concatenate(told, axis=1) if told else np.zeros((2, 0), np.int64)
        else:
            code, ident = valid(g.column("code")).to_numpy(), valid(g.column("id")).to_numpy()
        if not len(code):
            return
        order = np.argsort(ident)
        code, ident = code[order], ident[order]
        seq = _unpacked(valid(g.column("seq"))[0], np.int32)
        place = np.full(max(int(seq.max()), int(code.max())) + 2, -1)  # the last one is what -1 reads
        place[code] = np.arange(len(code))
        own = place[seq]
        pair = np.flatnonzero((own[:-1] >= 0) & (own[1:] >= 0))
        if not len(pair):
            return
        c, key, n = _coded(own[pair].astype(np.int64) * len(code) + own[pair + 1])
        order = np.argsort(key)
        key, n = key[order], n[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        new = np.full(len(seq) - 1, -1, np.int32)
        new[pair] = rank[c]
        yield chunk, None, None, _packed(new)
        left, right = ident[key // len(code)], ident[key % len(code)]
        bucket = _bucket(left, right, buckets)
        by = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        for i, j in zip(at, [*at[1:], len(by)]):
            k = by[i:j]
            yield chunk, int(bucket[k[0]]), _packed(np.concatenate([np.diff(left[k], prepend=0), right[k], n[k], np.diff(k, prepend=0)])), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["chunk"]):
            name = t.column("chunk").to_numpy()
            at = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1), len(t)]
            for i, j in zip(at, at[1:]):
                rows = list(lists(t.slice(i, j - i), int(name[i])))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["chunk", "bucket", "pairs", "seq"])

    return in_arrow(both, run, _PACKED)


def _summed(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["left", "right"], use_threads=False).aggregate([("n", "sum")])
    return t.select(["left", "right", "n_sum"]).rename_columns(["left", "right", "n"])


def _answers(packed: DataFrame, least: int, told: bool) -> DataFrame:
    """Of each bucket the pairs that are there `least` times over all lists, with ids (named), and for each list the codes of these and their ids (told).

    A task holds a bucket's lists as they are packed and its different pairs, not all their places at once; a pair is in a list once at most.
    """

    def pairs(z: pa.Scalar) -> list[np.ndarray]:
        left, right, n, code = _unpacked(z, np.int64).reshape(4, -1)
        return [np.cumsum(left), right, n, np.cumsum(code)]

    def answered(bucket: int, chunks: np.ndarray, lists: pa.ChunkedArray) -> Iterator[tuple]:
        held, size, most = [], 0, 1 << 20
        for z in lists:
            held.append(pa.table(dict(zip(("left", "right", "n"), pairs(z)))))
            size += len(held[-1])
            if size > most:
                held = [_summed(held)]
                size, most = 0, max(most, len(held[0]))
        f = _summed(held)
        f = f.filter(pa.compute.greater_equal(f.column("n"), least)).sort_by([("left", "ascending"), ("right", "ascending")])
        if not len(f):
            return
        left, right, n = (f.column(i).to_numpy() for i in range(3))
        ident = (bucket << 33) + np.arange(len(f))
        yield None, None, _packed(np.concatenate([ident, left, right, n]))
        if not told:
            return
        lefts, rights = np.unique(left), np.unique(right)
        key = np.searchsorted(lefts, left) * len(rights) + np.searchsorted(rights, right)
        find = lambda among, x: np.minimum(np.searchsorted(among, x), len(among) - 1)
        for chunk, z in zip(chunks, lists):
            a, b, _, code = pairs(z)
            i, j = find(lefts, a), find(rights, b)
            k = i * len(rights) + j
            at = find(key, k)
            ok = (lefts[i] == a) & (rights[j] == b) & (key[at] == k)
            if ok.any():
                yield int(chunk), _packed(np.concatenate([code[ok], ident[at[ok]]])), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["bucket"]):
            bucket, chunk = t.column("bucket").to_numpy(), t.column("chunk").to_numpy()
            at = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(t)]
            for i, j in zip(at, at[1:]):
                rows = list(answered(int(bucket[i]), chunk[i:j], t.column("pairs").slice(i, j - i)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), [pa.int64(), pa.binary(), pa.binary()])], ["chunk", "told", "named"])

    own = packed.where("bucket is not null").select("bucket", "chunk", "pairs")
    return in_arrow(own.repartition(parts(packed.sparkSession), "bucket").sortWithinPartitions("bucket"), run, _ANSWERS)


def _named(answers: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpacked(z, np.int64).reshape(4, -1)], ["id", "left", "right", "f"])

    return in_arrow(answers.where("named is not null").select("named"), run, _NAMED)


def _counted(rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.groupBy(*on).agg(F.sum("n").alias("f"))


def _numbered(df: DataFrame) -> DataFrame:
    """With ids, which hold from here on as the table is stored."""
    return cut(df.withColumn("id", F.monotonically_increasing_id()))


def _lengthened(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Frequent pairs of ids with what comes down from both parents: pre and suf are the counts of their beginnings and ends of 1, 2, ... words."""
    a = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.concat("pre", F.array("f")).alias("pre"))
    b = shorter.select(F.col("id").alias("right"), "word", F.concat("suf", F.array("f")).alias("suf"))
    return pairs.join(small(a), "left").join(small(b), "right").select("id", "left", "right", "f", "lang", F.concat_ws(" ", "head", "word").alias("phrase"), "word", "pre", "suf")


def _scored(level: DataFrame, unit: int) -> DataFrame:
    """With l, r and score of the lowest-scoring cut. Products are decimals of 38 digits."""
    big = lambda x: x.cast("decimal(19,0)")
    score = lambda x, j: F.call_function("div", F.lit(unit).cast("decimal(7,0)") * (big(F.col("f")) * big(F.col("f"))), big(x) * big(F.element_at("suf", F.size("suf") - j)))
    cuts = F.transform("pre", lambda x, j: F.struct(score(x, j).alias("score"), j.alias("j"), x.alias("l"), F.element_at("suf", F.size("suf") - j).alias("r")))
    return level.withColumn("cut", F.array_min(cuts)).select("*", "cut.score", "cut.l", "cut.r").drop("cut")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int | None = TOP, unit: int = UNIT, covered: int = COVERED, chunk: int = CHUNK) -> DataFrame:
    """Each language's phrases of 2 to `longest` words by how much more often they are there than their parts: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), pieces end at `[.,;:!?\\x0A-\\x0D]`, words at blanks and tabs. a, l, r count the phrase and both sides of the cut that
    scores lowest, score = floor(unit * a * a / (l * r)), of equal cuts the first; n counts all words of the language. Phrases of `least`
    occurrences count; one that lies in a longer such phrase with `covered` % of its occurrences or more is left out. The first `top` of
    each language (None: all) by score and a, falling, then by the phrase's bytes. A null lang is `und`; null and empty texts hold no words.
    Repeated rows count each. No words give no rows. Other columns are not read.
    """
    rows = _words(docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")), chunk)
    lists, seqs = _listed_words(rows), rows.select("chunk", "seq")
    words = _numbered(_counted(lists, ["lang", "word"]))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    level = words.where(F.col("f") >= least).select("id", "lang", "word", "f", F.col("word").alias("phrase"), F.array().cast("array<long>").alias("pre"), F.array().cast("array<long>").alias("suf"))
    buckets = max(parts(docs.sparkSession), (words.agg(F.sum("f")).first()[0] or 0) // BUCKET)
    ids, found = lists.join(small(level.select("lang", "word", "id")), ["lang", "word"]).select("chunk", "code", "id"), []
    for k in range(2, longest + 1):
        packed = _paired(ids, seqs, buckets)
        packed = cut(packed) if k < longest else packed
        answers = _answers(packed, least, k < longest)
        answers = cut(answers) if k < longest else answers
        pairs, ids, seqs = _named(answers), answers.where("told is not null").select("chunk", "told"), packed.where("seq is not null").select("chunk", "seq")
        longer = cut(_lengthened(pairs, level))
        if k > 2:
            inside = longer.select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("inside"))
            level = level.join(inside, "id", "left").where(F.coalesce(100 * F.col("inside") < covered * F.col("f"), F.lit(True)))
            found.append(level)
        level = longer
    found.append(level)
    every = found[0].select("lang", "phrase", "f", "pre", "suf")
    for x in found[1:]:
        every = every.unionByName(x.select("lang", "phrase", "f", "pre", "suf"))
    order = [F.col("score").desc(), F.col("f").desc(), F.col("phrase")]
    every = _scored(every, unit)
    if top is not None:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        every = every.withColumn("of", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("of") <= top)
    every = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    every = every.where(F.col("rank") <= top) if top is not None else every
    return every.join(small(cut(total)), "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) b
  ON s.k = 2 AND s.lang = b.lang AND s.phrase = b.phrase AND 100 * b.a >= 50 * s.a),
j AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS j FROM c),
h AS MATERIALIZED (SELECT *, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:k], ' ') AS rest FROM j),
s AS (SELECT h.lang, h.phrase, a, j, u.f AS l, v.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(u.f AS HUGEINT) * v.f) AS BIGINT) AS score
  FROM h JOIN f u ON u.lang = h.lang AND u.phrase = h.first JOIN f v ON v.lang = h.lang AND v.phrase = h.rest
  QUALIFY row_number() OVER (PARTITION BY h.lang, h.phrase ORDER BY score, j) = 1)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank, s.phrase, a, l, r, n, score
FROM s JOIN n USING (lang) LEFT JOIN x ON x.lang = s.lang AND x.phrase = s.phrase WHERE x.phrase IS NULL QUALIFY rank <= 2000"""
