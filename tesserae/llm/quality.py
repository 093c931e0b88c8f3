"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model trained on trusted text.

The model is over the UTF-8 bytes of words, so that no character of any script is merged with another: a word is start marks, its bytes and
an end mark, and each byte is predicted from the ORDER - 1 before it. Counts are gathered from all trusted text, per language, and the
estimates are sharded joins: counts with the totals of their histories, order by order. A document's perplexity is that of its words'
bytes and end marks. A language's limit comes from quantiles over trusted documents that the model has not seen: their median, and how far
a high quantile lies from it. So it follows the spread of the language's own clean texts, and lies beyond them.

A text that says one good word over and over reads well to that model, so the share of words that repeat the word before them has a
limit of its own, from the same quantiles of the same documents.

Toxic documents read like others too, so they have evidence of their own: the different words of a document that labelled toxic
documents hold far more often than others, each with the logarithm of its odds. A limit per language comes from labelled documents
that are not toxic and were not counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, cut, in_arrow, pieces, small

ORDER = 5
BITS = 8
MARK = 0x20  # before and after a word; no word holds it
VOCABULARY = 1 << BITS
#: The limit lies FENCE times as far above the median of the held-out trusted documents' perplexity as this quantile of it does, by ratio.
QUANTILE, FENCE = 0.95, 4.0
#: Least limit of the share of words that repeat the one before: a short clean text may say a word twice.
LEAST_AGAIN = 0.3
#: One of so many trusted documents is held out.
FOLDS = 5
#: Held-out documents that a language needs for a limit of its own; below, those of all languages together give it.
ENOUGH = 20
#: Bytes of average perplexity that each document's score is pulled with towards its language's, as short texts say little.
PRIOR = 40
#: Labelled toxic documents that hold a word that is evidence, and how many times as often as others they do, at least.
TOXIC_DOCS, TOXIC_ODDS = 3, 10.0
#: Words of most evidence that are used.
TOXIC_WORDS = 100_000
#: A document is toxic if its evidence is over this quantile of the held-out documents that are not.
TOXIC_QUANTILE = 0.999
#: Bytes of the model up to which it goes to every task; beyond, words are joined to it.
BROADCAST_BYTES = 64 << 20


def grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(gram, index of its word) of all words: the last byte is predicted, those before it are its history."""
    pad, marks = order - 1, bytes([MARK]) * (order - 1)
    flat = np.frombuffer(marks + marks.join(words) + marks, np.uint8).astype(np.int64)
    inside = flat != MARK
    at = np.flatnonzero(inside[pad :] | inside[pad - 1 : -1]) + pad  # a word's bytes and the mark after it
    word = np.cumsum(inside[at] & ~inside[at - 1]) - 1
    out = np.zeros(len(at), np.int64)
    for k in range(order):
        out = (out << BITS) | flat[at - pad + k]
    return out, word


def pad_of(order: int) -> int:
    return order - 1


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, c) over all words of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).to_pylist()
            for i, j in pieces(b.column(1)):
                by: dict[str | None, Counter] = {}
                for k in range(i, j):
                    by.setdefault(langs[k], Counter()).update(_raw(b.column(1)[k]).split())
                for lang, words in by.items():
                    if words:
                        g, w = grams(list(words), order)
                        own, back = np.unique(g, return_inverse=True)
                        c = np.bincount(back, np.fromiter(words.values(), np.int64, len(words))[w]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own), pa.array(c)], ["lang", "gram", "c"])

    return in_arrow(docs.select("lang", "text"), run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _raw(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def estimates(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, gram, alpha, gamma): for each order k the discounted probability of a gram, and for each history of order k (gram =
    history, alpha null) the weight of the next lower order.

    Below the highest order a gram counts the distinct symbols seen before it. Discounts for counts 1, 2 and 3 or more follow
    from the numbers of grams with counts 1 to 4, per language and order; where these are too few, half the count's usual discounts hold.
    """
    level, out = counts, []
    for k in range(order, 0, -1):
        t = level.withColumn("hist", F.shiftright("gram", BITS))
        n = [F.count_if(F.col("c") == i).cast("double") for i in (1, 2, 3, 4)]
        d = level.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
        y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
        cut_of = [1 - 2 * y * F.try_divide("n2", "n1"), 2 - 3 * y * F.try_divide("n3", "n2"), 3 - 4 * y * F.try_divide("n4", "n3")]
        d = d.select(F.col("lang").alias("l"), *[F.when(x.between(0.05, i - 0.05), x).otherwise(F.lit(i * 0.5)).alias(f"d{i}") for i, x in enumerate(cut_of, 1)])
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(small(cut(d)), F.col("lang") == F.col("l")).withColumn("disc", discount)
        # A history has as many rows as symbols follow it, at most the alphabet, so its totals are a window's and need no join.
        w = Window.partitionBy("lang", "hist")
        t = t.withColumns({"total": F.sum("c").over(w), "kept": F.sum("disc").over(w), "rn": F.row_number().over(w.orderBy("gram"))})
        null = F.lit(None).cast("double")
        own = F.struct(F.col("gram").alias("gram"), ((F.col("c") - F.col("disc")) / F.col("total")).alias("alpha"), null.alias("gamma"))
        history = F.struct(F.col("hist").alias("gram"), null.alias("alpha"), (F.col("kept") / F.col("total")).alias("gamma"))
        out.append(t.select("lang", F.lit(k).alias("k"), F.inline(F.when(F.col("rn") == 1, F.array(own, history)).otherwise(F.array(own)))))
        level = level.select("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
    return reduce(DataFrame.unionByName, out)


class Model:
    """The estimates of all languages as sorted arrays, for scoring in a task: of each gram its whole interpolated probability, of each
    history its weight. A language without a model has that of all together."""

    def __init__(self, rows: dict[str | None, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]):
        self.rows = rows  # by language, for k = order..1: grams, probabilities, histories, weights

    @classmethod
    def of(cls, est: pa.Table, order: int = ORDER) -> Model:
        names = est.column("lang").combine_chunks().dictionary_encode()
        lang = names.indices.fill_null(-1).to_numpy()
        k, g, a, h = (est.column(c).to_numpy() for c in ("k", "gram", "alpha", "gamma"))
        rows: dict = {}
        for i, name in [*enumerate(names.dictionary.to_pylist()), (-1, None)]:
            levels, lower = [], None
            for n in range(1, order + 1):
                own = (lang == i) & (k == n)
                x, y = own & ~np.isnan(a), own & ~np.isnan(h)
                x, y = np.flatnonzero(x), np.flatnonzero(y)
                if not len(x):
                    break
                p, q = x[np.argsort(g[x])], y[np.argsort(g[y])]
                hist, weight = g[q], h[q]
                rest = 1 / VOCABULARY if lower is None else lower[1][np.searchsorted(lower[0], g[p] & ((1 << BITS * (n - 1)) - 1))]
                lower = g[p], a[p] + weight[np.searchsorted(hist, g[p] >> BITS)] * rest
                levels.insert(0, (*lower, hist, weight))
            if levels:
                rows[name] = levels
        return cls(rows)

    def log_p(self, lang: str | None, gram: np.ndarray) -> np.ndarray:
        levels = self.rows.get(lang) or self.rows.get(POOLED) or []
        p, weight, left = np.zeros(len(gram)), np.ones(len(gram)), np.arange(len(gram))
        for i, (g, own, hist, gamma) in enumerate(levels):
            want = gram[left] & ((1 << BITS * (len(levels) - i)) - 1)
            at = np.minimum(np.searchsorted(g, want), len(g) - 1)
            hit = g[at] == want
            p[left[hit]] = weight[left[hit]] * own[at[hit]]
            left, want = left[~hit], want[~hit] >> BITS
            at = np.minimum(np.searchsorted(hist, want), len(hist) - 1)
            weight[left] *= np.where(hist[at] == want, gamma[at], 1.0)
        p[left] = weight[left] / VOCABULARY
        return np.log(p)

    def words(self, lang: str | None, words: list[bytes]) -> dict[bytes, float]:
        """Log probability of each word."""
        if not self.rows or not words:
            return dict.fromkeys(words, 0.0)
        g, i = grams(words)
        own, back = np.unique(g, return_inverse=True)
        return dict(zip(words, np.bincount(i, self.log_p(lang, own)[back], len(words)).tolist()))


POOLED = "\x00all"
_SIGNS = bytes.maketrans(b".,;:!?\"'()[]{}-", b" " * 15)


def different_words(raw: bytes) -> set[bytes]:
    """Lower-cased (A-Z) words without the signs around them."""
    return set(raw.lower().translate(_SIGNS).split())


def toxic_words(docs: DataFrame, known: DataFrame) -> dict[bytes, float]:
    """Words that speak for a toxic document, with the logarithm of their odds, from docs (doc_id, text) with a label (doc_id, t)."""
    labelled = docs.select("doc_id", "text").join(known.select("doc_id", "t"), "doc_id").select("text", (F.col("t") == 1).alias("toxic")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[bool, Counter] = {False: Counter(), True: Counter()}
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                by[toxic].update(different_words(text.as_buffer().to_pybytes()))
                by[toxic][b""] += 1  # the documents themselves; no word is empty
            words = list(by[True].keys() | by[False].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([by[x][w] for w in words], pa.int64()) for x in (True, False))], ["w", "bad", "good"])

    counts = cut(in_arrow(labelled, run, "w binary, bad long, good long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    every = counts.where("octet_length(w) = 0").first()
    if every is None:
        return {}
    odds = F.log((F.col("bad") + 0.5) / (every.bad + 1.0)) - F.log((F.col("good") + 0.5) / (every.good + 1.0))
    found = counts.where("octet_length(w) > 0").where(F.col("bad") >= TOXIC_DOCS).select("w", odds.alias("odds")).where(F.col("odds") >= float(np.log(TOXIC_ODDS)))
    return {bytes(r.w): r.odds for r in found.orderBy(F.col("odds").desc(), "w").limit(TOXIC_WORDS).collect()}


def evidence(raw: bytes, toxic: dict[bytes, float]) -> float:
    return sum(map(toxic.__getitem__, sorted(toxic.keys() & different_words(raw)))) if toxic else 0.0


def again(words: list[bytes]) -> float:
    """The share of words that are the same as the word before them."""
    return sum(map(bytes.__eq__, words, words[1:])) / len(words) if words else 0.0


_SIGNS_OF = "doc_id long, lang string, row long, evidence double, again double"


def _evidence(docs: DataFrame, toxic: dict[bytes, float]) -> DataFrame:
    """(doc_id, lang, row, evidence, again) of each row."""
    own = docs.sparkSession.sparkContext.broadcast(toxic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = map(_raw, b.column(3))
            e = [(evidence(t, own.value), again(t.split())) for t in raw]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([x[i] for x in e], pa.float64()) for i in (0, 1))], ["doc_id", "lang", "row", "evidence", "again"])

    return in_arrow(docs.select("doc_id", "lang", "row", "text"), run, _SIGNS_OF)


def _scored_held(docs: DataFrame, est: DataFrame, toxic: dict[bytes, float]) -> DataFrame:
    """The model's size is checked: it goes to the tasks; documents are not shuffled. A task holds some MB of text and its words at a time."""
    sc = docs.sparkSession.sparkContext
    own, bad = sc.broadcast(Model.of(est.toArrow()).rows), sc.broadcast(toxic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(own.value)
        for b in batches:
            langs = b.column(1).to_pylist()
            out = np.zeros((len(b), 4))
            for i, j in pieces(b.column(2), 4 << 20):
                raw = [_raw(b.column(2)[k]) for k in range(i, j)]
                lists = [t.split() for t in raw]
                for lang in set(langs[i:j]):
                    mine = [k for k in range(j - i) if langs[i + k] == lang]
                    known = model.words(lang, list(dict.fromkeys(chain.from_iterable(lists[k] for k in mine))))
                    for k in mine:
                        w = lists[k]
                        out[i + k] = sum(map(known.__getitem__, w)), sum(map(len, w)) + len(w), evidence(raw[k], bad.value), again(w)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(out[:, 2]), pa.array(out[:, 3]), pa.array(out[:, 0]), pa.array(out[:, 1].astype(np.int64))], ["doc_id", "lang", "row", "evidence", "again", "log_p", "n"])

    return in_arrow(docs.select("doc_id", "lang", "text", "row"), run, f"{_SIGNS_OF}, log_p double, n long")


def _scored_joined(docs: DataFrame, est: DataFrame, toxic: dict[bytes, float], order: int = ORDER) -> DataFrame:
    """For a model of any size: distinct words are scored by joins with the estimates, documents' words are joined to them."""
    known = est.where(F.col("lang") != POOLED).select("lang").distinct().select(F.col("lang").alias("l"), F.lit(True).alias("known"))
    d = docs.join(known, F.col("lang") == F.col("l"), "left").withColumn("m", F.when(F.col("known"), F.col("lang")).otherwise(F.lit(POOLED)))
    # Rows that repeat whole are scored once; the score goes back to each of them.
    w = d.dropDuplicates(["doc_id", "lang", "row"]).select("doc_id", "lang", "row", "m", F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    w = w.groupBy("doc_id", "lang", "row", "m", "w").agg(F.count("*").alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(1).to_pylist()
            g, i = grams([w.encode() for w in words], order)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(g)], ["m", "w", "gram"])

    g = in_arrow(w.select("m", "w").distinct(), run, "m string, w string, gram long").groupBy("m", "w", "gram").agg(F.count("*").alias("times"))
    p = g.select("m", "gram").distinct().withColumns({"p": F.lit(0.0), "weight": F.lit(1.0)})
    for k in range(order, 0, -1):
        e = est.where(F.col("k") == k).select(F.col("lang").alias("m"), F.col("gram").alias("x"), "alpha", "gamma")
        mask = F.lit((1 << BITS * k) - 1)
        p = p.withColumn("x", F.col("gram").bitwiseAND(mask)).join(e.where("alpha is not null").drop("gamma"), ["m", "x"], "left")
        p = p.withColumn("p", F.col("p") + F.col("weight") * F.coalesce("alpha", F.lit(0.0))).drop("alpha")
        p = p.withColumn("x", F.shiftright("x", BITS)).join(e.where("gamma is not null").drop("alpha"), ["m", "x"], "left")
        p = p.withColumn("weight", F.col("weight") * F.coalesce("gamma", F.lit(1.0))).drop("gamma", "x")
    p = p.select("m", "gram", F.log(F.col("p") + F.col("weight") / VOCABULARY).alias("lp"))
    words = g.join(p, ["m", "gram"]).groupBy("m", "w").agg(F.sum(F.col("lp") * F.col("times")).alias("lp"))
    s = w.join(words, ["m", "w"]).groupBy("doc_id", "lang", "row").agg(F.sum(F.col("lp") * F.col("times")).alias("log_p"), F.sum((F.octet_length("w") + 1) * F.col("times")).alias("n"))
    names = ["doc_id", "lang", "row"]
    s = s.select(*[F.col(c).alias(f"_{c}") for c in names], "log_p", "n")
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names))
    return _evidence(docs, toxic).join(s, on, "left").select("doc_id", "lang", F.coalesce("log_p", F.lit(0.0)).alias("log_p"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "row", "evidence", "again")


def scored(docs: DataFrame, labels: DataFrame, bound: int = BROADCAST_BYTES, quantile: float = QUANTILE, fence: float = FENCE) -> DataFrame:
    """One row per row of docs: doc_id, lang, n (bytes and word ends), perplexity, limit, kept, row (a hash of the text).

    docs: doc_id, text, lang; labels: doc_id, quality, toxic. Trusted are documents with a label of quality 1 and toxic not 1 and none that
    says otherwise. One in FOLDS of them, by a hash of doc_id, sets the limits and is not trained on. Languages without trusted text
    use the model and limit of all together; without any trusted text nothing is rejected (limit null). Null and empty
    texts have n 0, take their language's average and are kept. Repeated rows are scored each. Other columns are not read.
    Toxic documents, by the evidence of their words, are not kept, whatever their own labels say: labels only teach the words and the
    limit, which is that of all languages together where one has few held-out documents; without any held out no document is toxic.
    Neither are those that repeat themselves word by word.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row"))
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t"))
    known = good.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "q", "t", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)) == 0).alias("held"))
    known = small(cut(known))
    good = known.where("q = 1 and t <> 1").select("doc_id", "held")
    counts = cut(gram_counts(docs.select("doc_id", "lang", "text").join(good.where("not held"), "doc_id")))
    every = counts.where("lang is not null")
    langs = small(cut(every.select(F.col("lang").alias("l")).distinct()))
    if not docs.select("lang").distinct().join(langs, F.col("lang").eqNullSafe(F.col("l")), "left_anti").isEmpty():
        every = every.unionByName(counts.groupBy("gram").agg(F.sum("c").alias("c")).select(F.lit(POOLED).alias("lang"), "gram", "c"))
    est = cut(estimates(every))
    size = est.count() * 16  # a gram or history and its number
    toxic = toxic_words(docs, known.where("not held"))
    raw = cut(_scored_held(docs, est, toxic) if size <= bound else _scored_joined(docs, est, toxic))
    held = raw.join(good.where("held"), "doc_id").where("n > 0")
    mean = held.groupBy("lang").agg((F.sum("log_p") / F.sum("n")).alias("mean"), F.count("*").alias("docs")).where(f"lang is not null and docs >= {ENOUGH}")
    all_mean = held.agg(F.sum("log_p") / F.sum("n")).first()[0] or 0.0
    mean = small(cut(mean.select(F.col("lang").alias("l"), "mean")))

    def pulled(df: DataFrame) -> DataFrame:
        df = df.join(mean, F.col("lang") == F.col("l"), "left")
        return df.withColumn("perplexity", F.exp(-(F.col("log_p") + PRIOR * F.coalesce("mean", F.lit(all_mean))) / (F.col("n") + PRIOR)))

    held = pulled(held)
    spread = [F.percentile_approx(c, [0.5, quantile], 10_000).alias(c) for c in ("perplexity", "again")]
    middle, high = (lambda c: F.col(c)[0]), (lambda c: F.col(c)[1])
    q = [(middle("perplexity") * F.pow(high("perplexity") / middle("perplexity"), fence)).alias("own_perplexity"), (middle("again") + fence * (high("again") - middle("again"))).alias("own_again")]
    limits = small(cut(held.where("l is not null").groupBy("l").agg(*spread).select(F.col("l").alias("l3"), *q)))
    every = held.agg(*spread).select(*q).first()
    harmless = raw.join(known.where("held and t <> 1").select("doc_id"), "doc_id")
    most = F.percentile_approx("evidence", TOXIC_QUANTILE, 10_000)
    toxic_limits = harmless.groupBy("lang").agg(most.alias("most"), F.count("*").alias("docs")).where(f"lang is not null and docs >= {ENOUGH}").select(F.col("lang").alias("l4"), "most")
    most_of_all = F.lit(harmless.agg(most).first()[0]).cast("double")
    out = pulled(raw).join(limits, F.col("lang") == F.col("l3"), "left").join(small(cut(toxic_limits)), F.col("lang") == F.col("l4"), "left")
    limit, twice = (F.coalesce(f"own_{c}", F.lit(every[f"own_{c}"]).cast("double")) for c in ("perplexity", "again"))
    harmful = F.coalesce(F.col("evidence") > F.coalesce("most", most_of_all), F.lit(False)) | F.coalesce(F.col("again") > F.greatest(twice, F.lit(LEAST_AGAIN)), F.lit(False))
    return out.select("doc_id", "lang", "n", "perplexity", limit.alias("limit"), (F.coalesce(F.col("perplexity") <= limit, F.lit(True)) & ~harmful).alias("kept"), "row")
