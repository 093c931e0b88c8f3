"""The prefix filter against all pairs, for texts of any length, families, and a line that everyone has."""

import random
import time

import numpy as np
import pytest
import xxhash
from test_llm import plain_components

from tesserae.llm import similarity
from tesserae.llm.decontaminate import hashes

DOCS = "doc_id long, text string, h long, cls string, n long, key string"


def plain(texts):
    sets = {xxhash.xxh64_intdigest(t.encode(), 42): set(hashes(t.encode()).tolist()) for t in set(texts) if t and t.split()}
    return plain_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)


def found(spark, texts, **more):
    df = spark.createDataFrame([(i, t, 0, "clash", 0, "clash") for i, t in enumerate(texts)], DOCS).repartition(4)
    pairs = [(r.low & (1 << 64) - 1, r.cls & (1 << 64) - 1) for r in similarity.similar(df, **more).collect()]
    nodes = sorted({xxhash.xxh64_intdigest(t.encode(), 42) for t in texts if t and t.split()})
    linked = {frozenset(p) for p in pairs}
    return plain_components(nodes, lambda a, b: frozenset((a, b)) in linked)


def changed(r, words, n):
    w = list(words)
    for _ in range(n):
        i = r.randrange(len(w))
        w[i : i + r.randint(0, 1)] = [f"new{r.randrange(10**6)}"] if r.random() < 0.7 else []
    return w


@pytest.mark.parametrize("chunk", [256, 5])
def test_similar_against_all_pairs(spark, chunk):
    r = random.Random(chunk)
    some = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    texts = ["", " ", "one", "ONE", "a b c", "a b c d e"]
    for _ in range(60):
        base = some(r.choice([6, 12, 20, 35, 48, 60, 150, 400]))
        texts += [" ".join(base), *(" ".join(changed(r, base, r.randint(1, max(1, len(base) // 60)))) for _ in range(3))]
        texts.append(" ".join(base[:-1] + ["other"]))  # the last word
    for _ in range(3):  # families whose base is not there: copies are at the limit to each other
        base = some(200)
        texts += [" ".join(changed(r, base, 4)) for _ in range(25)]
    passage = some(80)
    texts += [" ".join(some(60) + passage + some(60)) for _ in range(30)]
    assert found(spark, texts, chunk=chunk) == plain(texts)


def test_short_near_copies(spark):
    """Texts of 20 to 48 words that differ in the last word."""
    r = random.Random(3)
    texts = []
    for i in range(100):
        w = [f"v{r.randrange(9000)}" for _ in range(r.randint(20, 48))]
        texts += [" ".join(w), " ".join([*w[:-1], f"last{i}"])]
    got = found(spark, texts)
    assert got == plain(texts) and len(set(got.values())) == 100


def test_common_line(spark):
    """Texts that share a line and nothing else: twice as many cost no more than about twice, and none are linked."""
    r = random.Random(1)
    line = " ".join(f"line{i}" for i in range(30))
    took = {}
    for n in (500, 4000, 8000):  # the first one warms up
        texts = [line + " " + " ".join(f"x{r.randrange(10**6)}" for _ in range(60)) for _ in range(n)]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").cache()
        df.count()
        began = time.perf_counter()
        assert similarity.similar(df).count() == 0
        took[n] = time.perf_counter() - began
    assert took[8000] < 2 * took[4000] + 2


def test_prefix_holds_what_similar_sets_share():
    r = np.random.default_rng(2)
    for _ in range(400):
        n = int(r.integers(1, 120))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.93], r.integers(0, 1 << 63, int(r.integers(0, n // 8 + 1))).astype(np.uint64)]))
        last = np.sort(r.choice(a, len(a) // 3, replace=False))
        both = len(np.intersect1d(a, b))
        if len(b) and both >= 0.8 * (len(a) + len(b) - both):
            shared = len(np.intersect1d(similarity.prefix(a, last, 0.8), similarity.prefix(b, last, 0.8)))
            assert shared >= similarity.more(int(np.ceil(0.8 * max(len(a), len(b)) - 1e-9)))


def test_similar_odd(spark):
    assert found(spark, []) == {} and found(spark, ["", " \n"]) == {}
    df = spark.createDataFrame([(None, None), (None, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4"), (1, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 5"), (1, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 5")], "doc_id long, text string")
    assert similarity.similar(df).count() == 1


def test_long_chain_is_compared_by_pairs(spark, monkeypatch):
    """Texts that each share half with the next are one group. What is dealt out of it grows with the texts and not with their square, and near copies are found."""
    r, dealt = random.Random(5), []
    blocks = [[f"b{i}x{r.randrange(10**6)}" for _ in range(40)] for i in range(301)]
    texts = [" ".join(blocks[i] + blocks[i + 1]) for i in range(300)]
    texts += [" ".join([*blocks[i], "new", *blocks[i + 1][1:]]) for i in range(0, 300, 50)]

    def counted(places, chunk, was=similarity._dealt):
        out = was(places, chunk)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(similarity, "_dealt", counted)
    got = found(spark, texts, chunk=2)
    assert got == plain(texts) and len(set(got.values())) == 300
    assert sum(dealt) < 4 * len(texts)
