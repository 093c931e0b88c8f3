"""Repeats of byte strings against a plain version that counts every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import suffixes

DOCS = "doc_id long, text string, size string, cls string, key long, n long"


def plain(rows, width):
    every = Counter(x[i : i + width] for _, t in rows for x in [(t or "").encode()] for i in range(len(x) - width + 1))
    out = []
    for i, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for s in range(len(x) - width + 1):
            if every[x[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), sum(g and not h for g, h in zip(gone, b"\0" + gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, width, **more):
    df = spark.createDataFrame([(i, t, "clash", "clash", 0, 0) for i, t in rows], DOCS).repartition(4)
    return sorted(map(tuple, suffixes.without_repeats(df, width=width, **more).drop("spans").collect()), key=str)


@pytest.mark.parametrize("signs,width,memory", [(b"ab", 4, 64), (b"ab", 12, 1 << 20), (b"a", 9, 100), (b"abcdefgh \xc3\xa9", 6, 1 << 12), (b"xyz\0", 20, 512)])
def test_suffixes_in_order(signs, width, memory):
    """The order and the common prefixes, with queues that go to disk; as far as `width` tells."""
    r = random.Random(width)
    for _ in range(25):
        strings = [bytes(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 12))]
        strings += r.choices(strings, k=3)
        text = np.append(np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(2), np.uint8(0))
        got = list(suffixes.suffixes(text, width, memory, block=r.choice([1, 7, 1000])))
        place, common = (np.concatenate(x).tolist() for x in zip(*got))
        raw = text.tobytes()
        assert sorted(place) == [i for i in range(len(raw)) if i != len(raw) - 1]
        heads = [raw[p : p + width] for p in place]
        assert heads == sorted(heads, reverse=True)
        for a, b, n in zip(place, place[1:], common[1:]):
            same = next((i for i in range(width) if raw[a + i : a + i + 1] != raw[b + i : b + i + 1] or a + i >= len(raw)), width)
            assert n == same
        every = Counter(s[i : i + width] for s in strings for i in range(len(s) - width + 1))
        assert [x.tolist() for x in suffixes.repeats(strings, width, memory)] == [[every[s[i : i + width]] > 1 for i in range(len(s) - width + 1)] for s in strings]


def test_queues_spill():
    q = suffixes.Queues(100)
    want = [[] for _ in range(256)]
    r = random.Random(1)
    for i in range(200):
        b, n = r.randint(60, 64), r.randint(1, 9)
        q.put(b, np.arange(i, i + n, dtype=np.int32), np.full(n, i % 250, np.uint8))
        want[b] += [(j, i % 250) for j in range(i, i + n)]
    assert q.spilled > 1000
    for b in range(60, 65):
        n = q.size(b)
        assert n == len(want[b])
        for lo, hi in ((0, n), (3, n - 2), (n // 2, n // 2 + 1)):
            assert list(zip(*(x.tolist() for x in q.take(b, lo, hi)))) == want[b][lo:hi]
    q.close()


@pytest.mark.parametrize("hot", [1 << 16, 1])
def test_without_repeats_against_plain(spark, hot):
    r = random.Random(hot)
    word = lambda: "".join(r.choice("abcdeé😀") for _ in range(r.randint(1, 7)))
    some = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(40)]
    passage = " ".join(word() for _ in range(30))
    rows = [(i, t) for i, t in enumerate(some)]
    rows += [(100 + i, f"{word()} {word()} {passage} {word()} {word()} {word()}") for i in range(60)]
    rows += [(200 + i, some[i][: r.randint(10, 80)] + word() + some[i + 1][5:]) for i in range(20)]
    rows += [(300, "ab" * 300), (301, "ab" * 100), (302, "a" * 500), (303, (some[3] + ".") * 2)]
    assert found(spark, rows, 40, gram=8, hot=hot, shard=5000, memory=2000) == plain(rows, 40)


def test_without_repeats_odd(spark):
    long = "".join(f"{i} and " for i in range(40_000))
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (5, long), (6, "short"), (6, "short"), (None, "y" + "no id " * 60), (None, "y" + "no id " * 60), (7, long[1000:1400] + "z"), (8, "é" * 100), (9, "ß" * 101)]
    assert found(spark, rows, 200) == plain(rows, 200)
    assert found(spark, [], 200) == [] and found(spark, rows[:2], 200) == plain(rows[:2], 200)
