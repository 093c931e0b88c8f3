"""Collocations against a plain version that counts every phrase."""

import random
import re
from collections import Counter

import pytest

from tesserae.llm import collocations

DOCS = "doc_id long, text string, lang string, n long, code string, word string"


def plain(rows, longest, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    c = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    has = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out = []
    for (lang, p), a in c.items():
        if any(q[0] == lang and len(q[1]) > len(p) and has(p, q[1]) and 100 * b >= 50 * a for q, b in c.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    rank, got = Counter(), []
    for lang, score, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return got


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, la, 0, "clash", "clash") for i, (t, la) in enumerate(rows)], DOCS).repartition(3)
    return sorted(map(tuple, collocations.collocations(df, **more).collect()))


@pytest.mark.parametrize("longest,chunk", [(2, 1 << 20), (3, 50), (5, 400)])
def test_collocations_against_plain(spark, longest, chunk):
    r = random.Random(longest)
    own = ["alpha", "beta", "Gamma", "d", "é", "ß😀", "A\x00b", "x y", "-"]
    rows = [("".join(r.choice(own) + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b "]) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None, "und"])) for _ in range(80)]
    rows += [("to be or not to be to be", "en")] * 30
    assert found(spark, rows, longest=longest, least=3, top=40, chunk=chunk) == plain(rows, longest, 3, 40)


def test_collocations_odd(spark):
    long = "the same words again " * 50_000
    rows = [(None, "en"), ("", "en"), (" \t ", None), (".,;", "en"), ("one", "fr"), (long, "xx"), ("a b", None), ("a b", "und")]
    assert found(spark, rows, least=2) == plain(rows, 3, 2, 2000)
    assert found(spark, []) == [] and found(spark, [("a b", "en")]) == []


def test_scores_past_64_bits(spark):
    """a * a * 1,000,000 passes 64 bits from a = 3,037,000 on, and l * r from about 3,037,000,000."""
    a, left, right = 9_007_199_254_740_993, 9_007_199_254_740_995, 9_107_199_254_740_997
    level = spark.createDataFrame([(a, [left], [right])], "f long, pre array<long>, suf array<long>")
    row = collocations._scored(level, collocations.UNIT).first()
    assert (row.score, row.l, row.r) == (1_000_000 * a * a // (left * right), left, right)


def test_top_is_whole_without_limit(spark):
    rows = [(" ".join(f"w{i} v{i}" for i in range(400)), "en")] * 10
    assert len(found(spark, rows, longest=2, top=None)) == 799 and len(found(spark, rows, longest=2, top=500)) == 500
