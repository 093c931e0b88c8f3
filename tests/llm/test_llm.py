"""Every operator against a brute-force version, an exact round trip or held-out accuracy; and the awkward inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import rows_of
from pyspark.sql import functions as F

from tesserae.llm import chat, common, decontaminate, embeddings, html_text, mixing, pii, quality, queries, sharding, simhash, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a very long text, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
    rows = [(1, None, None, None), (2, "", "en", ""), (3, "   \n\t ", "en", "a"), (4, long, "en", "a"), (5, long, "en", None), (6, "one", "en", "b"), (6, "one", "en", "b"), (7, "ÄÖÜ ß 😀 x@y.zz", "de", "b"), (None, "no id here at all", "xx", "c"), (8, "a b c d e f g", None, "a")]
    d = spark.createDataFrame([(i, t, la, s, 0) for i, t, la, s in rows], DOCS)
    return d.withColumns({"size": F.lit("clash"), "fp": F.lit("clash"), "cls": F.lit("clash"), "shard": F.lit(1), "key": F.lit(2), "row": F.lit(3), "n": F.lit(4), "lang2": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


# --- every query with SQL --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows_of(got, columns) == rows_of(want, columns)


# --- 9 SimHash -------------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def test_masks_cover_every_pair():
    m = [x & (1 << 64) - 1 for x in simhash.masks()]
    rng = random.Random(0)
    for _ in range(20_000):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(diff & x == 0 for x in m)


def test_simhash_equals_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_groups(d).collect()}
    want = {r.doc_id: plain_fingerprint(r.text) for r in d.collect()}
    assert {k: v[0] for k, v in got.items()} == want
    comp = plain_components(sorted(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 3)
    assert {k: v[1] for k, v in got.items()} == comp


def test_forest_over_split_buckets(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for c in centre for _ in range(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    e = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), chunk=16)
    got = {r.node: r.root for r in common.components(e).collect()}
    want = plain_components(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert all(got.get(k, k) == v for k, v in want.items())


def test_simhash_odd(odd, none):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == odd.count() and simhash.simhash_groups(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == "0" * 16 and by[3].component_id == 1 and by[5].component_id == 4 and not by[5].kept


# --- 10 decontamination ------------------------------------------------------------------------------------------------------------------


def test_decontamination_paths_agree(spark, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one, two = (sorted(map(tuple, decontaminate.contaminated(d, b, bound=n).collect())) for n in (decontaminate.BROADCAST_BYTES, 0))
    assert one == two


def test_no_share_is_missed():
    rng = random.Random(5)
    for _ in range(60):
        item = [f"i{rng.randrange(10**6)}" for _ in range(rng.randint(5, 90))]
        doc = list(item)
        for k in rng.sample(range(len(doc)), min(len(doc), rng.randint(0, 4))):
            doc[k] = "zz"
        text, whole = " ".join(["x"] * 50 + doc + [f"d{i}" for i in range(3000)]), " ".join(item)
        sh, own = set(decontaminate.shingles(whole.encode())), set(decontaminate.shingles(text.encode()))
        got = decontaminate.Searcher([(1, whole.encode())]).find(text.encode())
        assert bool(got) == (len(sh & own) >= 0.8 * len(sh) - 1e-9)


def test_decontamination_odd(spark, odd, none):
    b = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (4, "one"), (5, "a b c d e f g")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, b).collect())
    assert got == [(6, 4), (8, 1), (8, 5)] and got == sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, b, bound=0).collect())
    assert decontaminate.contaminated(none, b).count() == 0 and decontaminate.contaminated(odd, b.where("false")).count() == 0


def test_decontamination_of_repeated_rows(spark):
    w = [f"w{i}" for i in range(54)]
    rows = [(1, " ".join(w[:24])), (1, " ".join(w[:24])), (2, " ".join(w[:50])), (2, " ".join(w[:50])), (None, " ".join(w)), (None, " ".join(w))]
    items = [(1, " ".join(w)), (1, " ".join(w)), (2, " ".join(w)), (2, " ".join(reversed(w)))]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, two = (sorted(map(repr, decontaminate.contaminated(d, b, bound=n).collect())) for n in (decontaminate.BROADCAST_BYTES, 0))
    assert one == two and len(one) == 4
    assert {(r.doc_id, r.n_shared) for r in decontaminate.contaminated(d, b, bound=0).collect()} == {(2, 46), (None, 50)}


# --- 2 mixing ----------------------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        at = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * at >= 2 * sizes[s]]
        if not over:
            return out | {s: w[s] * at for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)


def test_mixing(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got, again = (mixing.mix(d).collect() for _ in range(2))
    assert got == again
    src = {r.doc_id: r.source for r in d.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[src[r.doc_id]] += r.size
        taken[src[r.doc_id]] += r.taken
        target[src[r.doc_id]] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(sizes)
    assert all(abs(want[s] - target[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1 for s in want)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < len(want)


def test_mixing_odd(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and mixing.mix(none).count() == 0 and [r.size for r in got if r.doc_id == 1] == [0]
    m = mixing.mixed(odd)
    assert m.columns == odd.columns and m.where("doc_id = 1").count() == 1 and mixing.mixed(none).count() == 0


# --- 5 sharding --------------------------------------------------------------------------------------------------------------------------


def test_sharding(spark, sf, odd, none):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got, again = (sorted(map(tuple, sharding.sharded(d).drop("grown_shard").collect())) for _ in range(2))
    assert got == again
    load, places = Counter(), defaultdict(list)
    text = {r.doc_id: r.text for r in d.collect()}
    for r in sharding.sharded(d).collect():
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == __import__("zlib").crc32(raw) and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(load) <= set(range(16)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= 0.02 * max(load.values())
    assert sharding.sharded(odd).count() == odd.count() and sharding.sharded(none).count() == 0 and sharding.assign(odd).count() == odd.count()


def test_slot_map(spark, tmp_path):
    rng = random.Random(1)
    w = [rng.randint(1, 1000) for _ in range(512)]
    a = sharding.SlotMap.uniform(8, 512)
    b = a.rebalanced(w)
    load = lambda m: [sum(x for x, s in zip(w, m.shard_of) if s == k) for k in range(m.shards)]
    assert b.version == 2 and max(load(b)) - min(load(b)) <= 8 and sum(x != y for x, y in zip(a.shard_of, b.shard_of)) < 200
    c = b.grown().rebalanced(w)
    assert len(load(c)) == 9 and max(load(c)) - min(load(c)) <= 8
    for m in (a, b, c):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == c and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == a


# --- 3 pages -----------------------------------------------------------------------------------------------------------------------------


def test_pages():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Home</a> Site</header><nav><ul><li>Menu</nav><div class="ad">Buy &amp; go</div>
    <article><h1>Head &lt;1&gt;</h1><p>One  two<br>three <b>four</b>.</p><aside>Side</aside><p>Short.</p><ul><li>item a<li>item b</ul><form>Mail <input></form>
    <section class="comments"><p>A very long reader comment that should not be in the text at all, however long it is.</p></section><p>Last &copy; para</p></article><footer>Foot</footer><script>var t="</p>";</script></body></html>"""
    assert html_text.main_text(page) == "Head <1>\nOne two three four.\nShort.\nitem a\nitem b\nLast © para"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div><script>x</script></div>") == ""
    bare = "<body><div><a href=1>Menu one</a> <a href=2>Menu two</a></div><section><p>" + "Text of the story. " * 9 + "</p><p>It ends.</p></section><div id='sidebar'>Side</div></body>"
    assert html_text.main_text(bare) == ("Text of the story. " * 9).strip() + "\nIt ends."
    html_text.main_text("<" * 50_000 + "<!--" * 10_000 + "<p")


def test_pages_attributes_and_class_words():
    long = "A long paragraph of the article with many words in it, as articles have. " * 3
    for part, kept in (
        ('<div style="overflow: hidden">{}</div>', True), ('<div data-hidden="false">{}</div>', True), ('<section class="related-work">{}</section>', True), ('<div class="social-history">{}</div>', True), ('<header><p>{}</p></header>', True),
        ("<div hidden>{}</div>", False), ('<div aria-hidden="true">{}</div>', False), ('<div class="sidebar-left">{}</div>', False), ('<div class="x ad-slot">{}</div>', False), ('<div id=comments>{}</div>', False), ("<div title='class=ad'>{}</div>", True),
    ):
        page = f"<body><article><h1>Title</h1><p>{long}</p>{part.format('The part in question.')}<p>{long}</p></article></body>"
        assert ("The part in question." in html_text.main_text(page)) == kept, part


def test_pages_without_article():
    long = [f"Paragraph {i} of the story goes on for quite a while, so that it is as long as those of articles are." for i in range(4)]
    body = "".join(f"<p>{x}</p>" for x in long)
    page = f"<body><div><div><a href=/>Home</a> <a href=/b>News</a></div><div><span>Site name</span></div></div><div><div><h1>Headline</h1>{body}<p>Short end.</p></div></div><div><div>Imprint 2020</div></div></body>"
    assert html_text.main_text(page) == "\n".join(["Headline", *long, "Short end."])
    two = f"<body><div><h1>Headline</h1></div><div><div>{body}</div></div><div><div><div>Tail</div></div></div><div><div><div>{body}</div></div></div></body>"
    assert html_text.main_text(two) == "\n".join(["Headline", *long, *long])
    assert html_text.main_text(f"<body><div class='content-sidebar promo'>{body}</div></body>") == "\n".join(long)


def test_pages_of_deep_nesting():
    import time

    began = time.perf_counter()
    text = "<h1>Title</h1><p>" + "Long first part. " * 20 + "</p><p>" + "Long second part. " * 20 + "</p>"
    want = "\n".join(["Title", ("Long first part. " * 20).strip(), ("Long second part. " * 20).strip()])
    menu = "<a href='/'>Home</a> <a href='/a'>About us</a>"
    for page in [
        f"<body><form action='x'><nav>{menu}</nav><div>{text}</div><footer>Imprint and more</footer></form></body>",
        f"<body><nav>{menu}<article>{text}</article></body>",
        f"<body><nav>{menu}<section>{text}</section><footer>Imprint</footer></body>",
        f"<body><article>{text}<form><p>Your address</p></form></article></body>",
        f"<body><div>{text}</div><form><p>Your name</p><p>Your address</p></form></body>",
    ]:
        assert html_text.main_text(page) == want, page
    notes = "".join(f"<div class='comment'><p>{f'I think that {i} is not so at all, whatever they say. ' * 9}</p></div>" for i in range(12))
    short = "<h1>Title</h1><p>A short report of three sentences. It says little. It ends.</p>"
    for page in [f"<body><article>{short}</article><div id='comments'>{notes}</div></body>", f"<body><article>{short}{notes}</article></body>", f"<body><div>{short}</div><div>{notes}</div></body>", f"<body><form><div>{short}</div>{notes}</form></body>"]:
        assert html_text.main_text(page) == "Title\nA short report of three sentences. It says little. It ends.", page
    assert html_text.main_text("<div>" * 100_000 + "text" + "</div></p>" * 100_000) == "text"
    assert time.perf_counter() - began < 20


def test_pages_table(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in p.collect()}
    import html as h

    for r in html_text.extracted(p).collect():
        body = re.search("<article>(.*)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert html_text.extracted(p.where("false")).count() == 0
    assert html_text.extracted(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")).first().text == ""


# --- 4 chat ------------------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_end|>", "<\\\\|x|>", "", "a\n<|im_start|>assistant\nb", "$1 \\ %", "<|", "<", "|>", "😀", None]
    rows = [(c, t, ["user", "assistant", "sys\ntem%<|im_end|>\n"][t % 3], nasty[(c + t) % len(nasty)]) for c in range(12) for t in range(9)]
    chats = chat.formatted(chat.canonical(chat.by_turn(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    for r in chats.withColumns({"back": chat.parsed(F.col("formatted")), "learnt": chat.learnt(F.col("formatted"), F.col("loss_spans"))}).collect():
        want = [(ro, t or "") for c, _, ro, t in rows if c == r.conv_id]
        assert [(x.role, x.text) for x in r.back] == want and r.learnt == "".join(t for ro, t in want if ro == "assistant")
        assert [r.formatted[s.start : s.end] for s in r.loss_spans] == [re.sub(r"<(\\*)\|", r"<\1\\|", t) for ro, t in want if ro == "assistant"]


def test_chat_layouts(spark):
    schema = "id int, prompt string, response string, instruction string, input string, output string, system string, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, extra string"
    rows = [
        (1, "q", "a", None, None, None, None, None, None, "x"), (2, "q", "a", None, None, None, "s", None, None, None), (3, None, None, "do", "it", "done", None, None, None, None), (4, None, None, "do", None, "done", None, None, None, None),
        (5, None, None, None, None, None, None, [("user", "q"), ("assistant", "a")], None, None), (6, None, None, None, None, None, "s", None, [("human", "q"), ("gpt", None)], None), (7, None, None, None, None, None, None, None, None, "only"), (8, "q", None, None, None, "o", None, None, None, None),
    ]
    got = {r.id: r for r in chat.formatted(chat.canonical(spark.createDataFrame(rows, schema))).collect()}
    turns = lambda i: [(t.role, t.text) for t in got[i].turns]
    assert turns(1) == [("user", "q"), ("assistant", "a")] and turns(2)[0] == ("system", "s") and turns(3)[0] == ("user", "do\n\nit") and turns(4)[0] == ("user", "do")
    assert turns(5) == turns(1) and turns(6) == [("system", "s"), ("user", "q"), ("assistant", "")] and got[7].turns is None and got[8].layout is None and got[7].formatted == ""
    assert len({got[i].fingerprint for i in range(1, 7)}) == 6


def test_chat_odd(spark):
    schema = "id int, messages array<struct<role:string,content:string>>, _marked string, _turns string, _layout string, _fingerprint string"
    rows = [(1, [("user", "q"), ("assistant", "x" * 300_000)], "a", "b", "c", "d"), (2, [("user", None)], "a", "b", "c", "d"), (3, [], "a", "b", "c", "d"), (4, None, "a", "b", "c", "d")]
    got = {r.id: r for r in chat.formatted(chat.canonical(spark.createDataFrame(rows, schema))).collect()}
    assert all((r["_marked"], r["_turns"], r["_layout"], r["_fingerprint"]) == ("a", "b", "c", "d") for r in got.values())
    assert len(got[1].formatted) > 300_000 and got[2].layout is None and got[3].layout == "messages" and got[3].formatted == "" and got[4].layout is None
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.formatted(chat.canonical(chat.by_turn(none)))).count() == 0


# --- 6 personal data ---------------------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def ok(kind, s):
        d = [int(c) for c in s if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m[0])]


def test_patterns_equal_regex():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "B", "@", ".", "-", "_", "+", "1", "9", "255", "0", " ", "(", ")", "x@y.z", "4111 1111 1111 1111", "+1 (555) 555-1234", "1.2.3.4", "é"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("1" * 20_000, "@" * 20_000, "a" * 20_000 + "@", "1." * 20_000, "+1" + "(" * 20_000):
        pii.base_spans(t)


def test_field_on_held_out_lines():
    f, hit, total, plain, wrong = pii.trained(), 0, 0, 0, 0
    held = pii.labelled_table(200, seed=5)
    for (_, tags), y in zip(held, f.decode([w for w, _ in held])):
        for a, b in zip(tags, y if y is not None else [0] * len(tags)):
            total += a != "O"
            plain += a == "O"
            hit += a != "O" and pii.LABELS[b] == a
            wrong += a == "O" and b != 0
    assert hit >= 0.97 * total and wrong <= 0.02 * plain


def test_short_cut_equals_viterbi():
    f = pii.trained()
    lines = [w for w, _ in pii.labelled_table(150, seed=8)] + [["plain", "words"], []]
    fast, gain = f.decode(lines), f.gain
    f.gain = float("inf")
    slow = f.decode(lines)
    f.gain = gain
    assert all((a is None and (b is None or not b.any())) or (a == b).all() for a, b in zip(fast, slow))


def test_only_words_around_suspicious_ones_are_decoded(monkeypatch):
    f, seen = pii.trained(), []
    inner = f._viterbi
    monkeypatch.setattr(f, "_viterbi", lambda row, left, right, starts, sizes, *more: (seen.append(int(sizes.sum())), inner(row, left, right, starts, sizes, *more))[1])
    held = pii.labelled_table(120, seed=9)
    lines = [["plain", "words"] * 400 + w + ["Other", "ones,"] * 400 for w, _ in held] + [[], ["plain"] * 50]
    fast = f.decode(lines)
    assert sum(seen) < 60 * len(lines)
    monkeypatch.setattr(f, "gain", float("inf"))
    slow = f.decode(lines)
    assert sum(y is not None for y in fast) > 60 and all((a is None and b is None) or (a == b).all() for a, b in zip(fast, slow))
    odd = ["a", "A", "Ab", "aB", "ÄB", "äß", "Ab,", ",ab", "ab:", ":", "at", "AT.", "(at)", "x" * 19, "x" * 20, "f" * 20, "f" * 20 + ",", "µ", "a1", "a@b", "÷", "×", "ñandú!", "日本", "$$$", "key", "API", "", "ſ", "İ"]
    for w in odd:
        assert pii.features(pii.stand_in(w)) == pii.features(w) and pii.context(pii.stand_in(w)) == pii.context(w), w


def test_pii_table(spark, sf, odd, none):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in d.collect()}
    for r in pii.found(d).collect():
        b = plain_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in b).encode()).hexdigest() and r.n_card == sum(k == "card" for k, _, _ in b)
        assert {f"{k}:{a}:{z}" for k, a, z in b} <= set(r.spans.split(","))
    got = {r.doc_id: r for r in pii.found(odd).collect()}
    assert got[1].spans == "" and got[7].spans == "email:8:14" and pii.found(none).count() == 0


# --- 7 embeddings ------------------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 32))
    v = [(i, (base[i % 12] + rng.standard_normal(32) * rng.choice([0.02, 0.2, 0.35, 0.6])).astype(np.float32).tolist(), int(i % 2)) for i in range(260)]
    v += [(1000 + i, v[7][1], 1) for i in range(30)] + [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, v[7][1], None), (2004, [1.0] * 8, 1), (2005, [None] * 32, 1), (2006, [], 1)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "n": F.lit(2), "root": F.lit("x")})
    good = [(i, np.array(e, float), la) for i, e, la in v if la is not None and e and not any(x is None or x != x for x in e) and any(e)]
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b)) if len(a) == len(b) else 0
    n, vec = Counter(), {i: (e, la) for i, e, la in good}
    linked = lambda a, b: a in vec and b in vec and vec[a][1] == vec[b][1] and cos(vec[a][0], vec[b][0]) >= 0.93
    for i in vec:
        n[i] = sum(linked(i, j) for j in vec if j != i)
    comp = plain_components(sorted(i for i, _, _ in v), linked)
    for chunk in (8, 1024):
        got = {r.vec_id: r for r in embeddings.embedding_groups(d, chunk=chunk).collect()}
        assert {i: r.n_links for i, r in got.items()} == {i: n[i] for i, _, _ in v}
        assert {i: r.component_id for i, r in got.items()} == comp and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embeddings.embedding_groups(d.where("false")).count() == 0


# --- 8 quality ---------------------------------------------------------------------------------------------------------------------------


def plain_model(words, order):
    """Interpolated modified Kneser-Ney by the book, over dictionaries."""
    c = Counter()
    for w, k in words.items():
        g, _ = quality.grams([w.encode()], order)
        for x in g.tolist():
            c[x] += k
    levels = []
    for k in range(order, 0, -1):
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        d = []
        for i in (1, 2, 3):
            try:
                x = i - (i + 1) * (n[0] / (n[0] + 2 * n[1])) * n[i] / n[i - 1]
            except ZeroDivisionError:
                x = -1
            d.append(x if 0.05 <= x <= i - 0.05 else i * 0.5)
        total, kept = Counter(), Counter()
        for g, v in c.items():
            total[g >> 8] += v
            kept[g >> 8] += d[min(v, 3) - 1]
        levels.append((k, dict(c), d, total, kept))
        c = Counter(g & ((1 << 8 * (k - 1)) - 1) for g in c)

    def p(g):
        out, weight = 0.0, 1.0
        for k, c, d, total, kept in levels:
            x = g & ((1 << 8 * k) - 1)
            if x in c:
                out += weight * (c[x] - d[min(c[x], 3) - 1]) / total[x >> 8]
            if x >> 8 in total:
                weight *= kept[x >> 8] / total[x >> 8]
        return out + weight / quality.VOCABULARY

    return p


def test_model_equals_the_book(spark):
    words = Counter("the then there this that over under other mother the the a an and hand".split())
    d = spark.createDataFrame([("en", " ".join(words.elements()))], "lang string, text string")
    m = quality.Model.of(quality.estimates(quality.gram_counts(d)).toArrow())
    p = plain_model(words, quality.ORDER)
    g, _ = quality.grams([x.encode() for x in ("the", "thing", "zebra", "o", "ÄÖ😀")])
    assert np.allclose(np.exp(m.log_p("en", g)), [p(x) for x in g.tolist()])
    # All next symbols of a history together have probability one.
    every = (int(g[2]) >> 8 << 8) + np.arange(quality.VOCABULARY)
    assert abs(np.exp(m.log_p("en", every)).sum() - 1) < 1e-9


def test_quality_paths_agree_and_separate(spark, sf):
    d, la = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one, two = ({(r.doc_id, r.row): r for r in quality.scored(d, la, bound=n).collect()} for n in (quality.BROADCAST_BYTES, 0))
    assert set(one) == set(two) and all(abs(one[k].perplexity - two[k].perplexity) < 1e-6 * one[k].perplexity and one[k].kept == two[k].kept and one[k].n == two[k].n for k in one)
    kept = {k[0]: r.kept for k, r in one.items()}
    clean = [r.doc_id for r in la.where("quality = 1 and toxic = 0").collect()]
    assert sum(kept[i] for i in clean) >= 0.99 * len(clean)
    text = {r.doc_id: r.text or "" for r in d.collect()}
    junk = [i for i, t in text.items() if "!! " in t or "$$$ " in t]
    assert junk and sum(kept[i] for i in junk) <= 0.1 * len(junk)


def test_quality_odd(spark, odd, none):
    la = spark.createDataFrame([(4, 1, 0), (8, 1, None), (6, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(odd, la).collect()
    assert len(got) == odd.count() and all(r.kept for r in got if r.n == 0)
    assert quality.scored(none, la).count() == 0
    bare = quality.scored(odd, la.where("false")).collect()
    assert len(bare) == odd.count() and all(r.kept for r in bare)


def test_quality_rejects_toxic_documents(spark):
    rng = random.Random(4)
    bad = ["rotter", "blighter", "wretch", "scoundrel"]
    some = lambda: " ".join(rng.choice(["the", "river", "over", "stone", "and", "under", "walks", "light"]) for _ in range(rng.randint(30, 80)))
    rows = [(i, f"{some()} {rng.choice(bad).title()}, {some()} {rng.choice(bad)}!" if i % 8 == 0 else some(), "en") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    la = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    for bound in (quality.BROADCAST_BYTES, 0):
        kept = {r.doc_id: r.kept for r in quality.scored(d, la, bound=bound).collect()}
        assert not any(kept[i] for i in kept if i % 8 == 0) and all(kept[i] for i in kept if i % 8)


def test_quality_of_repeated_rows(spark, odd):
    la = spark.createDataFrame([(4, 1, 0), (8, 1, None), (6, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    one, two = (sorted((str(r.doc_id), str(r.lang), r.row, r.n, round(r.perplexity, 6), r.kept) for r in quality.scored(odd, la, bound=n).collect()) for n in (quality.BROADCAST_BYTES, 0))
    assert one == two and len(one) == odd.count()


# --- 1 substrings ------------------------------------------------------------------------------------------------------------------------


def plain_windows(v, t):
    out = []

    def split(a, b):
        if b - a + 1 >= t:
            c = a + int(np.argmin(v[a : b + 1]))
            out.append((c, a, b))
            split(a, c - 1)
            split(c + 1, b)

    split(0, len(v) - 1)
    return sorted(out)


def test_compact_windows():
    rng = np.random.default_rng(0)
    for n in (0, 1, 45, 46, 47, 300):
        for high in (3, 1 << 20):
            for t in (1, 2, 21, 46):
                v = rng.integers(0, high, n).astype(np.uint64) << np.uint64(40)
                want = sorted((s, c) for c, left, right in plain_windows(v, t) for s in range(max(left, c - t + 1), min(c, right - t + 1) + 1))
                assert list(enumerate(substring.compact_windows(v, t).tolist())) == want


def test_word_hashes():
    texts = ["a b  a\tä\n", "", " ", "x" * 3000 + " a", "ab a b"]
    h, start = substring.word_hashes("\n".join(texts).encode())
    words = "\n".join(texts).encode().split()
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words)) and all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))
    many = [f"w{i}".encode() for i in range(200_000)]
    assert len(set(substring.word_hashes(b" ".join(many))[0].tolist())) == len(many)


def test_repeated_passages(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(20_000)}"
    some = lambda n: [word() for _ in range(n)]
    shared, near, line = some(60), some(120), some(12)
    edited = list(near)
    edited[50], edited[100] = "zz", "yy"
    docs = {i: some(rng.randint(60, 400)) for i in range(40)}
    for i in (1, 2, 3, 4):
        docs[i][20:20] = shared
    docs[5][10:10], docs[6][5:5] = near, edited
    for i in range(7, 37):
        docs[i][rng.randrange(30) : 0] = line  # too short to count
    docs[38] = list(docs[37])
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(50, None), (51, ""), (52, "short"), (53, "short")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"cls": F.lit("x"), "key": F.lit(1), "low": F.lit(2)})
    got = substring.repeated(d).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in got}
    linked = plain_components(sorted({x for p in pairs for x in p}), lambda a, b: frozenset((a, b)) in pairs)
    assert len({linked[i] for i in (1, 2, 3, 4)}) == 1 and linked[5] == linked[6] and linked[37] == linked[38]
    assert set(linked) == {1, 2, 3, 4, 5, 6, 37, 38}
    for r in got:
        a, b = docs[r.doc_id][r.start : r.end], docs[r.other_id][r.other_start : r.other_end]
        sh = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert min(len(a), len(b)) >= 50 and len(sh(a) & sh(b)) / len(sh(a) | sh(b)) >= 0.8 - 1e-9
    spans = {r.doc_id: (r.start, r.end) for r in got if r.doc_id in (1, 2, 3, 4)}
    assert all(s <= 20 and e >= 80 for s, e in spans.values())


def connected(rows):
    """The components of the texts that passages() finds in pairs, all compared with all."""
    ids = sorted(rows)
    return plain_components(ids, lambda a, b: bool(substring.passages(rows[a].encode(), rows[b].encode())))


def groups_found(spark, rows, **how):
    d = spark.createDataFrame([(i, t) for i, t in rows.items()], "doc_id long, text string")
    pairs = {(r.doc_id, r.other_id) for r in substring.repeated(d, **how).collect()}
    return plain_components(sorted(rows), lambda a, b: (a, b) in pairs or (b, a) in pairs)


def test_repeated_with_words_put_in_and_left_out(spark):
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    rows = {}
    for i in range(150):
        whole = some(rng.choice([50, 60, 70, 76, 110]))
        other = list(whole)
        for at in (len(whole) // 2,) if len(whole) < 100 else (len(whole) // 3, 2 * len(whole) // 3):
            other[at : at + i % 2] = [] if i % 2 else ["zz"]
        for k, w in enumerate((whole, other)):
            rows[2 * i + k] = " ".join(some(20) + w + some(20))
    near = [i for i in range(150) if substring.passages(rows[2 * i].encode(), rows[2 * i + 1].encode())]
    got = groups_found(spark, rows)
    assert len(near) >= 100 and sum(got[2 * i] == got[2 * i + 1] for i in near) >= 0.97 * len(near)


def test_repeated_in_large_groups(spark):
    rng = random.Random(12)
    some = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    line, rows = some(45), {}
    for _ in range(60):
        whole = line + some(35)
        for other in (whole, whole[:50] + ["zz"] + whole[50:]):
            rows[len(rows)] = " ".join(some(20) + other + some(20))
    want = connected(rows)
    assert len(set(want.values())) == 60
    for chunk in (16, 256):
        got = groups_found(spark, rows, chunk=chunk)
        assert sum(got[i] == got[i + 1] for i in range(0, 120, 2)) >= 58 and all(want[i] == want[got[i]] for i in got)


def test_form_letters_end_without_pairs(spark):
    rng = random.Random(13)
    some = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    top, end = some(15), some(15)
    rows = {i: " ".join(top + some(25) + end) for i in range(1000)}
    line = some(44)
    rows |= {1000 + i: " ".join(some(20) + line + some(20)) for i in range(700)}
    rows[2000] = rows[1] + " and one more"
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {(r.doc_id, r.other_id) for r in substring.repeated(d).collect()} in ({(1, 2000)}, {(2000, 1)})


def test_no_run_is_missed():
    """Passages of the least similarity share a run of least_run shingles; edits at random and evenly spaced ones, which leave the shortest runs."""
    rng = random.Random(14)
    t, shortest, near = 46, substring.least_run(46, 5, 0.8), 0
    for k in range(1500):
        n = rng.choice([50, 51, 60, 95, 100, 140, 230])
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b, e = list(a), rng.randint(1, 1 + n // 45)
        for i in sorted((round((x + 1) * n / (e + 1)) for x in range(e)) if k % 2 else rng.sample(range(n), e), reverse=True):
            b[i : i + rng.choice([0, 1])] = [] if rng.random() < 0.3 else ["zz"] * rng.choice([1, 1, 2])
        if substring.passages(" ".join(a).encode(), " ".join(b).encode()):
            near += 1
            own = {tuple(a[i : i + shortest + 4]) for i in range(len(a) - shortest - 3)}
            assert any(tuple(b[i : i + shortest + 4]) in own for i in range(len(b) - shortest - 3))
    assert near > 500


def test_repeated_equals_brute_force(spark):
    """Every two texts with a passage in common are connected, families of copies of copies and hot lines among them."""
    rng = random.Random(15)
    some = lambda n: [f"w{rng.randrange(30_000)}" for _ in range(n)]
    line, rows = some(30), {}
    for _ in range(24):
        kept = some(rng.choice([55, 90, 160]))
        for _ in range(rng.randint(1, 9)):
            for at in rng.sample(range(len(kept)), rng.randint(0, max(1, len(kept) // 40))):
                kept = [*kept[:at], *(["zz"] if rng.random() < 0.5 else []), *kept[at + rng.randint(0, 1) :]]
            rows[len(rows)] = " ".join(some(rng.randint(0, 30)) + kept + (line if rng.random() < 0.5 else []) + some(rng.randint(0, 30)))
    rows |= {len(rows) + i: " ".join(line * rng.randint(1, 4) + some(60)) for i in range(40)}
    want = connected(rows)
    for chunk in (8, 256):
        assert groups_found(spark, rows, chunk=chunk) == want


def test_repeated_odd(odd, none):
    got = substring.repeated(odd).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(5, 4)} and substring.repeated(none).count() == 0


# --- the pipeline ------------------------------------------------------------------------------------------------------------------------


def test_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name, f in p.STAGES:
        out = common.cut(f(spark, docs, sf))
        assert out.columns[: len(docs.columns)] == docs.columns
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before and after
        if name == "quality":
            assert before - after == {r.doc_id for r in quality.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("not kept").collect()}
        if name == "near_duplicates":
            text = {r.doc_id: r.text or "" for r in docs.collect()}
            fp, sh = {i: plain_fingerprint(x) for i, x in text.items()}, {i: set(zip(*(w[k:] for k in range(5)))) or ({tuple(w)} if w else set()) for i, x in text.items() for w in [x.lower().split()]}
            alike = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3 or bool(sh[a] | sh[b]) and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])
            assert after == set(plain_components(sorted(text), alike).values()) and out.count() == len(after)
        if name == "decontamination":
            assert before - after == {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        if name == "sharding":
            assert after == before and out.count() == docs.count()
        docs = out


def test_decontamination_stage_takes_rows_not_ids(spark, sf):
    import corpus_pipeline as p

    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) > 20").first().text
    rows = [(None, item), (None, "a clean text without any id at all"), (1, "before " + item), (1, "another clean text of the same id"), (2, "a third text")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in p.drop_contaminated(spark, d, sf).collect()}
    assert got == {r for r in rows if item not in r[1]}


def test_sharding_of_repeated_rows(spark):
    d = spark.createDataFrame([(7, "x" * 99)] * 1000 + [(i, "y" * 99) for i in range(1000)], "doc_id long, text string")
    for out in (sharding.sharded(d), sharding.assign(d)):
        load, places = Counter(), defaultdict(list)
        for r in out.collect():
            load[r.shard] += r.size
            places[r.shard].append(getattr(r, "slot", None))
        assert len(load) == 16 and sum(load.values()) == 200_000 and max(load.values()) <= 1.02 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in (lambda g: [[r.slot for r in g if r.shard == k] for k in range(16)])(sharding.sharded(d).collect()))


def test_slot_map_is_stored_by_the_operator(spark, tmp_path):
    d = spark.createDataFrame([(i, "y" * (i % 50)) for i in range(500)], "doc_id long, text string")
    got = {r.virtual_slot: (r.shard, r.map_version) for r in sharding.sharded(d, path=str(tmp_path / "m")).collect()}
    m = sharding.SlotMap.load(spark, str(tmp_path / "m"))
    assert all((m.shard_of[k], m.version) == v for k, v in got.items())


def test_mixing_of_repeated_rows(spark):
    d = spark.createDataFrame([(None, "a b c", "s")] * 500 + [(1, "a b c", "s")] * 300 + [(i, "w " * (i % 40), "t") for i in range(200)], "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == 1000 and sum(r.doc_id is None for r in got) == 500 and all(0 <= r.taken <= 2 * r.size for r in got)
    for s, rows in (("s", [r for r in got if r.doc_id in (None,)]), ("t", [r for r in got if r.doc_id is not None and r.doc_id > 1])):
        assert rows
    target = {r.source_size: r.target for r in got}
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
    assert all(abs(taken[k] - target[k]) <= 1 for k in target)
    assert mixing.mixed(d).count() == sum(round(r.taken / r.size) if r.size else 1 for r in got)


def test_near_copies_go(spark, sf):
    import corpus_pipeline as p

    rng = random.Random(16)
    some = lambda n: [f"w{rng.randrange(50_000)}" for _ in range(n)]
    rows, near = [], 0
    for k in range(40):
        a = some(rng.randint(60, 300))
        rows.append((10 * k, " ".join(a)))
        for i in range(1, 4):
            b = list(a)
            for at in rng.sample(range(len(b)), max(1, len(b) // 60)):
                b[at] = "zz"
            rows.append((10 * k + i, " ".join(b)))
    d = spark.createDataFrame([*rows, (None, "no id"), (None, None)], "doc_id long, text string")
    got = [r.doc_id for r in p.drop_near_duplicates(spark, d, sf).collect()]
    assert sorted(i for i in got if i is not None) == [10 * k for k in range(40)] and got.count(None) == 2


def test_stages_with_clashing_names(spark, sf):
    import corpus_pipeline as p

    names = ["_row", "_size", "_s", "_d", "_e", "_copies", "_n", "doc", "id", "row", "i", "r", "d", "s", "n", "c", "copies", "rows", "times", "pd"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumns({c: F.lit(f"own {c}") for c in names})
    for _, f in p.STAGES:
        out = f(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns and all(all(r[c] == f"own {c}" for c in names) for r in out.collect())


def test_stages_odd(spark, sf, odd, none):
    import corpus_pipeline as p

    for d in (odd, none):
        for _, f in p.STAGES:
            assert set(d.columns) <= set(f(spark, d, sf).columns)
            assert f(spark, d, sf).count() <= 2 * d.count()


def test_chat_roles_as_they_are(spark, duck):
    """The query's layout keeps every role; names of the other layout are not taken for the three, and null is empty."""
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (1, 2, "assistant", "c"), (2, 0, None, "d"), (2, 1, "assistant", None), (3, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.formatted(chat.canonical(chat.by_turn(df)))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c in (1, 2, 3):
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256, got[c].loss_chars) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), sha(loss), len(loss))
