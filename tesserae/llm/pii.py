"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss.

The field labels the words of a line with the parts of e-mail addresses written out, telephone numbers without a plus, secrets and
national numbers. It is trained here by maximum likelihood from a small labelled table, and decoded by Viterbi over batches of lines
in numpy. Its spans are added to those of the patterns, which always stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import in_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "national_id")

# The patterns of the base kinds. Possessive repeats and look-behinds only spare retries that cannot match.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """For each @ the longest local part before it and domain after it; the leftmost match of the pattern starts there."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start; code points, end exclusive."""
    out = list(_emails(text)) if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdecimal, m[0])) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- the field ---------------------------------------------------------------------------------------------------------------

FOUND = ("email", "phone", "secret", "national_id")
LABELS = ("O", *(f"{x}-{k}" for k in FOUND for x in "BI"))
# Words whose presence is a feature of its own.
CUES = frozenset("at dot tel phone call fax mobile token key secret password passwd pwd api ssn id = : (at) [at] (dot) [dot]".split())


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    """Letters as x or X, hex-like runs as h, digits as 9, runs shortened to one sign with a coarse length."""
    core = word.strip("\"'.,;:!?#$%&*<>")
    if len(core) >= 20 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core) or len(core) >= 24 and re.fullmatch(r"[A-Za-z0-9_/+-]+", core) and re.search("[0-9]", core) and re.search("[A-Za-z]", core):
        return "KEY"
    s = re.sub(r"[a-zß-öø-ÿ]+", "x", re.sub(r"[A-ZÀ-ÖØ-Þ]+", "X", core))
    s = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 8)}", s)
    return s[:12]


@lru_cache(maxsize=200_000)
def features(word: str) -> tuple[str, ...]:
    low = word.strip("\"'.,;!?#$%&*<>").lower()
    digits = sum(map(str.isdecimal, word))
    out = [f"s={shape(word)}", f"d={min(digits, 8)}"]
    if low in CUES:
        out.append(f"w={low}")
    if "@" in word:
        out.append("has@")
    if not digits and word.isalpha():
        out.append("alpha")
    return tuple(out)


@lru_cache(maxsize=200_000)
def context(word: str) -> str:
    """What a word says to its neighbours."""
    low = word.strip("\"'.,;!?#$%&*<>").lower()
    return f"w={low}" if low in CUES else f"s={shape(word)}"


_EDGE = "\"'.,;!?#$%&*<>"
_LOWER, _UPPER = "".join(map(chr, (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)))), "".join(map(chr, (*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF))))


def stand_in(word: str) -> str:
    """A word with the same features and context: one for all words of letters of a case, with or without signs around them, that are no cues."""
    core = word.strip(_EDGE)
    if 0 < len(core) < 20 and core.lower() not in CUES:
        like = "zz" if not core.strip(_LOWER) else "ZZ" if not core.strip(_UPPER) else "Zz" if core[0] in _UPPER and not core[1:].strip(_LOWER) else ""
        if like:
            return like if core == word else like + ","
    return word


def labelled_table(rows: int = 300, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: lines of words with their labels, made from templates with a fixed seed."""
    rng = random.Random(seed)
    syllables = "an er th in on the de la en ch re ou und der que ción mente ble ly ing".split()

    def filler() -> str:
        if rng.random() < 0.12:
            return rng.choice(["at", "at", "at.", "At", "dot", "id", "key", "call", "|", "token"])
        w = "".join(rng.choices(syllables, k=rng.randint(1, 4)))
        w = w.capitalize() if rng.random() < 0.15 else w.upper() + "!!" if rng.random() < 0.04 else w
        return w + rng.choice(["", "", "", "", ",", ".", "$$$", "###", "&&&", "%%%"] if rng.random() < 0.3 else [""])

    def digits(n: int) -> str:
        return "".join(rng.choices("0123456789", k=n))

    def name() -> str:
        return "".join(rng.choices(syllables, k=2))

    def email() -> list[str]:
        sep, dot = rng.choice([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]")])
        return [name(), *([dot, name()] if rng.random() < 0.2 else []), sep, name(), dot, rng.choice(["com", "org", "net", "de"])]

    def phone() -> list[str]:
        return rng.choice([[f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"{digits(3)}.{digits(3)}.{digits(4)}"], [f"0{digits(3)}", digits(3), digits(4)], [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"]])

    def secret() -> list[str]:
        key = "".join(rng.choices("0123456789abcdef", k=rng.choice([32, 40, 64])))
        key = rng.choice([key, "sk_" + "".join(rng.choices("ABCDEFGHJKabcdefghjk0123456789", k=28))])
        return [rng.choice([f'"{key}"', key, f"{key}###"])]

    def number() -> list[str]:
        return [f"{digits(3)}-{digits(2)}-{digits(4)}"]

    def plain() -> list[str]:
        return [rng.choice([digits(rng.randint(1, 4)), digits(16), f"{digits(2)}.{digits(2)}", f"{digits(1)}.", f"{digits(2)}:{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(3)}.{digits(2)}.{digits(1)}.{digits(3)}", f"{name()}.{digits(2)}@mail.example.com", "at", "dot", "key", "=", "|", f"v{digits(1)}.{digits(2)}"])]

    cues = {"phone": ["tel", "call", "phone:"], "secret": ["token =", "key =", "api key :", "password ="], "national_id": ["ssn", "id"], "email": []}
    makers = {"email": email, "phone": phone, "secret": secret, "national_id": number}
    out = []
    for _ in range(rows):
        words, tags = [], []
        for _ in range(rng.randint(1, 3)):
            for w in (filler() for _ in range(rng.randint(2, 9))):
                words.append(w)
                tags.append("O")
            if (kind := rng.choice([*FOUND, "plain", "plain", "none"])) == "plain":
                got, marks = plain(), ["O"]
            elif kind == "none":
                continue
            else:
                if cues[kind] and rng.random() < 0.5:
                    cue = rng.choice(cues[kind]).split()
                    words += cue
                    tags += ["O"] * len(cue)
                got = makers[kind]()
                marks = [f"B-{kind}"] + [f"I-{kind}"] * (len(got) - 1)
            words += got
            tags += marks
        out.append((words, tags))
    return out


class _Codes(dict):
    """Word to its row of emission scores and its context number, in one integer; filled on first use."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:  # bounded
            self.clear()
        like = stand_in(word)
        code = self[word] = self.field.code(word) if like == word else self[like]
        return code


class Field:
    """Weights of own features, of both neighbours' context, and of transitions."""

    def __init__(self, index: dict[str, int], around: dict[str, int], own: np.ndarray, before: np.ndarray, after: np.ndarray, move: np.ndarray):
        self.index, self.around, self.own, self.before, self.after, self.move = index, around, own, before, after, move
        self.codes = _Codes(self)
        self.rows: list[np.ndarray] = []
        self.row_of: dict[tuple[str, ...], int] = {}
        self.table = np.zeros((0, len(LABELS)))
        # What a segment of other labels can gain per word from transitions: over O, into and out of it, or within it. Words that favour O by more
        # than that, all in all, are no such segment.
        self.gain = max(0.0, float(move[0, 1:].max() + move[1:, 0].max() - 2 * move[0, 0]), float(move[1:, 1:].max() - move[0, 0]), float(move[0, 1:].max() - move[0, 0]))

    def code(self, word: str) -> int:
        f = features(word)
        if f not in self.row_of:
            self.row_of[f] = len(self.rows)
            self.rows.append(self.own[[self.index[x] for x in f if x in self.index]].sum(0))
        return self.row_of[f] * len(self.before) + self.around.get(context(word), 0)

    def decode(self, lines: list[list[str]]) -> list[np.ndarray | None]:
        """The best labels of each line (numbers into LABELS), None for O throughout; runs of words that may have others, in batches of like length."""
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        code = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(lines)), np.int64, int(sizes.sum()))
        if len(self.table) < len(self.rows):
            self.table = np.stack(self.rows)
        row, ctx = np.divmod(code, len(self.before))
        starts = np.cumsum(sizes) - sizes
        left, right = np.zeros_like(ctx), np.zeros_like(ctx)
        left[1:], right[:-1] = ctx[:-1], ctx[1:]
        full = sizes > 0
        left[starts[full]], right[(starts + sizes - 1)[full]] = 0, 0
        lead = (lambda t: t[:, 0] - t[:, 1:].max(1))
        margin = lead(self.table)[row] + lead(self.before)[left] + lead(self.after)[right]
        at_start = np.zeros(len(code) + 1, bool)  # where a line begins, and behind the last
        at_start[starts[full]] = at_start[-1] = True
        # Sums of what words fall short of favouring O, from each line's begin; a word may have another label if some segment around it has a
        # sum that is not negative. Lines lie apart by more than their sums, so one pass finds the lowest before and the highest behind each word.
        short = min(self.gain, 1e6) - margin
        sums, line = np.cumsum(short), np.repeat(np.arange(len(lines)), sizes)
        base = np.zeros(len(lines))
        base[full] = (sums - short)[starts[full]]
        sums -= base[line]
        apart = line * (2 * np.abs(np.append(sums, sums - short)).max(initial=0.0) + 1)
        opened = np.append(np.maximum.accumulate((sums - apart)[::-1])[::-1] - np.minimum.accumulate(sums - short - apart) >= -1e-4, False)
        first, last = opened.copy(), opened[:-1] & (~opened[1:] | at_start[1:])
        first[1:] &= ~opened[:-1] | at_start[1:]
        begin, end = np.flatnonzero(first), np.flatnonzero(last)
        out: list[np.ndarray | None] = [None] * len(lines)
        sizes_of, closed = end - begin + 1, ~at_start[end + 1]
        order = np.argsort(sizes_of, kind="stable")
        labels, i = np.zeros(len(code), np.int8), 0
        while i < len(order):
            most = min(8 + 1.3 * sizes_of[order[i]], 1e9)
            j = int(np.searchsorted(sizes_of[order], most, "right"))
            j = max(i + 1, min(j, i + int(120_000 // max(1, sizes_of[order[max(i, j - 1)]]))))
            batch = order[i:j]
            for a, y in zip(begin[batch], self._viterbi(row, left, right, begin[batch], sizes_of[batch], closed[batch])):
                labels[a : a + len(y)] = y
            i = j
        for k in np.unique(np.searchsorted(starts, np.flatnonzero(labels), "right") - 1):
            out[k] = labels[starts[k] : starts[k] + sizes[k]]
        return out

    def _viterbi(self, row: np.ndarray, left: np.ndarray, right: np.ndarray, starts: np.ndarray, sizes: np.ndarray, closed: np.ndarray) -> list[np.ndarray]:
        """The best labels of runs of words behind an O; closed ones have an O behind them, too."""
        n, top, labels = len(sizes), int(sizes.max()), len(LABELS)
        at = starts[None] + np.minimum(np.arange(top)[:, None], sizes[None] - 1)
        score = self.table[row[at[0]]] + self.before[left[at[0]]] + self.after[right[at[0]]] + self.move[0]
        back = np.zeros((top, n, labels), np.int8)
        turned = np.ascontiguousarray(self.move.T)
        for t in range(1, top):
            step = score[:, None, :] + turned[None]
            back[t] = step.argmax(2)
            new = step.max(2) + self.table[row[at[t]]] + self.before[left[at[t]]] + self.after[right[at[t]]]
            score = np.where((t < sizes)[:, None], new, score)
        y = np.zeros((top, n), np.int8)
        best = (score + closed[:, None] * self.move[:, 0]).argmax(1)
        for t in range(top - 1, -1, -1):
            y[t] = best
            if t:
                best = np.where(t < sizes, back[t, np.arange(n), best], best)
        return [y[: sizes[k], k] for k in range(n)]


def train(table: list[tuple[list[str], list[str]]], steps: int = 90, rate: float = 0.25, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps (Adam); the expected counts come from the forward-backward recursions over all lines at once."""
    index = {f: i for i, f in enumerate(sorted({f for w, _ in table for x in w for f in features(x)}))}
    around = {f: i for i, f in enumerate(sorted({context(x) for w, _ in table for x in w}), 1)}  # 0: none or unknown
    n, top, labels = len(table), max(len(w) for w, _ in table), len(LABELS)
    number = {x: i for i, x in enumerate(LABELS)}
    x = np.zeros((n, top, len(index)), np.float32)
    ctx = np.zeros((n, top + 2), np.int64)
    y, live = np.zeros((n, top), np.int64), np.zeros((n, top), bool)
    for i, (words, tags) in enumerate(table):
        for t, (w, tag) in enumerate(zip(words, tags)):
            x[i, t, [index[f] for f in features(w)]] = 1
            ctx[i, t + 1], y[i, t], live[i, t] = around[context(w)], number[tag], True
    flat, who = x[live], np.flatnonzero(live.ravel())
    prev, nxt = ctx[:, :-2][live], ctx[:, 2:][live]
    gold = np.eye(labels)[y[live]]
    size, m = len(index), len(around) + 1
    w = np.zeros(size * labels + 2 * m * labels + labels * labels)
    mom, var = np.zeros_like(w), np.zeros_like(w)

    def views(v: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = size * labels, m * labels
        return v[:a].reshape(size, labels), v[a : a + b].reshape(m, labels), v[a + b : a + 2 * b].reshape(m, labels), v[a + 2 * b :].reshape(labels, labels)

    pairs = np.zeros((labels, labels))
    for i, (words, _) in enumerate(table):
        np.add.at(pairs, (np.concatenate([[0], y[i, : len(words) - 1]]), y[i, : len(words)]), 1)

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        high = a.max(axis, keepdims=True)
        return (high + np.log(np.exp(a - high).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        own, before, after, move = views(w)
        e = np.zeros((n * top, labels))
        e[who] = flat @ own + before[prev] + after[nxt]
        e = e.reshape(n, top, labels)
        f, b = np.zeros((n, top, labels)), np.zeros((n, top, labels))
        f[:, 0] = move[0] + e[:, 0]
        for t in range(1, top):
            f[:, t] = np.where(live[:, t, None], lse(f[:, t - 1, :, None] + move[None], 1) + e[:, t], f[:, t - 1])
        for t in range(top - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], lse(move[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), b[:, t + 1])
        z = lse(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None])[live]
        expect = np.zeros((labels, labels))
        expect[0] += np.exp(f[:, 0] + b[:, 0] - z[:, None]).sum(0)
        for t in range(1, top):
            k = live[:, t]
            if k.any():
                expect += np.exp(f[k, t - 1, :, None] + move[None] + (e[k, t] + b[k, t])[:, None, :] - z[k, None, None]).sum(0)
        diff = gold - p
        g = np.zeros_like(w)
        g_own, g_before, g_after, g_move = views(g)
        g_own += flat.T @ diff
        np.add.at(g_before, prev, diff)
        np.add.at(g_after, nxt, diff)
        g_move += pairs - expect
        g = g / n - ridge * w
        mom, var = 0.9 * mom + 0.1 * g, 0.99 * var + 0.01 * g * g
        w = w + rate * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return Field(index, around, *(v.copy() for v in views(w)))


def field_spans(field: Field, text: str) -> list[Span]:
    """Spans that the field finds, by start; outer punctuation of a span's first and last word is left out."""
    lines, starts, at = [], [], 0
    for line in text.split("\n"):
        lines.append(line.split())
        starts.append((at, line))
        at += len(line) + 1
    out: list[Span] = []
    for words, (start, line), y in zip(lines, starts, field.decode(lines)):
        if y is not None and y.any():
            out += _read(line, start, y)
    return out


#: What makes an address of words an address.
_WRITTEN = re.compile(r"\W?at\W?\s+\S+\s+\W?dot\W?\s")


def _read(line: str, start: int, y: np.ndarray) -> Iterator[Span]:
    where = [m.span() for m in re.finditer(r"\S+", line)]
    i = 0
    while i < len(y):
        if not y[i]:
            i += 1
            continue
        kind, j = FOUND[(int(y[i]) - 1) // 2], i + 1
        while j < len(y) and y[j] and y[j] % 2 == 0 and FOUND[(int(y[j]) - 1) // 2] == kind:
            j += 1
        a, b = where[i][0], where[j - 1][1]
        while a < b and not (line[a].isalnum() or line[a] in "(+["):
            a += 1
        while b > a and not (line[b - 1].isalnum()):
            b -= 1
        if b > a and (kind != "email" or _WRITTEN.search(line, a, b)):
            yield kind, start + a, start + b
        i = j


@lru_cache(maxsize=1)
def trained() -> Field:
    return train(labelled_table())


def all_spans(field: Field, text: str, base: list[Span] | None = None) -> list[Span]:
    """The base spans and those of the field that overlap none of them, by kind, then start."""
    return merged(base_spans(text) if base is None else base, field_spans(field, text))


def merged(base: list[Span], more: list[Span]) -> list[Span]:
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    far = np.maximum.accumulate([b for _, b in taken]) if taken else []
    extra = []
    for k, a, b in more:
        i = int(np.searchsorted(starts, b)) - 1  # the last that starts before b
        if i < 0 or far[i] <= a:
            extra.append((k, a, b))
    return sorted([*base, *extra], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the base spans, `spans` lists all: kind:start:end, by kind, then start, joined by commas. Null
    text counts as empty and has no spans. Whole texts are read. Other columns are not read; repeated rows stay.
    """
    own = trained()
    weights = docs.sparkSession.sparkContext.broadcast((own.index, own.around, own.own, own.before, own.after, own.move))  # a few thousand numbers
    made: dict[str, Field] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = made.get("f") or made.setdefault("f", Field(*weights.value))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            lines, of = [], []
            for i, t in enumerate(texts):
                at = 0
                for line in t.split("\n"):
                    lines.append(line)
                    of.append((i, at))
                    at += len(line) + 1
            more: list[list[Span]] = [[] for _ in texts]
            for k in range(0, len(lines), 4096):
                some = lines[k : k + 4096]
                for line, (i, at), y in zip(some, of[k : k + 4096], field.decode([x.split() for x in some])):
                    if y is not None and y.any():
                        more[i] += _read(line, at, y)
            n = [[sum(s[0] == kind for s in x) for x in base] for kind in BASE]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(merged(x, m)) for x, m in zip(base, more)], pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
