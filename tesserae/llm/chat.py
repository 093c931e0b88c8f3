"""Chat formatting: records of different layouts to canonical turns, turns to one training text with a loss mask.

A record's layout is recognised by its fingerprint, a hash over the sorted paths of its nested fields that hold a value. Each
known fingerprint selects a declarative mapping to turns of (role, text). All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _list(items: str, role: str, text: str) -> Column:
    return F.transform(F.col(items), lambda m: F.struct(m[role].alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def _roles(turns: Column) -> Column:
    """The layout of `from` and `value` has other names for the roles."""
    names = F.create_map(*(F.lit(x) for pair in {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}.items() for x in pair))
    return F.transform(turns, lambda t: F.struct(F.coalesce(names[t["role"]], t["role"]).alias("role"), t["text"].alias("text")))


@dataclass(frozen=True)
class Layout:
    """Paths that must hold a value, paths that may, and the turns made of those that do."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: Callable[[frozenset[str]], Column]


def _before(system: str, have: frozenset[str], turns: Column) -> Column:
    return F.concat(F.array(_turn("system", F.col(system))), turns) if system in have else turns


def _instruction(have: frozenset[str]) -> Column:
    ask = F.concat_ws("\n\n", *(F.col(c) for c in ("instruction", "input") if c in have))
    return _before("system", have, F.array(_turn("user", ask), _turn("assistant", F.col("output"))))


def _prompt(answer: str) -> Callable[[frozenset[str]], Column]:
    return lambda have: _before("system", have, F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col(answer))))


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), ("system",), lambda have: _before("system", have, _list("messages", "role", "content"))),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("system",), lambda have: _before("system", have, _roles(_list("conversations", "from", "value")))),
    Layout("turns", ("turns[].role", "turns[].text"), (), lambda have: _list("turns", "role", "text")),
    Layout("instruction", ("instruction", "output"), ("input", "system"), _instruction),
    Layout("prompt_response", ("prompt", "response"), ("system",), _prompt("response")),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), _prompt("completion")),
    Layout("question_answer", ("question", "answer"), (), lambda have: F.array(_turn("user", F.col("question")), _turn("assistant", F.col("answer")))),
)
KNOWN = frozenset(p for x in LAYOUTS for p in (*x.needs, *x.may))


def fingerprint_of(paths: frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def leaf_paths(schema: T.StructType) -> dict[str, Column]:
    """Known paths of text fields in the schema, each with whether it holds a value: a text that is not null, a list of which an element has
    the field, or a list without elements."""
    out = {}
    has = lambda field: lambda x: x[field].isNotNull()
    for f in schema:
        own = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out[f.name] = own.isNotNull()
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            for g in f.dataType.elementType:
                if isinstance(g.dataType, T.StringType):
                    out[f"{f.name}[].{g.name}"] = (F.size(own) == 0) | F.exists(own, has(g.name))
    return {p: c for p, c in out.items() if p in KNOWN}


def _free(df: DataFrame, name: str) -> str:
    """A column's name that df does not have, whatever the case."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def canonical(records: DataFrame) -> DataFrame:
    """records with fingerprint, layout and turns (role, text).

    A list without elements holds a value; null does not, and neither do fields that no element of a list has. Null texts count as empty. Records that match no layout, or hold
    known fields of two, get a null layout and null turns. Columns that no layout names are ignored and kept, but for those
    named fingerprint, layout or turns (unless `turns` is itself a layout's list), which are replaced.
    """
    paths = leaf_paths(records.schema)
    if not paths:
        return records.withColumns({"fingerprint": F.lit(fingerprint_of(frozenset())), "layout": F.lit(None).cast("string"), "turns": F.lit(None).cast(TURNS)})
    held = F.filter(F.array(*(F.when(paths[p], F.lit(p)) for p in sorted(paths))), lambda x: x.isNotNull())
    fp = F.substring(F.sha2(F.array_join(held, "\n"), 256), 1, 16)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    mark, named, made = (_free(records, x) for x in ("_fingerprint", "_layout", "_turns"))
    for x in LAYOUTS:
        if not set(x.needs) <= set(paths):
            continue
        may = [p for p in x.may if p in paths]
        for n in range(len(may) + 1):
            for extra in combinations(may, n):
                have = frozenset((*x.needs, *extra))
                hit = F.col(mark) == fingerprint_of(have)
                layout, turns = F.when(hit, F.lit(x.name)).otherwise(layout), F.when(hit, x.turns(have).cast(TURNS)).otherwise(turns)
    out = records.withColumn(mark, fp).withColumn(named, layout).withColumn(made, turns)
    return out.drop("fingerprint", "layout", "turns").withColumnsRenamed({mark: "fingerprint", named: "layout", made: "turns"})


def escape(text: Column) -> Column:
    r"""`<`, any backslashes, `|` get one backslash more, so that no control string is left inside; `unescape` takes it out."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role: Column) -> Column:
    """A role is one line: percent sign and newline are written as %25 and %0A."""
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(conversations: DataFrame, turns: str = "turns", learn: str = "assistant") -> DataFrame:
    """Adds formatted (one text) and loss_spans (start, end in code points of it): the texts of the role to learn.

    Each turn is START, role, newline, escaped text, END. Null turns give the empty text and no spans.
    """
    t = F.coalesce(F.col(turns), F.array().cast(TURNS))
    marked = F.transform(t, lambda x: F.struct(F.concat(F.lit(START), _role(x["role"]), F.lit("\n")).alias("head"), escape(F.coalesce(x["text"], F.lit(""))).alias("body"), F.coalesce(x["role"] == learn, F.lit(False)).alias("loss")))
    held = _free(conversations, "_marked")
    d = conversations.withColumn(held, marked)
    d = d.withColumn("formatted", F.array_join(F.transform(held, lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["head"])
        end = start + F.char_length(x["body"])
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(x["loss"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return d.withColumn("loss_spans", F.aggregate(held, begin, step)["spans"]).drop(held)


def parsed(text: Column) -> Column:
    """The turns read back from a formatted text."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        return F.struct(_unrole(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescape(F.substr(p, F.char_length(head) + 2)).alias("text"))

    return F.transform(pieces, turn)


def learnt(text: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order, joined by nothing."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"]))), "")


def by_turn(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) to one row per conv_id with messages, ordered by turn, then role and text.

    Null text counts as empty; a null turn comes first; rows of a null conv_id are one conversation; repeated rows stay.
    """
    one = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    g = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("m"))
    return g.select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def digest(chats: DataFrame) -> DataFrame:
    """Per conversation what the formatted text says when it is read back."""
    d = chats.withColumns({"_t": parsed(F.col("formatted")), "_loss": learnt(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("_t").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
