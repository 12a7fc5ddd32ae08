"""Conversations as one string with turn marks, and back.

Everything is Spark expressions: turn structs are collected and sorted, adjacent
turns of one role are merged by array functions, and the parts are concatenated.
The sorted array is cut where the role changes; a fold that appends to the runs
would copy them at every turn. What is folded are the running sums that place
the spans under the loss. Control strings inside roles and texts are escaped by backslashes
after their first character, one more than they already have, which undoes
exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template.
START, TEXT, AGAIN, END = "<|start|>", "<|text|>", "<|again|>", "<|end|>"
TRAINED_ROLE = "assistant"
# Code points of a block from which spans are read.
CUT = 4096
# What counts as a control string: any <|name|>, and the marks of common chat templates.
_REST = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>|/?INST\])"
_PLAIN = r"([<\[])(\\*+)" + _REST
_ESCAPED = r"([<\[])\\(\\*+)" + _REST


def escape(text: Column) -> Column:
    """``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``, and so on."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Undoes ``escape``."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body or its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums up to each place of an array of longs, by doubled strides: n log n steps, no array grows by appending."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    strides = F.transform(F.sequence(F.lit(0), rounds), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    add = lambda sums, stride: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - stride), F.lit(0)))
    return F.aggregate(strides, values, add)


def merged_runs(turns: Column) -> Column:
    """Runs ``role, texts`` of adjacent turns of one role; texts are escaped. Each turn is copied once."""
    changed = lambda i: F.coalesce(F.get(turns, i)["role"] != F.get(turns, i - 1)["role"], F.lit(True))
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), changed)

    def runs_from(at: Column) -> Column:
        def run(first: Column, k: Column) -> Column:
            length = F.coalesce(F.get(at, k + 1), F.size(turns)) - first
            texts = F.transform(F.slice(turns, first + 1, length), lambda t: escape(t["text"]))
            return F.struct(F.get(turns, first)["role"].alias("role"), texts.alias("texts"))

        return F.transform(at, run)

    return _let(starts, runs_from)


def format_conversations(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of rows ``conv_id, turn, role, text``.

    Turns are ordered by turn, then role, then text; a null turn comes first. A
    null role or text counts as empty, rows with a null ``conv_id`` are one
    conversation, repeated rows are repeated turns, other columns are not read.
    An empty table gives an empty one.

    ``formatted``: for each run of turns of a role ``<|start|>role<|text|>text``,
    further texts of the run after ``<|again|>``, then ``<|end|>``.
    ``loss_spans``: where texts of ``trained_role`` lie in it, as first code point
    and number of code points. The whole conversation is one row, so a
    conversation must fit a task's memory; the time grows with its turns and
    characters, but for a logarithm.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    merged = _let(F.col("turns"), merged_runs)
    # Parts of the string in order; those under the loss are marked.
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def parts_of(r: Column) -> Column:
        trained = r["role"] == F.lit(trained_role)
        texts = F.transform(
            r["texts"],
            lambda t, k: F.array(
                part(F.when(k > 0, F.lit(AGAIN)).otherwise(F.concat(F.lit(START), escape(r["role"]), F.lit(TEXT))), F.lit(False)),
                part(t, trained),
            ),
        )
        return F.concat(F.flatten(texts), F.array(part(F.lit(END), F.lit(False))))

    parts = gathered.select("conv_id", F.flatten(F.transform(merged, parts_of)).alias("parts"))

    def spans_of(ps: Column) -> Column:
        lengths = F.transform(ps, lambda p: F.length(p["text"]).cast("long"))
        ends = running_sums(lengths)
        laid = F.zip_with(
            ps, ends, lambda p, end: F.struct((end - F.length(p["text"])).alias("start"), F.length(p["text"]).cast("long").alias("length"), p["loss"].alias("loss"))
        )
        return F.transform(F.filter(laid, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    return parts.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"),
        _let(F.col("parts"), spans_of).alias("loss_spans"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns in a formatted string: array of ``role, text``, unescaped, unmerged."""
    runs = F.filter(F.split(formatted, F.lit(r"<\|start\|>"), -1), lambda r: r != "")

    def turns_of(r: Column) -> Column:
        sides = F.split(F.regexp_replace(r, r"<\|end\|>$", ""), F.lit(r"<\|text\|>"), -1)
        return _let(sides, lambda s: _let(unescape(s[0]), lambda role: texts_of(role, s[1])))

    def texts_of(role: Column, texts: Column) -> Column:
        each = F.split(texts, F.lit(r"<\|again\|>"), -1)
        return F.transform(each, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns_of))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order.

    The string is cut once into blocks of CUT code points, so a span is read from
    the blocks it touches and not from the beginning of the string.
    """

    def cut(blocks: Column) -> Column:
        def text_of(s: Column) -> Column:
            first = F.floor(s["start"] / CUT).cast("int")
            last = F.floor((s["start"] + s["length"]) / CUT).cast("int")
            around = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return unescape(F.substring(around, (s["start"] % CUT).cast("int") + 1, s["length"].cast("int")))

        return F.array_join(F.transform(spans, text_of), "")

    return _let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), cut)
