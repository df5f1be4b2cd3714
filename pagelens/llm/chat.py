r"""Chat formatting by DataFrame expressions.

A conversation's turns are collected as structs and sorted by (turn, role, text),
neighbours of the same role are merged into one block, and the blocks are joined:

    <|im_start|>ROLE\nTEXT<|im_sep|>TEXT<|im_end|>\n

Inside roles and texts, ``\`` is written ``\\`` and then ``<|`` is written ``<\|``,
so no control string can come from a text; a line feed in a role is written
``<|nl|>``. All of it is undone exactly by ``unescape``.

Defined results: null text and null role are empty; a null turn sorts first; rows
with equal (turn, role, text) are all kept; rows of a null conv_id form one
conversation; extra columns are not read; an empty table gives no rows. A conversation
is one row and so one task; its time grows with its turns to the power 1.5, by the sums
that place the mask. The loss mask holds a span for each
assistant text, so spans of merged turns don't touch the separator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, NL = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<start, length>> (code points, from 1)."""
    own = lambda c: escape(F.coalesce(F.col(c), F.lit("")))
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
            F.replace(own("role"), F.lit("\n"), F.lit(NL)).alias("r"),
            own("text").alias("t"),
        ).alias("x"),
    )
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    def pieces(xs: Column) -> Column:
        """Each turn's text, with what opens its block before it and what closes the block, or separates its texts, behind it."""

        def piece(x: Column, i: Column) -> Column:
            opens = F.coalesce(F.get(xs, i - 1)["r"] != x["r"], F.lit(True))
            closes = F.coalesce(F.get(xs, i + 1)["r"] != x["r"], F.lit(True))
            head = F.when(opens, F.concat(F.lit(START), x["r"], F.lit("\n"))).otherwise("")
            return F.struct(head.alias("head"), x["t"].alias("text"), F.when(closes, END + "\n").otherwise(SEP).alias("tail"), (x["role"] == "assistant").alias("loss"))

        return F.transform(xs, piece)

    size = lambda p: F.length(p["head"]) + F.length(p["text"]) + F.length(p["tail"])
    span = lambda p, before: F.struct((before + F.length(p["head"]) + 1).alias("start"), F.length(p["text"]).alias("length"), p["loss"].alias("loss"))
    spans = lambda before: F.transform("ps", lambda p, i: span(p, F.get(before, i)))
    own = turns.select("conv_id", _let(F.col("xs"), pieces).alias("ps"))
    mask = F.filter(_let(_sums_before(F.transform("ps", size)), spans), lambda s: s["loss"])
    return own.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["text"], p["tail"])), "").alias("formatted"),
        F.transform(mask, lambda s: F.struct(s["start"], s["length"])).alias("loss_mask"),
    )


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once; a lambda that named it would work it out for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sums_before(xs: Column) -> Column:
    """Sums of the elements before each one, by pieces of the square root of their number: a fold that grows an array copies it at every step."""
    begin = F.array(F.lit(0))
    fold = lambda ys: F.aggregate(ys, begin, lambda acc, y: F.concat(acc, F.array(F.element_at(acc, -1) + y)))

    def sums(xs: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), step), lambda at: fold(F.slice(xs, at, step)))
        return _let(parts, lambda ps: _let(fold(F.transform(ps, lambda p: F.element_at(p, -1))), lambda at: F.flatten(F.transform(ps, lambda p, i: F.transform(F.slice(p, 1, F.size(p) - 1), lambda v: v + F.get(at, i))))))

    return _let(xs, sums)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text: parsed from the formatted text and its mask alone."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda _, i: i > 0)

    def block(p: Column) -> Column:
        cut = F.instr(p, "\n")
        role = unescape(F.replace(F.substring(p, F.lit(1), cut - 1), F.lit(NL), F.lit("\n")))
        body = F.substring(p, cut + 1, F.length(p) - cut - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(parts, block)).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
