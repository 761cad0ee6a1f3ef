r"""Relational chat formatting, in DataFrame expressions only.

A conversation becomes ``<|role>text</>``; adjacent turns of one role share a header and are parted by
``<+>``.  Inside texts and roles ``\`` becomes ``\b``, ``<`` becomes ``\l`` and ``>`` in a role ``\g``, so
every ``<`` of the output is a mark, and texts read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

END, JOIN, OPEN, CLOSE = "</>", "<+>", "<|", ">"
SPAN = "array<struct<start:bigint,stop:bigint>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(CLOSE))


def _between(role: Column, before: Column) -> Column:
    """What stands between two turns."""
    return F.when(role == before, F.lit(JOIN)).otherwise(F.concat(F.lit(END), _header(role)))


def _joined(parts: Column) -> Column:
    """Text and loss spans of parts (each: mark, body, spans in the body), one after the other."""

    def add(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.char_length(p["mark"])
        return F.struct((at + F.char_length(p["body"])).alias("at"), F.concat(acc["starts"], F.array(at)).alias("starts"))

    def moved(starts: Column) -> Column:
        """All spans, each moved by where its part's body starts; none is copied more than once."""
        place = lambda s, at: F.struct((s["start"] + at).alias("start"), (s["stop"] + at).alias("stop"))
        return F.flatten(F.transform(parts, lambda p, i: F.transform(p["spans"], lambda s: place(s, F.get(starts, i)))))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    text = F.array_join(F.flatten(F.transform(parts, lambda p: F.array(p["mark"], p["body"]))), "")
    return F.struct(text.alias("body"), let(F.aggregate(parts, zero, add)["starts"], moved).alias("spans"))


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
    chunk_turns: int = 256,
) -> DataFrame:
    """One row per conversation: ``conv_col``, formatted, loss_spans (start and stop code points of trained text).

    Turns are ordered by number, then role, then text, so ties have one order; repeated rows stay turns of
    their own.  A null text or role counts as empty, a null turn number comes first, and rows of a null
    conversation form one.  An empty table gives no rows; other columns are not read.
    A conversation is put together in two steps, by stretches of ``chunk_turns`` turn numbers and then from
    the stretches, so a long one is not gathered turn by turn in one task.
    """
    slim = turns.select(
        F.col(conv_col).alias("__conv"),
        F.floor(F.col(turn_col) / chunk_turns).alias("__chunk"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    no_spans = F.array().cast(SPAN)

    def stretch(t: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            body = escape(x["text"])
            mark = F.when(i == 0, F.lit("")).otherwise(_between(x["role"], F.get(t, i - 1)["role"]))
            span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.char_length(body).cast("long").alias("stop")))
            return F.struct(mark.alias("mark"), body.alias("body"), F.when(x["role"] == loss_role, span).otherwise(no_spans).alias("spans"))

        joined = let(F.transform(t, part), _joined)
        return let(joined, lambda j: F.struct(F.get(t, F.lit(0))["role"].alias("first"), F.element_at(t, -1)["role"].alias("last"), j["body"].alias("body"), j["spans"].alias("spans")))

    chunks = slim.groupBy("__conv", "__chunk").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("__conv", "__chunk", let(F.col("ts"), stretch).alias("c"))

    def whole(cs: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            mark = F.when(i == 0, _header(x["c"]["first"])).otherwise(_between(x["c"]["first"], F.get(cs, i - 1)["c"]["last"]))
            return F.struct(mark.alias("mark"), x["c"]["body"].alias("body"), x["c"]["spans"].alias("spans"))

        return let(F.transform(cs, part), _joined)

    gathered = chunks.groupBy("__conv").agg(F.sort_array(F.collect_list(F.struct("__chunk", "c"))).alias("cs"))
    return gathered.select(F.col("__conv").alias(conv_col), let(F.col("cs"), whole).alias("w")).select(
        conv_col, F.concat("w.body", F.lit(END)).alias("formatted"), F.col("w.spans").alias("loss_spans")
    )


def parse(formatted: Column) -> Column:
    """The turns that a formatted conversation holds, as an array of (role, text)."""

    def turns(run: Column) -> Column:
        head = F.substring_index(run, CLOSE, 1)
        role = unescape(F.replace(F.substr(head, F.lit(len(OPEN) + 1)), F.lit("\\g"), F.lit(">")))
        texts = F.split(F.substr(run, F.char_length(head) + 2), r"<\+>")
        return let(role, lambda r: F.transform(texts, lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))

    runs = F.filter(F.split(formatted, END), lambda x: x != "")
    return F.flatten(F.transform(runs, turns))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What reading a formatted conversation back gives: turn count and digests of all turns and of the trained text."""
    said = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
    read = formatted.select(conv_col, "formatted", parse(F.col("formatted")).alias("turns"), loss.alias("loss"))
    return read.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
