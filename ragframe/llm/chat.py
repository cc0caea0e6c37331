"""Chat formatting into budgeted windows, in DataFrame operations only.

Running sums of turn tokens cut a conversation into cells of ``STEP`` tokens. Turns that lie within one cell are one
window's new turns; a turn that crosses a border is a window of its own, so a window's new turns exceed the step only
where a single turn does. A window starts with the conversation's system turn and with the turns before it that fit in
``HISTORY`` tokens. Only new assistant texts are under the loss mask: repeated ones are masked.

Template: ``<|turn|>role`` line end, text, ``<|end|>`` line end. Control strings within texts, those of this template
and of the usual instruction templates, get a backslash after their first character; where backslashes stand there
already, one more. Taking one away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragframe.llm.common import WORD, saved

STEP, HISTORY = 1024, 512
# What the marks and the role of a turn count for.
MARK_TOKENS = 4

START, END = "<|turn|>", "<|end|>\n"
# first character, backslashes, rest of a control string
_RAW = r"([<\[])(\\*)(?=\||/?s>|/?INST\]|/?SYS>)"
_ESCAPED = r"([<\[])\\(\\*)(?=\||/?s>|/?INST\]|/?SYS>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def windows(turns: DataFrame) -> DataFrame:
    """Formatted windows of ``turns`` (conv_id, turn, role, text): conv_id, window, formatted, context, loss.

    ``context`` is the number of leading turns that repeat earlier ones or the system turn; ``loss`` has the places
    (start, length), in code points from 0, of the text to learn. Turns are ordered by turn (nulls first), then role
    and text; null roles and texts are empty. A null conv_id is a conversation of its own.
    """
    empty = F.lit("")
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text"), empty).alias("text"),
    )
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(WORD)) + MARK_TOKENS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    sofar = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"place": F.row_number().over(order), "end": sofar.cast("long")})
    begin, cell = F.col("end") - F.col("tokens"), F.expr(f"(end - 1) div {STEP}")
    crossing = F.expr(f"(end - tokens) div {STEP} <> (end - 1) div {STEP}")
    rows = rows.withColumns({"begin": begin, "group": 2 * cell + F.when(crossing, 0).otherwise(1)})
    place = Window.partitionBy("conv_id").orderBy("place")
    opens = F.coalesce(F.col("group") != F.lag("group").over(place), F.lit(True))
    rows = rows.withColumn("opens", opens.cast("long"))
    # windows that begin behind a turn, but so close that its tokens still fit in their history
    near = Window.partitionBy("conv_id").orderBy("begin").rangeBetween(1, HISTORY)
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumns(
        {
            "window": F.sum("opens").over(place.rowsBetween(Window.unboundedPreceding, 0)) - 1,
            "again": F.coalesce(F.sum("opens").over(near), F.lit(0)),
            "windows": F.sum("opens").over(whole),
        }
    )
    system = (F.col("place") == 1) & (F.col("role") == "system")
    repeats = F.when(system, F.col("windows") - 1).otherwise(F.col("again"))
    rows = rows.withColumn("later", F.explode(F.sequence(F.lit(0).cast("long"), repeats)))

    learnt = (F.col("role") == "assistant") & (F.col("later") == 0)
    body = escape(F.col("text"))
    piece = F.struct(
        "place",
        (F.col("later") > 0).alias("repeated"),
        F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n")).alias("head"),
        body.alias("body"),
        learnt.alias("learnt"),
    )
    packed = rows.groupBy("conv_id", (F.col("window") + F.col("later")).alias("window"))
    packed = packed.agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    texts = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    # running place of each turn's text
    spans = F.aggregate(
        F.slice(F.col("turns"), F.col("context") + 1, F.size("turns")),
        F.struct(
            F.aggregate(F.slice(texts, F.lit(1), F.col("context")), F.lit(0), lambda n, t: n + F.length(t)).alias("at"),
            F.array().cast("array<struct<start:int,length:int>>").alias("found"),
        ),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(
                t["learnt"],
                F.concat(
                    s["found"],
                    F.array(F.struct((s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))),
                ),
            )
            .otherwise(s["found"])
            .alias("found"),
        ),
    )
    packed = packed.withColumn("context", F.size(F.filter("turns", lambda t: t["repeated"])))
    return packed.select(
        "conv_id", "window", F.array_join(texts, "").alias("formatted"), "context", spans["found"].alias("loss")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation's new turns are one string for its digest, so it has to fit in a row.
    """
    turns = F.transform(
        F.slice(F.split("formatted", r"<\|turn\|>"), F.col("context") + 2, F.length("formatted")),
        lambda t: F.substring(t, F.lit(1), F.length(t) - len(END)),
    )
    told = F.transform(
        turns,
        lambda t: F.concat(
            _unescape_role(F.substring_index(t, "\n", 1)),
            F.lit("\n"),
            unescape(F.substring(t, F.instr(t, "\n") + 1, F.length(t))),
            F.lit("\n"),
        ),
    )
    learnt = F.transform(
        "loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
    )
    parts = formatted.select(
        "conv_id",
        F.struct("window", F.array_join(told, "").alias("told"), F.array_join(learnt, "").alias("learnt")).alias("w"),
        F.size(turns).alias("n"),
        F.length("formatted").alias("chars"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list("w")).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    told, learnt = F.array_join("w.told", ""), F.array_join("w.learnt", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """Write the windows of all conversations and read them back; see :func:`windows` and :func:`read_back`."""
    return read_back(saved(windows(turns), "chat-windows"))
