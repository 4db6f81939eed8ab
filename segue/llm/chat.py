"""Chat formatting from event logs, with DataFrame functions only.

An event has a conversation, a sequence number, the message it is about, a kind and a text:

* `message`     begins the message (its role is the event's role);
* `delta`       appends its text to the message;
* `edit`        replaces the message's text so far;
* `regenerate`  replaces the message's text and drops later messages that began before it.

Events of one conversation are partitioned together, sorted by (seq, kind, text), and folded
into final messages in the order in which they began. Rendered form of one message, where
`\\` escapes:  <|turn|>ROLE\\nTEXT<|end|>\\n

Escaping doubles each backslash, then puts a backslash behind the first character of each
control string (of this template and of other common ones), so no control string of a text
survives; removing one backslash before any character undoes it. In roles, a line end also
gets a backslash. The loss mask holds the place of each assistant text in the output.

Defined results: null text and null role count as empty; a null conversation id is a
conversation of its own; a null seq sorts first; repeated rows are repeated events; unknown
kinds count as `message`; a delta or edit of a message never begun begins it; other columns are not read,
so none can clash; an empty table gives an empty table; a message may be of any length that a string may have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEGIN, END = "<|turn|>", "<|end|>\n"
#: Control strings of this and other public templates.
CONTROLS = ["<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(c: Column) -> Column:
    """No control string is left in the result; `unescape` undoes it."""
    rest: dict[str, list[str]] = {}
    for s in CONTROLS:
        rest.setdefault(s[0], []).append("\\Q" + s[1:] + "\\E")
    broken = "|".join(f"(?<=\\Q{a}\\E)(?={'|'.join(x)})" for a, x in rest.items())
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), broken, r"\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg_order, role, text) of events (conv_id, seq, msg_id, kind, role, text)."""
    own = W.partitionBy("conv_id", "msg_id")
    in_order = W.partitionBy("conv_id").orderBy("seq", "kind", "text", "role")
    e = events.select("conv_id", "msg_id", "role", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "seq")
    e = e.withColumn("__at", F.row_number().over(in_order))
    starts = (F.col("kind") != "delta")
    # When a message began, and the last event that set its text anew: the fold begins there.
    e = e.withColumn("__born", F.min("__at").over(own)).withColumn("__base", F.max(F.when(starts, F.col("__at"))).over(own)).withColumn("role", F.min_by("role", "__at").over(own))
    # A regeneration of a message born at b drops messages born after b but before it: seen from a message's birth, one of the
    # regenerations still to come is of a message born before. The running minimum from the end tells so.
    to_come = W.partitionBy("conv_id").orderBy(F.desc("__at")).rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("__again", F.min(F.when(F.col("kind") == "regenerate", F.col("__born"))).over(to_come))
    e = e.withColumn("__gone", F.max(F.when(F.col("__at") == F.col("__born"), F.col("__again") < F.col("__born"))).over(own))
    e = e.filter(~F.coalesce("__gone", F.lit(False)))
    e = e.filter(F.coalesce(F.col("__at") >= F.col("__base"), F.lit(True)))
    return (
        e.groupBy("conv_id", "msg_id")
        .agg(
            F.min("__born").alias("msg_order"),
            F.min("role").alias("role"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "text"))), lambda x: x["text"]), "").alias("text"),
        )
        .select("conv_id", "msg_order", F.coalesce("role", F.lit("")).alias("role"), "text")
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of struct start, length; in code points)."""
    w = W.partitionBy("conv_id").orderBy("msg_order")
    m = messages.withColumn("__role", F.regexp_replace(escape(F.col("role")), "\n", "\\\\\n")).withColumn("__text", escape(F.col("text")))
    m = m.withColumn("__head", F.concat(F.lit(BEGIN), "__role", F.lit("\n"))).withColumn("__turn", F.concat("__head", "__text", F.lit(END)))
    m = m.withColumn("__from", (F.sum(F.length("__turn").cast("long")).over(w) - F.length("__turn") + F.length("__head")))
    loss = F.when(F.col("role") == "assistant", F.struct(F.col("__from").alias("start"), F.length("__text").cast("long").alias("length")))
    g = m.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_order", "__turn"))), lambda x: x["__turn"]), "").alias("formatted"),
        F.array_sort(F.collect_list(loss)).alias("loss_mask"),
    )
    return g


def parse(rendered: DataFrame) -> DataFrame:
    """The turns read back from the output: conv_id, at, role, text, loss_text (what the mask covers of a turn, unescaped; null if nothing)."""
    cut = F.split("formatted", "\\Q" + END + "\\E", -1)
    turn = (
        rendered.select("conv_id", "loss_mask", F.posexplode(F.slice(cut, F.lit(1), F.size(cut) - 1)).alias("at", "__turn"))
        .withColumn("__size", F.length("__turn").cast("long") + len(END))
        .withColumn("__from", F.sum("__size").over(W.partitionBy("conv_id").orderBy("at")) - F.col("__size"))
    )
    body = F.substring(F.col("__turn"), len(BEGIN) + 1, F.length("__turn"))
    head = F.regexp_extract(body, r"(?s)\A((?:[^\\\n]|\\.)*+)\n", 1)
    turn = turn.withColumn("__head", head).withColumn("role", unescape(head))
    text = F.substring(body, F.length("__head") + 2, F.length("__turn"))
    # A mask entry belongs to the turn in which it starts: spans never cross turns. Sorted spans, so the
    # one at or after the turn's start is found by its place among the assistant turns so far.
    n = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(W.partitionBy("conv_id").orderBy("at"))
    turn = turn.withColumn("__n", n).withColumn("text", unescape(text))
    span = F.get(F.col("loss_mask"), F.col("__n") - 1)
    inside = (F.col("__n") > 0) & (span["start"] >= F.col("__from")) & (span["start"] < F.col("__from") + F.col("__size"))
    loss = F.when(inside, unescape(F.substring(F.col("__turn"), (span["start"] - F.col("__from") + 1).cast("int"), span["length"].cast("int"))))
    return turn.select("conv_id", "at", "role", "text", loss.alias("loss_text"))


def format_events(events: DataFrame) -> DataFrame:
    return render(fold(events))
