r"""Chat formatting from event logs, in DataFrame expressions only.

A log holds events of conversations: ``message`` (a text begins), ``delta`` (it goes on), ``edit`` (it is replaced) and
``regenerate`` (it is thrown away and begins anew). Each conversation's events are folded, in the order of their sequence number, into
final messages, which are rendered as ``<|im_start|>role\ntext<|im_end|>\n``. Backslashes and ``<|`` inside roles and
texts, and line ends inside roles, are escaped reversibly, so a text that spells a control string can't end or
begin a turn. The loss mask holds the places (code points, end exclusive) of assistant texts in the output.

Events of a message are gathered per message and messages per conversation: the result is one string per conversation, so a
task holds a conversation, never more. A conversation's deltas are first joined per message.

Nulls: a null text counts as empty, a null role as the empty role, a null kind as ``message``; a null conversation id is a
conversation of its own; events with a null sequence number come first. Ties: events with one sequence number are taken
in the order of message id, kind (message, regenerate, edit, delta), role and text. Repeated rows: a second ``message`` event of a message id begins a further message,
other repeated events apply again. A message of no ``message`` event takes its first event's role. An empty table gives an empty table.
Further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
KINDS = ("message", "regenerate", "edit", "delta")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(parts, "\\")


def fold(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, message_id, kind, role, text) -> conv_id, messages: array of (seq, role, text), as the log leaves them."""
    kind = F.coalesce("kind", F.lit("message"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind), F.lit(len(KINDS)))
    event = F.struct("seq", rank.cast("int").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    per_message = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("log"))
    # Positions at which a text begins anew; a message event also begins a further message.
    begins = lambda log, test: F.filter(F.sequence(F.lit(1), F.size(log)), lambda k: (k == 1) | test(F.element_at(log, k)["kind"]))
    heads = begins(F.col("log"), lambda kind: kind == 1)
    bounds = F.transform(heads, lambda h, n: F.struct(h.alias("a"), F.coalesce(F.get(heads, n + 1), F.size("log") + 1).alias("b")))
    runs = F.transform(bounds, lambda x: F.slice("log", x["a"], x["b"] - x["a"]))

    def final(run: Column) -> Column:
        last = F.array_max(begins(run, lambda kind: kind < 4))
        texts = F.transform(F.slice(run, last, F.size(run) - last + 1), lambda e: F.when(e["kind"] == 2, F.lit("")).otherwise(e["text"]))
        first = F.element_at(run, 1)
        return F.struct(first["seq"].alias("seq"), F.col("message_id").alias("message_id"), first["role"].alias("role"), F.array_join(texts, "").alias("text"))

    messages = per_message.select("conv_id", F.transform(runs, final).alias("messages"))
    return messages.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("messages"))).alias("messages"))


def render(folded: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask (array of start, end) of each conversation."""
    parts = F.transform("messages", lambda m: F.struct(F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")).alias("head"), escape(m["text"]).alias("body"), (m["role"] == "assistant").alias("loss")))
    held = folded.select("conv_id", parts.alias("parts"))
    tail = len(END)
    places = F.aggregate(
        F.transform("parts", lambda p: F.struct(F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"), p["loss"].alias("loss"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda s, p: F.struct(
            (s["at"] + p["h"] + p["b"] + tail).alias("at"),
            F.when(p["loss"], F.concat(s["out"], F.array(F.struct((s["at"] + p["h"]).alias("start"), (s["at"] + p["h"] + p["b"]).alias("end"))))).otherwise(s["out"]).alias("out"),
        ),
    )["out"]
    return held.select("conv_id", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"), places.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """Role and text of every turn, read back from the output alone."""
    turns = F.slice(F.split(formatted, r"<\|im_end\|>\n", -1), F.lit(1), F.size(F.split(formatted, r"<\|im_end\|>\n", -1)) - 1)

    def turn(t: Column) -> Column:
        body = F.substring(t, len(START) + 1, 2**31 - 1)
        cut = F.locate("\n", body)
        return F.struct(unescape_role(body.substr(F.lit(1), cut - 1)).alias("role"), unescape(body.substr(cut + 1, F.length(body))).alias("text"))

    return F.transform(turns, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. The output is cut into turns once and each place is looked up in its own
    turn, so a conversation of many turns takes time in proportion to its length. Places come in order, one to a turn at most, as ``render`` makes them."""
    pieces = F.split(formatted, r"(?<=<\|im_end\|>\n)", -1)

    def step(s: Column, p: Column) -> Column:
        m = F.get(mask, s["k"])
        hit = m.isNotNull() & (m["start"] < s["at"] + F.length(p))
        return F.struct(
            (s["at"] + F.length(p)).alias("at"), (s["k"] + F.when(hit, 1).otherwise(0)).alias("k"),
            F.when(hit, F.concat(s["out"], F.array(unescape(p.substr(m["start"] - s["at"] + 1, m["end"] - m["start"]))))).otherwise(s["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(pieces, start, step)["out"], "")


def format_log(events: DataFrame) -> DataFrame:
    """Fold and render an event log."""
    return render(fold(events))
