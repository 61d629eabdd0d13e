r"""Chat formatting with typed content parts and a reversible template, in DataFrame operations only.

A message is (conv_id, turn, role, parts); a part is (kind, text, ref, units, children), where kind
is ``text``, ``image``, ``audio`` or ``document``. The visitor walks the parts in order. Text goes into
the turn's text; any other part leaves a placeholder ``<|kind:k|>`` with its number in the conversation,
an attachment record (turn, number, kind, ref) and the number of tokens it will expand to. A document
part is followed by its children, which are parts without children of their own.

A conversation becomes one string of turns ``<|turn|>role\ntext<|end|>``. Inside texts and roles the
escape character and every character that a control string can begin with are replaced, so nothing a
user writes can look like template: ``\`` becomes ``\b``, ``<`` becomes ``\l``, ``[`` becomes ``\s``
(and in roles a line end ``\n``). All of it is undone by ``plain``. Spans of (start, length), counted
in code points from 0, mark the text of the assistant's turns: the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"

PART = "struct<kind:string,text:string,ref:string,units:int"
PARTS = f"array<{PART},children:array<{PART}>>>>"

#: Tokens that one unit of a part expands to: a tile of an image, a second of audio, a page.
EXPANSION = {"image": 256, "audio": 25, "document": 512}


def escaped(text: Column) -> Column:
    for plain_form, code in (("\\", "\\b"), ("<", "\\l"), ("[", "\\s")):
        text = F.replace(text, F.lit(plain_form), F.lit(code))
    return text


def plain(text: Column) -> Column:
    for plain_form, code in (("[", "\\s"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain_form))
    return text


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _plain_role(role: Column) -> Column:
    return plain(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _visited(parts: Column) -> Column:
    """Parts in reading order: each part, then its children. Null parts are left out."""

    def leaf(p: Column) -> Column:
        return F.struct(*[p[n].alias(n) for n in ("kind", "text", "ref", "units")])

    some = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    below = lambda p: F.transform(F.filter(F.coalesce(p["children"], F.array().cast(f"array<{PART}>>")), lambda c: c.isNotNull()), leaf)
    return F.flatten(F.transform(some, lambda p: F.concat(F.array(leaf(p)), below(p))))


def text_parts(text: Column) -> Column:
    """The parts of a message that is one text."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units"),
            F.array().cast(f"array<{PART}>>").alias("children"),
        )
    )


def _attached(parts: Column) -> Column:
    return F.filter(parts, lambda p: F.coalesce(p["kind"], F.lit("text")) != "text")


def format_conversations(messages: DataFrame, loss_role: str = "assistant", expansion: dict[str, int] | None = None) -> DataFrame:
    """(conv_id, turn, role, parts) -> conv_id, formatted, spans, attachments, n_turns, expanded_tokens.

    Turns stand in the order of (turn, role, texts), so ties and repeated rows have a fixed place.
    Null roles and texts are empty; a null conv_id is a conversation of its own; a kind that
    ``expansion`` does not list expands to one token a unit, missing units count 1. No rows, no conversations.
    One conversation is one row of the result, so its size is bounded by what a row can hold.
    """
    rates = F.create_map(*[F.lit(x) for pair in (expansion or EXPANSION).items() for x in pair])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    flat = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), _visited(F.col("parts")).alias("parts"))
    numbered = flat.withColumn("base", F.coalesce(F.sum(F.size(_attached(F.col("parts")))).over(earlier), F.lit(0))).withColumn("at", F.row_number().over(order))

    def piece(p: Column, i: Column) -> Column:
        number = F.col("base") + F.size(_attached(F.slice("parts", F.lit(1), i))) + 1
        return F.when(F.coalesce(p["kind"], F.lit("text")) == "text", escaped(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), escaped(p["kind"]), F.lit(":"), number.cast("string"), F.lit("|>"))
        )

    def record(p: Column) -> Column:
        tokens = F.coalesce(p["units"], F.lit(1)).cast("long") * F.coalesce(rates[p["kind"]], F.lit(1))
        return F.struct(F.col("turn").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), tokens.alias("tokens"))

    written = numbered.select(
        "conv_id", "at",
        F.concat(F.lit(TURN), _escaped_role(F.col("role")), F.lit("\n")).alias("head"),
        F.array_join(F.transform("parts", piece), "").alias("body"),
        (F.col("role") == loss_role).alias("loss"),
        F.transform(_attached(F.col("parts")), record).alias("attached"),
    )
    placed = written.withColumn(
        "start", F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    )
    turns = placed.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), "loss", F.struct("start", F.length("body").alias("length")).alias("span"), "attached"))
        ).alias("turns")
    )
    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["span"]).alias("spans"),
        attachments.alias("attachments"),
        F.size("turns").alias("n_turns"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans) -> conv_id, turns (role, text), loss_text, formatted_chars, undone from the string alone.

    Placeholders of attachments stay in the texts.
    """
    pieces = F.split("formatted", END.replace("|", "\\|"), -1)
    chunks = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda s: F.substring(s, F.lit(len(TURN) + 1), F.length(s)))
    loss = F.array_join(F.transform("spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["length"])), "")
    return formatted.withColumn("__chunks", chunks).select(
        "conv_id",
        F.transform(
            "__chunks",
            lambda s: F.struct(
                _plain_role(F.substring_index(s, "\n", 1)).alias("role"),
                plain(F.substring(s, F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s))).alias("text"),
            ),
        ).alias("turns"),
        plain(loss).alias("loss_text"),
        F.length("formatted").alias("formatted_chars"),
    )
