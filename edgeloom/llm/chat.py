"""Chat formatting with typed content parts, and its reading.

A message's parts (``kind, text, ref, size``) are visited in order: text is escaped; an image, audio or
document part becomes the placeholder of its kind, and its reference and expanded token count go into the
list of attachments, in placeholder order. Messages of one conversation, ordered by turn, make one string:

    <<SYS>>system<</SYS>>[INST]user[/INST]<s>assistant</s><<ROLE>>other role<<TEXT>>its text<</ROLE>>

Inside texts and roles, a backslash becomes ``\\b`` and every control string gets ``\\.`` behind its first
character, so no control string of the output comes from a text, and reading is exact: ``read_chats`` gives the
texts, ``read_parts`` the typed parts. The loss mask is a list of spans (start and length in code points) over the
assistants' escaped texts.

Defined results: a null text is empty, a null role is the empty role, a null kind is text, an unknown kind
counts as a document; rows with equal turns are ordered by role and text, repeated rows are all kept; an
empty table gives no rows; a null ``conv_id`` is a conversation of its own; a text of any length is formatted whole,
a conversation being one value; other columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
CONTROLS = (*(m for pair in MARKS.values() for m in pair), *OTHER, *PLACEHOLDERS.values())
CLOSERS = (*(close for _, close in MARKS.values()), OTHER[2])
PARTS = "array<struct<kind:string,text:string,ref:string,size:long>>"
#: Tokens that a part expands to: size in pixels, milliseconds or pages, by tokens for so many of them.
EXPANSION = {"image": (1, 784), "audio": (25, 1000), "document": (500, 1)}
_BREAK = "([<\\[])(?=(?:" + "|".join(c[1:].replace("[", "\\[").replace("]", "\\]") for c in CONTROLS) + "))"


def escape(text: Column) -> Column:
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.regexp_replace(safe, _BREAK, r"$1\\.")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\."), F.lit("")), F.lit("\\b"), F.lit("\\"))


def _kind(part: Column) -> Column:
    known = F.coalesce(part["kind"], F.lit("text"))
    return F.when(known.isin("text", *PLACEHOLDERS), known).otherwise("document")


def flatten(parts: Column) -> tuple[Column, Column]:
    """The visitor: a message's flat text, and its attachments ``(kind, ref, tokens)``."""
    def visit(part: Column) -> Column:
        shown = escape(part["text"])
        for kind, mark in PLACEHOLDERS.items():
            shown = F.when(_kind(part) == kind, mark).otherwise(shown)
        return shown

    def attach(part: Column) -> Column:
        tokens = F.lit(0).cast("long")
        for kind, (n, per) in EXPANSION.items():
            many = F.ceil(F.coalesce(part["size"], F.lit(0)) * n / per)
            tokens = F.when(_kind(part) == kind, F.greatest(F.lit(1), many)).otherwise(tokens)
        return F.struct(_kind(part).alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))

    parts = F.coalesce(parts, F.array().cast(PARTS))
    return F.array_join(F.transform(parts, visit), ""), F.transform(F.filter(parts, lambda p: _kind(p) != "text"), attach)


def text_part(text: Column) -> Column:
    """A message's parts where it has only a text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("long").alias("size")))


def format_chats(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans, attachments`` from ``messages(conv_id, turn, role, parts)``."""
    flat, attached = flatten(F.col("parts"))
    role = F.coalesce("role", F.lit(""))
    opener, closer = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (start, end) in MARKS.items():
        opener, closer = F.when(role == name, start).otherwise(opener), F.when(role == name, end).otherwise(closer)
    rows = messages.select("conv_id", "turn", role.alias("role"), flat.alias("flat"), attached.alias("attached"), opener.alias("opener"), closer.alias("closer"))
    size = F.length("opener") + F.length("flat") + F.length("closer")
    # a conversation is one output value, so its rows must meet, once: window and groups share the exchange
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "flat").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(in_order), F.lit(0)))
    turn = F.struct("turn", "role", "flat", "at", "attached", "opener", "closer")
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def span(t: Column) -> Column:
        return F.struct((t["at"] + F.length(t["opener"])).alias("start"), F.length(t["flat"]).cast("long").alias("length"))

    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["opener"], t["flat"], t["closer"])), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), span).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"),
    )


def read_chats(chats: DataFrame, typed: bool = False) -> DataFrame:
    """A row a turn from formatted chats; ``loss``: the mask has a span over exactly its text.

    ``typed`` also gives the text before it is unescaped, and the conversation's attachments.
    """
    closers = "|".join(c.replace("[", "\\[").replace("]", "\\]") for c in CLOSERS)
    size = F.length("formatted").cast("long").alias("formatted_chars")
    pieces = chats.select("conv_id", "loss_spans", *(["attachments"] if typed else []), size, F.posexplode(F.split("formatted", closers)).alias("turn_no", "piece"))
    pieces = pieces.where(F.col("piece") != "")  # what follows the last closer
    named = F.substring_index(F.substr("piece", F.lit(len(OTHER[0]) + 1)), OTHER[1], 1)
    role, opener, closer = unescape(named), F.length(named) + len(OTHER[0] + OTHER[1]), F.lit(len(OTHER[2]))
    for name, (start, end) in MARKS.items():
        has = F.startswith("piece", F.lit(start))
        role, opener, closer = (F.when(has, F.lit(x)).otherwise(y) for x, y in ((name, role), (len(start), opener), (len(end), closer)))
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    turns = pieces.select("*", role.alias("role"), opener.alias("opener"), (F.length("piece") + closer).alias("size"))
    turns = turns.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    turns = turns.withColumn("flat", F.substr("piece", F.col("opener") + 1))
    flat = F.col("flat")
    span = F.struct((F.col("at") + F.col("opener")).alias("start"), F.length(flat).cast("long").alias("length"))
    # the mask's spans are in order: an assistant's is that of its number
    so_far = Window.partitionBy("conv_id").orderBy("turn_no")
    number = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(so_far).cast("int")
    loss = F.coalesce((F.col("role") == "assistant") & (F.get("loss_spans", number - 1) == span), F.lit(False))
    return turns.select("conv_id", "formatted_chars", "turn_no", "role", unescape(flat).alias("text"), loss.alias("loss"), *(["flat", "attachments"] if typed else []))


def read_parts(chats: DataFrame) -> DataFrame:
    """``conv_id, turn_no, role, parts`` from formatted chats and their attachments: the typed parts of every turn.

    A part is ``(kind, text, ref, tokens)``. Neighbouring text parts come back as one, empty ones not at all; placeholders
    that a text spells out are text.
    """
    turns = read_chats(chats, typed=True)
    marks = "|".join(PLACEHOLDERS.values())
    texts, found = F.split("flat", marks, -1), F.regexp_count("flat", F.lit(marks))
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumns({"texts": texts, "found": found}).withColumn("first", F.coalesce(F.sum("found").over(before), F.lit(0)).cast("int"))

    def around(i: Column) -> Column:
        said, attached = F.get("texts", i), F.get("attachments", F.col("first") + i)
        text = F.struct(F.lit("text").alias("kind"), unescape(said).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))
        other = F.struct(attached["kind"].alias("kind"), F.lit(None).cast("string").alias("text"), attached["ref"].alias("ref"), attached["tokens"].alias("tokens"))
        return F.array_compact(F.array(F.when(said != "", text), F.when(i < F.col("found"), other)))

    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.col("found")), around))
    return turns.select("conv_id", "turn_no", "role", parts.alias("parts"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """What the reading of each chat gives, as digests."""
    read = read_chats(chats)
    turn = F.struct("turn_no", "role", "text", "loss")
    turns = read.groupBy("conv_id").agg(F.max("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list(turn)).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")
