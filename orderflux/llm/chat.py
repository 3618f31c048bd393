"""Chat formatting: an event log of conversations folded into final messages and rendered with a loss mask."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflux.llm.common import col

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates; none is left inside an escaped text.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: A control string, with any number of guards (backslashes) behind its first character.
_RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)
GUARDED = rf"([<\[])(\\*)({_RESTS})"
UNGUARD = rf"([<\[])\\(\\*)({_RESTS})"
TURN_END = END + "\n"


def escaped(text: Column) -> Column:
    """The text with one more guard in each control string, guarded already or not."""
    return F.regexp_replace(text, GUARDED, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNGUARD, "$1$2$3")


def escaped_role(role: Column) -> Column:
    """A role as it stands in a turn's heading: escaped, and on one line."""
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def fold_events(events: DataFrame, conv: str = "conv_id", seq: str = "seq", kind: str = "kind", place: str = "place",
                role: str = "role", text: str = "text") -> DataFrame:
    """The messages that stand at the end of each conversation's log: (conv_id, place, nth, role, text).

    Events name a place in their conversation and take effect in the order of ``seq``:

    - ``message`` (and null or any other kind) is a whole message or the beginning of a streamed one;
    - ``delta`` adds its text to the latest message at its place, or begins one there;
    - ``edit`` puts a message instead of what stood at its place, and leaves what follows;
    - ``regenerate`` withdraws what came before at its place and at all later ones, and begins a message.

    Events other than messages take the role last given at their place where they have none. Several messages at one
    place all stay, as nth 1, 2, ... by seq, role and text, so repeated rows count each. Nulls: a null seq or place comes
    first, a null text is empty, and so is a role given nowhere; rows without conv_id make one conversation. An
    empty log gives no rows. Only windows over a conversation sorted by place and seq: one shuffle, which later
    steps by conversation use again; the windows spill, so a conversation of any length passes.
    """
    log = events.select(
        col(conv).alias("conv_id"), col(seq).alias("seq"), col(place).alias("place"), col(role).alias("role"),
        col(text).cast("string").alias("text"),
        F.when(col(kind).isin("delta", "edit", "regenerate"), col(kind)).otherwise("message").alias("kind"),
    ).withColumn("adds", F.col("kind") == "delta")
    here = Window.partitionBy("conv_id", "place")
    ordered = here.orderBy("seq", "adds", "role", "text")
    up_to = Window.partitionBy("conv_id").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.greatest(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(up_to),
                     F.max(F.when(F.col("kind") == "edit", F.col("seq"))).over(here))
    stands = (log.repartition("conv_id")
              .withColumn("role", F.when(F.col("kind") == "message", F.col("role")).otherwise(
                  F.last("role", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))))
              .withColumn("cut", cut)
              .where(F.col("cut").isNull() | F.coalesce(F.col("seq") >= F.col("cut"), F.lit(False)))
              .withColumn("nth", F.sum(F.when(F.col("adds"), 0).otherwise(1)).over(
                  ordered.rowsBetween(Window.unboundedPreceding, 0))))
    parts = F.sort_array(F.collect_list(F.struct("seq", "adds", "role", F.coalesce("text", F.lit("")).alias("text"))))
    messages = stands.groupBy("conv_id", "place", "nth").agg(parts.alias("parts"))
    return messages.select("conv_id", "place", "nth", F.coalesce(F.get("parts", F.lit(0))["role"], F.lit("")).alias("role"),
                           F.array_join(F.col("parts")["text"], "").alias("text"))


def format_chats(events: DataFrame, trained: tuple[str, ...] = ("assistant",), **columns) -> DataFrame:
    """One row per conversation that has messages: (conv_id, formatted, pieces).

    ``formatted`` holds each message as ``<|im_start|>role``, a line break, its text and ``<|im_end|>``, another line break,
    with control strings in roles and texts guarded so that :func:`read_turns` gives back the very messages. ``pieces``
    are the parts of ``formatted`` in order, as (text, loss); under the loss mask stand the texts of the ``trained`` roles and
    nothing else. Nulls, ties, repeated rows and empty tables: see :func:`fold_events`, whose column names can be
    given. A conversation is one value in the result, so its texts meet in one task; nothing else does.
    """
    messages = fold_events(events, **columns)
    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    turn = F.struct("place", "nth", F.array(
        piece(F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")), F.lit(False)),
        piece(escaped(F.col("text")), F.col("role").isin(*trained)),
        piece(F.lit(TURN_END), F.lit(False))).alias("pieces"))
    chats = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = chats.select("conv_id", F.flatten(F.col("turns")["pieces"]).alias("pieces"))
    return chats.select("conv_id", F.array_join(F.col("pieces")["text"], "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """The messages in a formatted text, as an array of (role, text)."""
    bodies = F.transform(F.filter(F.split(formatted, re.escape(TURN_END)), lambda t: t != ""),
                         lambda t: F.substring(t, len(START) + 1, 2**31 - 1))
    return F.transform(bodies, lambda b: F.struct(
        unescaped_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescaped(F.substr(b, F.locate("\n", b) + 1)).alias("text")))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, as it stood in the messages."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescaped(p["text"])), "")


def chat_digest(chats: DataFrame) -> DataFrame:
    """Counts and hashes of what :func:`format_chats` made, read back from it."""
    read = chats.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"),
                        read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("pieces")).alias("loss"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
