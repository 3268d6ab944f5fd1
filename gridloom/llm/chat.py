"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation (roles and bodies hold no control string)::

    conversation := turn*
    turn         := "<s>[INST]" role "[/INST]" body "</s>"

A turn is first rendered as it stands and parsed again.  If the parse does not give back the same
role and text, the turn is rendered escaped: each control string gets one more backslash after its
first character, which no parse can mistake and which unescaping takes away again, so one escape makes
any text identical.  The parser
always unescapes, so a text that already looks escaped conflicts too and is escaped once more.
Finally the whole conversation is parsed and compared with its source; a difference is an error.

Null texts and roles count as empty, a null turn number sorts first, and turns with the same number
are ordered by role and text.  A null conversation id is a conversation of its own.  Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = r"</?s>|\[/?INST\]"
_ESCAPABLE = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*/?(?:s>|INST\]))"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPABLE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(HEAD_END), body, F.lit(CLOSE))


def parse(rendered: Column) -> Column:
    """Turns as ARRAY<STRUCT<role, text>>; a piece that the grammar does not allow becomes null."""

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"\[/INST\]", 2)
        role = F.substr(parts[0], F.lit(len(OPEN) + 1))
        allowed = piece.startswith(OPEN) & (F.size(parts) == 2) & ~role.rlike(CONTROL) & ~F.get(parts, F.lit(1)).rlike(CONTROL)
        return F.when(allowed, F.struct(unescape(role).alias("role"), unescape(F.get(parts, F.lit(1))).alias("text")))

    pieces = F.split(rendered, CLOSE, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (as parsed back from ``formatted``)."""
    source = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    plain = render(F.col("role"), F.col("text"))
    same = parse(plain) == F.array(F.struct(F.col("role"), F.col("text")))
    # Only the source and its verdict move; a turn's rendering is made where its conversation is put together.
    grouped = (
        source.withColumn("plain", same)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "plain"))).alias("rows"))
    )
    shown = lambda r: F.when(r["plain"], render(r["role"], r["text"])).otherwise(render(escape(r["role"]), escape(r["text"])))
    joined = grouped.select(
        "conv_id",
        F.array_join(F.transform("rows", shown), "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"),
    ).withColumn("turns", parse(F.col("formatted")))
    broken = F.raise_error(F.concat(F.lit("conversation does not survive its round trip: "), F.col("conv_id").cast("string")))
    return joined.select(
        "conv_id",
        "formatted",
        F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(broken).alias("turns"),
    )


def loss_text(turns: Column) -> Column:
    """The text under the loss mask: each assistant text once, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")


def digest(formatted: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
