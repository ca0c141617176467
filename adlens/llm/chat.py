"""Chat formatting whose output can be read back exactly.

Grammar: a conversation is a run of turns; a turn is ``### ``, the role, ``: ``, the text,
``</turn>`` and a line feed. Within role and text a backslash takes the next character
literally. The parser is a cut at every ``</turn>`` and one expression per piece, so every
text has one reading at most.

A turn is first written as it is and parsed. Where role and text do not come back
unchanged, its control strings and backslashes are escaped, with the backslash inside a
control string so that the string no longer occurs, and it is parsed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = "### "
MIDDLE = ": "
CLOSE = "</turn>"
END = "\n"
LEARNED_ROLE = "assistant"

_PIECE = r"(?s)^### ((?:[^:\\]++|\\.)*+): (.*)$"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    # in pairs, so that no three stay together
    out = F.replace(out, F.lit("##"), F.lit("#\\#"))
    out = F.replace(out, F.lit(CLOSE), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def _read_piece(piece: Column) -> Column:
    """Role and text of what stands before a close mark; NULL if it is no turn."""
    # one open mark only: another one would start a turn
    single = F.size(F.split(piece, "###")) == 2
    return F.when(
        single & F.regexp_like(piece, F.lit(_PIECE)),
        F.struct(
            unescape(F.regexp_extract(piece, _PIECE, 1)).alias("role"),
            unescape(F.regexp_extract(piece, _PIECE, 2)).alias("text"),
        ),
    )


def parse(formatted: Column) -> Column:
    """Array of turns (role, text) of a formatted conversation; NULL entries are no turns."""
    pieces = F.split(formatted, CLOSE + END)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), _read_piece)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE + END))


def _comes_back(role: Column, text: Column, as_role: Column, as_text: Column) -> Column:
    """Does a turn written as (as_role, as_text) read as exactly one turn (role, text)?"""
    written = render(as_role, as_text)
    pieces = F.split(written, CLOSE)
    turn = _read_piece(F.get(pieces, F.lit(0)))
    return F.coalesce(
        (F.size(pieces) == 2) & (turn["role"] == role) & (turn["text"] == text), F.lit(False)
    )


def format_turns(turns: DataFrame, role: str, text: str) -> DataFrame:
    """Adds ``_role`` and ``_text``, what is written, and ``_exact``, whether it reads back."""
    r, t = F.col(role), F.col(text)
    plain = turns.withColumn("_plain", _comes_back(r, t, r, t))
    chosen = plain.withColumns({
        "_role": F.when(F.col("_plain"), r).otherwise(escape(r, role=True)),
        "_text": F.when(F.col("_plain"), t).otherwise(escape(t)),
    })
    return chosen.withColumn("_exact", F.col("_plain") | _comes_back(r, t, F.col("_role"), F.col("_text"))).drop("_plain")


def format_conversations(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv``, ``formatted``, ``segments`` and ``exact`` of every conversation.

    ``segments`` cuts ``formatted`` into pieces (``text``, ``loss``); ``loss`` marks what a
    model learns to write, the texts of the assistant. ``exact`` tells that parsing
    ``formatted`` gave the turns of the source. Turns are taken by number; a NULL number comes
    first, equal numbers go by role and text, repeated rows are repeated turns. NULL
    role or text is empty, a NULL ``conv`` is one conversation. Other columns are not looked
    at; an empty table gives an empty table. One conversation is one text, so its turns meet
    in one task.
    """
    rows = conversations.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_r"), F.coalesce(F.col(text), F.lit("")).alias("_t"),
    )
    written = format_turns(rows, "_r", "_t")
    grouped = written.groupBy("_conv").agg(
        F.sort_array(F.collect_list(F.struct("_turn", "_r", "_t", "_role", "_text"))).alias("_turns"),
        F.bool_and("_exact").alias("_each"),
    )
    segments = F.flatten(F.transform("_turns", lambda x: F.array(
        F.struct(F.concat(F.lit(OPEN), x["_role"], F.lit(MIDDLE)).alias("text"), F.lit(False).alias("loss")),
        F.struct(x["_text"].alias("text"), (x["_r"] == LEARNED_ROLE).alias("loss")),
        F.struct(F.lit(CLOSE + END).alias("text"), F.lit(False).alias("loss")),
    )))
    made = grouped.withColumn("segments", segments).withColumn("formatted", F.array_join(F.col("segments.text"), ""))
    source = F.transform("_turns", lambda x: F.struct(x["_r"].alias("role"), x["_t"].alias("text")))
    same = F.coalesce(parse(F.col("formatted")) == source, F.lit(False))
    return made.select(F.col("_conv").alias(conv), "formatted", "segments", (F.col("_each") & same).alias("exact"))


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of turns and learned texts, read from ``formatted`` and ``segments``."""
    turns = formatted.withColumn("_turns", parse(F.col("formatted"))).withColumn(
        "_loss",
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""),
    )
    whole = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.select(
        conv,
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "exact",
    )
