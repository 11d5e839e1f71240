"""Every participant's view of a dialogue: that speaker as assistant, the others as named users.

For each participant of a conversation the whole dialogue is rendered once. Turns of the
participant become assistant messages and are the only characters trained on; turns of the
others become user messages that carry the speaker's name; system turns stay system messages and
belong to nobody. The mask is a list of character spans (start:end, comma-joined) in the text.

Turns are gathered once, in blocks of BLOCK_TURNS turn numbers, and a block is rendered for every
participant: a dialogue of any length becomes several rows (`block`), and no task ever holds more
than one block. The participants of a conversation are summed up before the shuffle.

Defined cases: turns that repeat a whole row count once; several texts of one turn number are all
kept, ordered by speaker and text; a null text is an empty message; a null speaker is shown as
`unknown` and is no participant; rows without a conversation or turn number are in no dialogue and
give no row; a conversation without a participant gives none; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"
BLOCK_TURNS = 64
OPEN, CLOSE = "<|{role}|>", "<|end|>\n"


def _rendered(message: Column, speaker: Column) -> tuple[Column, Column, Column]:
    """Head, body and whether the body is trained on."""
    own = F.coalesce(message["role"] == speaker, F.lit(False))
    name = F.coalesce(message["role"], F.lit(UNKNOWN))
    head = F.when(own, OPEN.format(role="assistant") + "\n").when(
        message["role"] == SYSTEM, OPEN.format(role="system") + "\n").otherwise(
        F.concat(F.lit(OPEN.format(role="user") + "name="), name, F.lit("\n")))
    return head, F.concat(message["text"], F.lit(CLOSE)), own


def rotate(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, speaker, block, n_turns, text, mask, n_trained (characters trained on)."""
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role",
                        F.coalesce("text", F.lit("")).alias("text")).where(
        F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).distinct()
    blocks = said.groupBy("conv_id", F.floor(F.col("turn") / block_turns).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    speakers = turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
                           & (F.col("role") != SYSTEM)).select("conv_id", F.col("role").alias("speaker")).distinct()
    views = blocks.join(speakers, "conv_id")

    def line(message: Column) -> Column:
        head, body, own = _rendered(message, F.col("speaker"))
        return F.struct(F.concat(head, body).alias("text"), F.length(head).alias("head"),
                        F.length(body).alias("body"), own.alias("own"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["head"]
        end = start + x["body"]
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(end.alias("at"),
                        F.when(x["own"], F.concat(state["spans"], F.array(span)))
                        .otherwise(state["spans"]).alias("spans"))

    rendered = views.withColumn("lines", F.transform("messages", line))
    mask = F.aggregate("lines", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
                       step, lambda state: F.array_join(state["spans"], ","))
    trained = F.aggregate("lines", F.lit(0).cast("long"),
                          lambda n, x: n + F.when(x["own"], x["body"]).otherwise(0))
    return rendered.select(
        "conv_id", "speaker", "block", F.size("lines").cast("long").alias("n_turns"),
        F.array_join(F.transform("lines", lambda x: x["text"]), "").alias("text"),
        mask.alias("mask"), trained.alias("n_trained"))
