"""Order and running totals inside conversations, without one task per conversation.

Both helpers cut a conversation into blocks, work inside the blocks and shift each block by a
total over the earlier ones, so a conversation that holds a large share of all turns spreads
over many tasks. A block of `numbered` holds the rows of BLOCK turn numbers (all rows without a
turn number are one block), sorted by Spark with spilling; a block of `running` holds BLOCK rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
_FIRST = -(1 << 63)


def _earlier(totals: DataFrame, key: str, names: Sequence[str], fold: Callable[[str], Column],
             empty: Column) -> DataFrame:
    """`totals` of blocks replaced by what the earlier blocks of the same key add up to."""
    ahead = Window.partitionBy(key).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, "block_", *[
        F.coalesce(fold(name).over(ahead), empty).alias(f"ahead_{name}") for name in names])


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """`rows` with `pos` (from 0) inside `key` and `opens`, whether a row is the first of its turn.

    Rows are ordered by turn (null first), role and text; equal rows take either order.
    """
    block = F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(_FIRST))
    cut = rows.withColumn("block_", block)
    inside = Window.partitionBy(key, "block_").orderBy(F.asc_nulls_first("turn"), "role", "text")
    ahead = _earlier(cut.groupBy(key, "block_").agg(F.count(F.lit(1)).alias("n_")), key, ["n_"], F.sum, F.lit(0))
    placed = cut.select("*", F.row_number().over(inside).alias("row_"), F.lag(F.struct("turn")).over(inside).alias("last_"))
    return placed.join(ahead, [key, "block_"]).select(
        *[F.col(f"`{name}`") for name in rows.columns],
        (F.col("ahead_n_") + F.col("row_") - 1).alias("pos"),
        (~F.col("last_").eqNullSafe(F.struct("turn"))).alias("opens"))


def running(rows: DataFrame, key: str, place: str, names: Sequence[str], fold: Callable[[str], Column],
            both: Callable[[Column, Column], Column]) -> DataFrame:
    """`rows` with each column of `names` folded over the rows of `key` up to `place` (from 0, dense)."""
    cut = rows.withColumn("block_", F.expr(f"{place} div {BLOCK}"))
    inside = Window.partitionBy(key, "block_").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _earlier(cut.groupBy(key, "block_").agg(*[fold(name).alias(name) for name in names]),
                     key, names, fold, F.lit(0).cast("long"))
    local = cut.select("*", *[fold(name).over(inside).alias(f"run_{name}") for name in names])
    others = [name for name in rows.columns if name not in names]
    return local.join(ahead, [key, "block_"]).select(*others, *[
        both(F.col(f"ahead_{name}"), F.col(f"run_{name}")).alias(name) for name in names])
