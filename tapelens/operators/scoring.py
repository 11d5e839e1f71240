"""Composite score, confidence and band from the six sub-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S


def normalised(weights: dict[str, float] | None = None) -> dict[str, float]:
    chosen = dict(weights or K.WEIGHTS)
    total = sum(chosen.values())
    if total <= 0:
        raise ValueError("component weights add up to nothing")
    if abs(total - 1.0) > 1e-6:
        chosen = {k: v / total for k, v in chosen.items()}
    return chosen


def weighted(columns: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """(sum of weight x score, sum of weights) over the measured components."""
    top, covered = F.lit(0.0), F.lit(0.0)
    for code in K.COMPONENTS:
        if code not in columns:
            continue
        w = F.lit(weights.get(code, 0.0))
        top = top + F.when(columns[code].isNotNull(), w * columns[code]).otherwise(0.0)
        covered = covered + F.when(columns[code].isNotNull(), w).otherwise(0.0)
    return top, covered


def composite(table: DataFrame, weights: dict[str, float] | None = None,
              columns: dict[str, Column] | None = None) -> DataFrame:
    """Add score (0-100, half-even), band and confidence; nothing measured gives 0 and 0."""
    columns = columns or {c: F.col(c) for c in K.COMPONENTS}
    top, covered = weighted(columns, normalised(weights))
    return (
        table.withColumn("_top", top).withColumn("_covered", covered)
        .withColumn("score", F.when(F.col("_covered") > 0, F.rint(F.col("_top")
                    / F.col("_covered"))).otherwise(0.0).cast("int"))
        .withColumn("band", S.band(F.col("score")))
        .withColumn("confidence", S.half_even(F.col("_covered"), 2))
        .drop("_top", "_covered")
    )


def composite_row(table: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Unrounded weighted mean and confidence of an observation row; null if nothing measured."""
    chosen = dict(weights or K.WEIGHTS)
    top, covered = weighted({c: F.col(c) for c in K.COMPONENTS}, chosen)
    measured = F.coalesce(*[F.col(c) for c in K.COMPONENTS]).isNotNull()
    return (
        table.withColumn("_covered", covered)
        .withColumn("composite", F.when(measured & (F.col("_covered") > 0),
                                        top / F.col("_covered")))
        .withColumn("confidence", F.when(measured, F.col("_covered")
                                         / F.lit(sum(chosen.values()))).otherwise(0.0))
        .drop("_covered")
    )


def component_array(scored: DataFrame, weights: dict[str, float] | None = None) -> Column:
    """components array<struct<code, sub_score, weight, investigated>> of a `run_all` row."""
    chosen = normalised(weights)
    return F.array(*[
        F.struct(F.lit(c).alias("code"), F.col(f"{c}.sub_score").alias("sub_score"),
                 F.lit(round(chosen.get(c, 0.0), 4)).alias("weight"),
                 F.col(f"{c}.sub_score").isNotNull().alias("investigated"))
        for c in K.COMPONENTS])
