"""Tables behind the boards: investigations over time, the daily selection, the activity feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def board_order(investigations: DataFrame) -> DataFrame:
    """Score first, then the newest date."""
    return investigations.orderBy(F.desc("score"), F.desc("as_of"), "symbol")


def latest_per_symbol(investigations: DataFrame) -> DataFrame:
    return investigations.groupBy("symbol").agg(F.max_by("id", "as_of").alias("id"))


def score_changes(investigations: DataFrame) -> DataFrame:
    """Change against the symbol's previous investigation; thin = high score, little evidence."""
    order = W.partitionBy("symbol").orderBy("as_of")
    return investigations.select(
        "symbol", "as_of", "score", "cov",
        (F.col("score") - F.lag("score").over(order)).alias("delta"),
        ((F.col("score") >= 60) & (F.col("cov") <= 2)).alias("thin"))


def history_tiles(investigations: DataFrame) -> DataFrame:
    return investigations.agg(
        F.count("*").alias("total"), F.count_distinct("symbol").alias("symbols"),
        F.count_if(F.col("band") != "normal").alias("flagged"),
        F.coalesce(F.avg("cov"), F.lit(0.0)).alias("mean_components"))


def trend_matrix(investigations: DataFrame, symbols: list[str]) -> DataFrame:
    """date x symbol scores; the symbols are named, so no pass is spent on finding them."""
    return investigations.groupBy("as_of").pivot("symbol", symbols).agg(F.max("score"))


def selection_with_results(candidates: DataFrame, investigations: DataFrame) -> DataFrame:
    """Each day's candidates next to the investigation of that symbol on that day, if any."""
    found = investigations.select("symbol", "as_of", F.col("id").alias("investigation_id"),
                                  F.col("band").alias("investigation_band"),
                                  F.col("score").alias("investigation_score"))
    return candidates.join(found, ["symbol", "as_of"], "left")


def activity_feed(sweeps: DataFrame, investigations: DataFrame) -> DataFrame:
    """Sweeps and investigations in one feed, newest first.

    An investigation only has a date and is shown at 17:30 local time.
    """
    swept = sweeps.select(
        F.coalesce("generated_at", F.concat(F.col("as_of").cast("string"),
                                            F.lit("T00:00:00+00:00"))).alias("ts"),
        F.col("as_of").alias("date"), F.lit("sweep").alias("kind"), "n_candidates",
        F.col("credits_spent").alias("credits"))
    done = investigations.select(
        F.concat(F.col("as_of").cast("string"), F.lit("T17:30:00+07:00")).alias("ts"),
        F.col("as_of").alias("date"), F.lit("investigation").alias("kind"), "id", "symbol",
        "band", "score", F.col("credits_total").alias("credits"))
    return swept.unionByName(done, allowMissingColumns=True).orderBy(F.desc("ts"), "kind", "id")


def provenance_total(summaries: DataFrame) -> DataFrame:
    """How much was decided by the model and how much by rules, over all investigations."""
    return summaries.agg(
        F.count("*").alias("investigations"), F.count_if("planner_model").alias("planner_model"),
        F.count_if("narrative_model").alias("narrative_model"),
        F.sum("model_decisions").alias("model_decisions"),
        F.sum("fallback_decisions").alias("fallback_decisions"),
        F.sum(F.col("model_decisions") + F.col("fallback_decisions")).alias("steps"))


def name_coverage(used: DataFrame, available: DataFrame) -> DataFrame:
    """Names in both sets, only used, only available."""
    u = used.select("name").distinct()
    a = available.select("name").distinct()
    return (
        u.intersect(a).withColumn("status", F.lit("matched"))
        .unionByName(u.exceptAll(a).withColumn("status", F.lit("missing")))
        .unionByName(a.exceptAll(u).withColumn("status", F.lit("unused"))))
