"""Calibration: observation matrix, separation, weights, metrics and the time split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S
from tapelens.operators import labels, pit, probes, scoring
from tapelens.session import cut_lineage


def labelled_events(tables) -> DataFrame:
    """Assessable movement episodes (label 1) and their matched controls (label 0)."""
    moves = labels.classified(tables).where("reason_class = 'pergerakan'")
    positives = cut_lineage(labels.assessable_events(tables, labels.collapse_episodes(moves)))
    controls = labels.controls_with_reuse(tables, positives)
    return positives.select("symbol", "event_date", F.lit(1).alias("label")).unionByName(
        controls.select("symbol", "event_date", F.lit(0).alias("label")))


def lag_grid(tables, events: DataFrame, lags: list[int] | None = None) -> DataFrame:
    return pit.nth_session_before(events, pit.trading_calendar(tables), lags or K.LAGS)


def observation_matrix(tables, events: DataFrame, lags: list[int] | None = None,
                       exclude: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, event_date, lag, as_of, label, six sub-scores).

    A symbol and date shared by several events is scored once and joined back. The grid is a
    few rows per event and feeds six probes, so it is materialised first. Components in
    `exclude` stay null (a label made of suspensions leaks into the structural score).
    """
    wanted = cut_lineage(lag_grid(tables, events, lags))
    grid = wanted.select("symbol", "as_of").distinct()
    table = probes.score_table(probes.run_all(tables, grid, exclude, sparse=True, overlapping=True))
    return wanted.join(table, ["symbol", "as_of"]).select(
        "symbol", "event_date", "lag", "as_of", "label", *K.COMPONENTS)


def long_observations(matrix: DataFrame) -> DataFrame:
    pairs = ", ".join(f"'{c}', {c}" for c in K.COMPONENTS)
    return matrix.select("lag", "label", F.expr(
        f"stack({len(K.COMPONENTS)}, {pairs}) as (component, sub_score)"))


def class_lag_means(matrix: DataFrame) -> DataFrame:
    """Mean sub-score per (lag, class), nulls left out, with the number of observations."""
    return matrix.groupBy("lag", "label").agg(
        *[F.avg(c).alias(c) for c in K.COMPONENTS], F.count("*").alias("n"))


def auc_by_component(matrix: DataFrame) -> DataFrame:
    """Mann-Whitney AUC per component; ties count half, null if a class is empty.

    Counts per distinct score replace ranks: scores have one decimal, so the window of a
    component holds at most 1,001 rows.
    """
    counts = long_observations(matrix).groupBy("component", "sub_score").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg")).where("sub_score is not null")
    before = W.partitionBy("component").orderBy("sub_score").rowsBetween(
        W.unboundedPreceding, -1)
    wins = F.col("pos") * (F.coalesce(F.sum("neg").over(before), F.lit(0)) + F.col("neg") / 2)
    sums = counts.withColumn("wins", wins).groupBy("component").agg(
        F.sum("wins").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    names = matrix.sparkSession.createDataFrame(
        [(c, i) for i, c in enumerate(K.COMPONENTS)], "component string, position int")
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return names.join(sums, "component", "left").select(
        "component", "position",
        F.when(both, F.col("wins") / (F.col("pos") * F.col("neg"))).alias("auc"))


def weights_from_auc(auc: DataFrame, enough: bool | Column = True) -> DataFrame:
    """Weights in proportion to the AUC above 0.5, two decimals, residual to the largest.

    The prior weights stand if nothing separates or there are too few positives. Six rows.
    """
    prior = F.create_map(*[F.lit(x) for kv in K.WEIGHTS.items() for x in kv])
    everything = W.partitionBy(F.lit(1))
    ranked = W.partitionBy(F.lit(1)).orderBy(F.desc("rounded"), "position")
    excess = F.greatest(F.lit(0.0), F.coalesce("auc", F.lit(0.5)) - 0.5)
    out = (
        auc.withColumn("excess", excess).withColumn("total", F.sum("excess").over(everything))
        .withColumn("rounded", S.half_even(F.when(
            F.col("total") > 0, F.col("excess") / F.col("total")), 2))
        .withColumn("residual", F.lit(1.0) - F.sum("rounded").over(everything))
        .withColumn("place", F.row_number().over(ranked))
    )
    fitted = S.half_even(F.col("rounded") + F.when(F.col("place") == 1, F.col("residual"))
                         .otherwise(0.0), 2)
    sure = F.lit(enough) if isinstance(enough, bool) else enough
    use = sure & (F.col("total") > 0)
    return out.select("component", "auc",
                      F.when(use, fitted).otherwise(prior[F.col("component")]).alias("weight"))


def evaluate(matrix: DataFrame, weights: dict[str, float] | None = None, threshold: int = 60,
             top: int = 20) -> DataFrame:
    """Precision at top-k, recall, false positives, median lead and mean confidence: one row.

    The peaks, a row per labelled event, are materialised: the best and the totals read them.
    """
    scored = scoring.composite_row(matrix, weights).where("composite is not null")
    over = F.col("composite") >= threshold
    peaks = cut_lineage(scored.groupBy("symbol", "event_date", "label").agg(
        F.max("composite").alias("peak"),
        F.max(F.when(over, F.col("lag"))).alias("lead"),
        F.sum("confidence").alias("conf_sum"), F.count("*").alias("rows")))
    best = peaks.orderBy(F.desc("peak"), "symbol", "event_date", F.desc("label")).limit(top)
    precision = best.agg(F.avg("label").alias("precision_at_k"), F.count("*").alias("k"))
    passed = F.col("peak") >= threshold
    totals = peaks.agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_positive"),
        F.count_if(F.col("label") == 0).alias("n_control"),
        F.count_if(passed & (F.col("label") == 1)).alias("caught"),
        F.count_if(passed & (F.col("label") == 0)).alias("false_positive"),
        F.median(F.when(F.col("label") == 1, F.col("lead"))).alias("median_lead"),
        (F.sum("conf_sum") / F.sum("rows")).alias("mean_confidence"))
    return totals.select(
        "n", "n_positive", "n_control", precision.select("k").scalar().alias("k"),
        precision.select("precision_at_k").scalar().alias("precision_at_k"),
        F.when(F.col("n_positive") > 0, F.col("caught") / F.col("n_positive")).alias("recall"),
        "false_positive", "median_lead", "mean_confidence")


def time_split(matrix: DataFrame, share: float = 0.75, on: str = "event_date") -> DataFrame:
    """Tag rows 'calibration' before the boundary date and 'test' from it on."""
    days = matrix.select(on).distinct()
    numbered = days.withColumn("_n", F.row_number().over(W.orderBy(on)) - 1)
    position = F.floor(days.agg(F.count("*")).scalar() * share)
    boundary = numbered.where(F.col("_n") == position).agg(F.max(on)).scalar()
    return matrix.withColumn(
        "part", F.when(F.col(on) < boundary, "calibration").otherwise("test"))


def reason_class_counts(tables) -> DataFrame:
    return labels.classified(tables).groupBy("reason_class").agg(F.count("*").alias("n"))


def table_inventory(tables) -> DataFrame:
    """Distinct symbols and dates of the tables that decide what can be calibrated."""
    out = None
    for name, day in (("broker_summary", "trade_date"), ("foreign_flow", "trade_date"),
                      ("free_float", "as_of")):
        part = tables[name].agg(
            F.count_distinct("symbol").alias("symbols"), F.count_distinct(day).alias("dates")
        ).select(F.lit(name).alias("table_name"), "symbols", "dates")
        out = part if out is None else out.unionByName(part)
    return out
