"""Evidence-selection policies under a credit budget, compared with buying everything.

A policy is an expression per (symbol, as_of) row: which probes are bought, what they cost and
which band the bought scores give. The probe list is a fixed array of six, so choosing is
in-row work and no policy adds a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S
from tapelens.operators import scoring

def price_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in K.PROBE_COST.items() for x in kv])


def cost_of(probes: Column) -> Column:
    return F.aggregate(probes, F.lit(0), lambda acc, p: acc + price_map()[p])


def probe_array() -> Column:
    return F.array(*[F.lit(p) for p in K.PROBES])


# -- choosing -------------------------------------------------------------------------------------
def greedy_fill(order: Column, budget: Column) -> Column:
    """Walk the order and take what still fits; a later cheaper probe may fit after a miss."""
    kind = "struct<left: int, chosen: array<string>>"
    start = F.struct(budget.cast("int").alias("left"), F.array().alias("chosen")).cast(kind)

    def step(acc: Column, probe: Column) -> Column:
        cost = price_map()[probe]
        taken = F.struct((acc["left"] - cost).alias("left"),
                         F.concat(acc["chosen"], F.array(probe)).alias("chosen")).cast(kind)
        return F.when(cost <= acc["left"], taken).otherwise(acc)

    return F.aggregate(order, start, step, lambda acc: acc["chosen"])


def exhaustive() -> Column:
    return probe_array()


def fixed_order(budget: Column) -> Column:
    return greedy_fill(probe_array(), budget)


def shuffled(symbol: Column, seed: int = 0) -> Column:
    """A repeatable shuffle of the probes per symbol."""
    keyed = F.transform(probe_array(), lambda p: F.struct(
        F.md5(F.concat_ws("|", symbol, p, F.lit(str(seed)))).alias("k"), p.alias("probe")))
    return F.transform(F.array_sort(keyed), lambda s: s["probe"])


def random_order(symbol: Column, budget: Column, seed: int = 0) -> Column:
    return greedy_fill(shuffled(symbol, seed), budget)


def bought_sets() -> DataFrame:
    """Every non-empty set of probes as a bit mask: price, weight and place among its equals.

    Sets of equal weight are ranked by the number of probes, then by the order in which the
    probes are listed.
    """
    spark = SparkSession.getActiveSession()
    n = len(K.PROBES)
    mask = F.col("mask")
    has = [(mask.bitwiseAND(F.lit(1 << i)) != 0).cast("int") for i in range(n)]
    weights = [K.WEIGHTS[K.PROBE_COMPONENT[p]] for p in K.PROBES]
    return spark.range(1, 1 << n, 1, 1).withColumnRenamed("id", "mask").select(
        "mask", reduce(lambda a, b: a + b, [F.lit(K.PROBE_COST[p]) * h for p, h in zip(K.PROBES, has)]).alias("price"),
        F.round(reduce(lambda a, b: a + b, [F.lit(w) * h for w, h in zip(weights, has)]), 9).alias("weight"),
        reduce(lambda a, b: a + b, has).alias("size"),
        F.concat(*[h.cast("string") for h in has]).alias("listed"),
        F.array_compact(F.array(*[F.when(h == 1, F.lit(p)) for p, h in zip(K.PROBES, has)])).alias("chosen"))


def best_sets() -> DataFrame:
    """(budget, chosen): the heaviest set that each whole budget pays for, empty if none."""
    sets = bought_sets()
    budgets = sets.sparkSession.range(0, K.BASELINE_COST + 1, 1, 1).withColumnRenamed("id", "budget")
    paid = sets.select("*", F.explode(F.sequence(
        F.col("price").cast("long"), F.lit(K.BASELINE_COST).cast("long"))).alias("budget"))
    order = W.partitionBy("budget").orderBy(F.desc("weight"), "size", F.desc("listed"))
    first = paid.withColumn("place", F.row_number().over(order)).where("place = 1")
    return budgets.join(first.select("budget", "chosen"), "budget", "left").select(
        "budget", F.coalesce("chosen", F.array().cast("array<string>")).alias("chosen"))


def best_subset(budget: int) -> list[str]:
    return list(_answers()[max(0, min(budget, K.BASELINE_COST))])


def _answers() -> list[list[str]]:
    """One answer per whole budget; the table has as many rows as everything costs."""
    return [row.chosen for row in best_sets().orderBy("budget").collect()]


def oracle_subset(budget: Column) -> Column:
    """Best subset per row: one answer per whole budget up to the price of everything."""
    answers = F.array(*[F.array(*[F.lit(p) for p in chosen]).cast("array<string>")
                        for chosen in _answers()])
    return F.get(answers, F.least(F.greatest(budget, F.lit(0)), F.lit(K.BASELINE_COST))
                 .cast("int"))


def cheapest_two() -> list[str]:
    return sorted(K.PROBES, key=lambda p: K.PROBE_COST[p])[:2]


def fallback_budget(ceiling: int = 25) -> int:
    return min(ceiling, sum(K.PROBE_COST[p] for p in cheapest_two()) + 2)


# -- arms -------------------------------------------------------------------------------------------
def arm_rows(table: DataFrame, chosen: dict[str, Column]) -> DataFrame:
    """(symbol, as_of, arm, chosen, credits, score, band, confidence) for each arm.

    `table` has the six sub-scores as columns.
    """
    out = table
    for arm, probes in chosen.items():
        out = out.withColumn(f"_{arm}", probes)
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"_{a}").alias("chosen"))
                     for a in chosen])
    rows = out.select("symbol", "as_of", *K.COMPONENTS, F.inline(arms))
    bought = {c: F.when(F.array_contains("chosen", p), F.col(c))
              for p, c in K.PROBE_COMPONENT.items()}
    return scoring.composite(rows, columns=bought).select(
        "symbol", "as_of", "arm", "chosen", cost_of(F.col("chosen")).alias("credits"),
        "score", "band", "confidence")


def standard_arms(table: DataFrame, budget: str = "budget") -> DataFrame:
    b = F.col(budget)
    return arm_rows(table, {
        "exhaustive": exhaustive(),
        "fixed_order": fixed_order(b),
        "random": random_order(F.col("symbol"), b),
        "oracle": oracle_subset(b),
        "cheapest_two": F.array(*[F.lit(p) for p in cheapest_two()]),
    })


def with_reference_band(arms: DataFrame, reference: str = "exhaustive") -> DataFrame:
    """Each arm row next to the band of the reference arm, in one window on the grid key."""
    grid = W.partitionBy("symbol", "as_of")
    return arms.withColumn("reference_band", F.max(
        F.when(F.col("arm") == reference, F.col("band"))).over(grid))


def arm_summary(arms: DataFrame, reference: str = "exhaustive") -> DataFrame:
    """Mean and total credits, saving against buying everything, band agreement per arm."""
    judged = with_reference_band(arms, reference)
    agree = F.count_if(F.col("band") == F.col("reference_band"))
    return judged.groupBy("arm").agg(
        F.count("*").alias("cases"), F.sum("credits").alias("total_credits"),
        S.half_even(F.avg("credits"), 2).alias("mean_credits"),
        S.half_even(100 * (1 - F.sum("credits") / (F.count("*") * K.BASELINE_COST)), 1)
        .alias("saving_pct"),
        agree.alias("agreed"),
        S.half_even(100 * agree / F.count("*"), 1).alias("agreed_pct"))


def pairwise(arms: DataFrame, reference: str = "exhaustive") -> DataFrame:
    """The reference arm against every other arm, per case."""
    grid = W.partitionBy("symbol", "as_of")
    ref = F.max(F.when(F.col("arm") == reference,
                       F.struct("band", "credits", "chosen"))).over(grid)
    return arms.withColumn("ref", ref).where(F.col("arm") != reference).select(
        "symbol", "as_of", "arm", (F.col("credits") - F.col("ref.credits")).alias("credit_gap"),
        (F.col("band") == F.col("ref.band")).alias("same_band"),
        (F.col("chosen") == F.col("ref.chosen")).alias("same_choice"))


def choice_sensitivity(arms: DataFrame, first: str, second: str) -> DataFrame:
    """How often two arms choose different lists."""
    both = arms.where(F.col("arm").isin(first, second)).groupBy("symbol", "as_of").agg(
        F.max(F.when(F.col("arm") == first, F.col("chosen"))).alias("a"),
        F.max(F.when(F.col("arm") == second, F.col("chosen"))).alias("b"))
    return both.agg(
        F.count("*").alias("cases"), F.count_if(F.col("a") != F.col("b")).alias("different"),
        S.half_even(100 * F.count_if(F.col("a") != F.col("b")) / F.count("*"), 1)
        .alias("different_pct"))


def escalation_precision(table: DataFrame, arms: DataFrame, arm: str,
                         planned: list[str] | None = None) -> DataFrame:
    """Probes bought beyond the plan: how many change the band when they are left out."""
    plan = F.array(*[F.lit(p) for p in (planned or cheapest_two())])
    extra = arms.where(F.col("arm") == arm).withColumn(
        "escalated", F.explode(F.array_except("chosen", plan)))
    rows = extra.select("symbol", "as_of", "chosen", "escalated",
                        F.col("band").alias("full_band")).join(table, ["symbol", "as_of"])
    kept = {c: F.when(F.array_contains("chosen", p) & (F.col("escalated") != p), F.col(c))
            for p, c in K.PROBE_COMPONENT.items()}
    scored = scoring.composite(rows, columns=kept)
    useful = F.count_if(F.col("band") != F.col("full_band"))
    return scored.groupBy("escalated").agg(
        F.count("*").alias("total"), useful.alias("useful"),
        S.half_even(100 * useful / F.count("*"), 1).alias("precision_pct"))


def run_noise(runs: DataFrame, metric: str = "value", by: list[str] | None = None) -> DataFrame:
    """Spread of a metric over repeated runs: nothing below two, deviation from three on."""
    keys = by or ["metric"]
    v = F.col(metric)
    out = runs.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.min(v).alias("low"), F.max(v).alias("high"),
        S.half_even(F.max(v) - F.min(v), 2).alias("spread"),
        S.half_even(F.avg(v), 2).alias("mean"),
        S.half_even(F.when(F.count("*") > 2, F.stddev_samp(v)), 2).alias("deviation"))
    return out.where(F.col("runs") >= 2)


# -- budgets and prices ---------------------------------------------------------------------------------
def equal_split(cases: DataFrame, total: Column, order: list[str], by: list[str]) -> DataFrame:
    """A portfolio's total shared evenly; the remainder goes one by one to the first cases."""
    everyone = W.partitionBy(*by)
    position = F.row_number().over(everyone.orderBy(*order))
    n = F.count("*").over(everyone)
    return cases.withColumn("position", position).withColumn(
        "budget", F.floor(total / n)
        + F.when(F.col("position") <= F.pmod(total, n), 1).otherwise(0))


def billed(endpoint: Column, rows: Column) -> Column:
    """Credits one call costs: per returned block of rows where the list price says so."""
    price = F.create_map(*[
        x for name, (unit, units, per, *_) in K.ENDPOINTS.items()
        for x in (F.lit(name), F.struct(F.lit(unit).alias("unit"), F.lit(units).alias("units"),
                                        F.lit(per).alias("per")))])[endpoint]
    flat = price["unit"] * price["units"]
    blocks = F.greatest(F.lit(1), F.ceil(rows / F.when(price["per"] > 0, price["per"])))
    return F.when((price["per"] == 0) | rows.isNull(), flat).otherwise(price["unit"] * blocks)


def saving_pct(cost: Column, baseline: Column) -> Column:
    return F.when(F.coalesce(baseline, F.lit(0)) == 0, F.lit(0)).otherwise(
        F.rint((1 - cost / baseline) * 100)).cast("int")


def price_list(spark) -> DataFrame:
    """probe, component, endpoint, call cost, route, verified: 11 fixed rows."""
    rows = [(p, K.PROBE_COMPONENT[p], i, e, K.call_cost(e), K.ENDPOINTS[e][3], K.ENDPOINTS[e][4])
            for i, p in enumerate(K.PROBES) for e in K.PROBE_ENDPOINTS[p]]
    return spark.createDataFrame(
        rows, "probe string, component string, position int, endpoint string, call_cost int, "
              "transport string, verified boolean")


def cost_catalogue(spark, ledger: DataFrame) -> DataFrame:
    """Per probe: list price, endpoints, routes, all verified, and what the ledger shows was
    paid for its endpoints. Cheapest first."""
    paid = ledger.groupBy("endpoint").agg(
        F.count("*").alias("calls"), F.sum("credits").alias("credits"))
    listed = price_list(spark).join(paid, "endpoint", "left")
    return listed.groupBy("probe", "component", "position").agg(
        F.sum("call_cost").alias("credit_cost"),
        F.array_join(F.array_sort(F.collect_set("endpoint")), ",").alias("endpoints"),
        F.array_join(F.array_sort(F.collect_set("transport")), ",").alias("transports"),
        F.bool_and("verified").alias("cost_verified"),
        F.sum(F.coalesce("calls", F.lit(0))).alias("ledger_calls"),
        F.sum(F.coalesce("credits", F.lit(0))).alias("ledger_credits"),
    ).orderBy("credit_cost", "position").drop("position")


# -- work lists -----------------------------------------------------------------------------------------
def fetch_windows(symbols: DataFrame, as_of: Column,
                  sessions: int = K.PRICE_SESSIONS) -> DataFrame:
    """Per symbol the backward call windows of 135 days that cover `sessions` sessions."""
    calls = -(-sessions // K.CALL_WINDOW_SESSIONS)
    n = F.col("n")
    end = F.date_sub(as_of, (n * (K.CALL_WINDOW_DAYS + 1)).cast("int"))
    return symbols.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(calls - 1))).alias("n")
                          ).select("symbol", F.lit("fetch-daily-transaction").alias("endpoint"),
                                   F.date_sub(end, K.CALL_WINDOW_DAYS).alias("start"),
                                   end.alias("end"))


def first_weekday(day: Column, sessions: int = K.PRICE_SESSIONS) -> Column:
    """The first of the last `sessions` Monday-Friday dates."""
    return F.get(S.weekdays_back(day, sessions), F.lit(0))


def tier2_calls(symbols: DataFrame, start: Column, as_of: Column) -> DataFrame:
    """Every symbol x the seven per-symbol endpoints, with their parameters."""
    dated = F.col("endpoint").isin(*K.TIER2_DATED)
    return symbols.select("symbol", F.explode(F.array(*[
        F.lit(e) for e in K.TIER2_ENDPOINTS])).alias("endpoint")).select(
        "symbol", "endpoint", F.when(dated, start).alias("start"),
        F.when(dated, as_of).alias("end"),
        F.when(F.col("endpoint") == "fetch-quarterly-financials", 8).alias("n_quarters"))


def plan_cost(calls: DataFrame) -> DataFrame:
    """Calls and credits per (stage, endpoint), with a total per stage and overall."""
    cost = F.create_map(*[x for e in K.ENDPOINTS for x in (F.lit(e), F.lit(K.call_cost(e)))])
    priced = calls.withColumn("cost", cost[F.col("endpoint")])
    return priced.rollup("stage", "endpoint").agg(
        F.count("*").alias("calls"), F.sum("cost").alias("credits"))
