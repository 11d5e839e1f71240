"""Cost ledger: positions, alarms, call statistics and request fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelens import constants as K


def caps(spark) -> DataFrame:
    rows = [(p, i, c) for i, (p, c) in enumerate(K.PHASE_CAPS.items())]
    return spark.createDataFrame(rows, "phase string, position int, cap int")


def spend_by_phase(ledger: DataFrame) -> DataFrame:
    """Every phase with its cap, spend, remainder, share and alarm flag, and a TOTAL row."""
    sums = ledger.groupBy("phase").agg(F.sum("credits").alias("spent"))
    rows = caps(ledger.sparkSession).join(sums, "phase", "left").withColumn(
        "spent", F.coalesce("spent", F.lit(0)))
    total = rows.rollup("phase").agg(F.sum("cap").alias("cap"), F.sum("spent").alias("spent"))
    pct = F.col("spent") / F.col("cap")
    return total.select(
        F.coalesce("phase", F.lit("TOTAL")).alias("phase"), "cap", "spent",
        (F.col("cap") - F.col("spent")).alias("remaining"), pct.alias("pct"),
        F.when(F.col("phase").isNull(), "").when(pct >= 0.90, "90%").when(pct >= 0.70, "70%")
        .otherwise("").alias("flag"))


def spend_by_endpoint(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("endpoint").agg(
        F.sum("credits").alias("credits"), F.count("*").alias("calls"),
        F.max("ts").alias("last_ts")).orderBy(F.desc("credits"), "endpoint")


def usage_by_model(usage: DataFrame) -> DataFrame:
    """Calls, tokens and seconds per (provider, model) and in total."""
    out = usage.rollup("provider", "model").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("seconds").alias("seconds"),
        F.grouping_id().alias("level"))
    return out.where(F.col("level").isin(0, 3)).select(
        F.when(F.col("level") == 3, "TOTAL").otherwise(F.coalesce("provider", F.lit("?")))
        .alias("provider"),
        F.when(F.col("level") == 3, "").otherwise(F.coalesce("model", F.lit("?")))
        .alias("model"), "calls", "input_tokens", "output_tokens", "seconds")


#: A crossing is searched by totals of ever smaller units.
CROSSING_UNITS = ("hour", "minute", "second")


def first_crossings(ledger: DataFrame, levels: list[float] | None = None) -> DataFrame:
    """The entry with which a phase first reached 70 % and 90 % of its cap.

    Hourly totals first (their running sum is short), then the minutes of that hour, the seconds
    of that minute, and only the entries of the second of the crossing are walked one by one: a
    phase with a third of the ledger is never sorted in one task.
    """
    entries = ledger.withColumns({unit: F.date_trunc(unit, "ts") for unit in CROSSING_UNITS})
    limits = caps(ledger.sparkSession).withColumn(
        "level", F.explode(F.array(*[F.lit(x) for x in levels or K.ALARM_LEVELS])))
    found, place = F.broadcast(limits).withColumn("before", F.lit(0).cast("long")), []
    for unit in CROSSING_UNITS:
        totals = entries.groupBy("phase", *place, unit).agg(F.sum("credits").alias("credits"))
        upto = W.partitionBy("phase", "level").orderBy(unit)
        running = totals.join(found, ["phase", *place]).withColumn(
            "after", F.col("before") + F.sum("credits").over(upto))
        reached = running.where(F.col("after") / F.col("cap") >= F.col("level"))
        place = [*place, unit]
        found = reached.groupBy("phase", "level", "cap").agg(
            F.min_by(F.struct(*place, (F.col("after") - F.col("credits")).alias("before")), unit)
            .alias("first")).select("phase", "level", "cap", "first.*")
    walk = W.partitionBy("phase", "level").orderBy("ts", "event_id")
    inside = found.join(entries.select("phase", *place, "ts", "event_id", "credits"),
                        ["phase", *place])
    spent = inside.withColumn("spent", F.col("before") + F.sum("credits").over(walk)).where(
        F.col("spent") / F.col("cap") >= F.col("level"))
    return spent.groupBy("phase", "level", "cap").agg(
        F.min(F.struct("ts", "event_id", "spent")).alias("hit")).select(
        "phase", "level", "cap", "hit.ts", "hit.event_id", "hit.spent")


def call_stats(calls: DataFrame) -> DataFrame:
    """Calls, cache hits, hit rate, paid credits and retries per transport and in total."""
    paid = F.sum(F.when(F.col("cached"), 0).otherwise(F.col("credits")))
    out = calls.rollup("transport").agg(
        F.count("*").alias("calls"), F.count_if("cached").alias("cache_hits"),
        paid.alias("credits"), F.sum("retries").alias("retries"))
    return out.select(
        F.coalesce("transport", F.lit("TOTAL")).alias("transport"), "calls", "cache_hits",
        (F.col("cache_hits") / F.col("calls")).alias("hit_rate"), "credits", "retries")


def canonical_params(params: Column) -> Column:
    """Params as JSON text with sorted keys and without nulls."""
    entries = F.array_sort(F.map_entries(F.map_filter(params, lambda _, v: v.isNotNull())))
    return F.to_json(F.map_from_entries(entries))


def fingerprint(endpoint: Column, params: Column) -> Column:
    """The transport is left out: the same request by another route is the same data."""
    return F.sha2(F.concat_ws("|", endpoint, canonical_params(params)), 256)


def first_calls(calls: DataFrame) -> DataFrame:
    """One paid call per fingerprint, the earliest; later repeats are counted, not paid."""
    return calls.groupBy("fingerprint").agg(
        F.min(F.struct("ts", "event_id", "credits")).alias("first"),
        F.count("*").alias("requests")).select(
        "fingerprint", "first.ts", "first.event_id", "first.credits", "requests")


def recently_bought(ledger: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(endpoint, symbol) pairs with a purchase in the last `days` days."""
    last = ledger.where("symbol is not null").groupBy("endpoint", "symbol").agg(
        F.max(F.to_date("ts")).alias("last_bought"))
    return last.withColumn("recent", F.col("last_bought") >= F.date_sub(as_of, days))
