"""Labels and matched controls for the calibration study."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S
from tapelens.operators import pit
from tapelens.session import cut_lineage


# -- labels -------------------------------------------------------------------------------------
def reason_class(reason: Column) -> Column:
    text = F.coalesce(reason, F.lit(""))
    return (
        F.when(text.rlike(f"(?i){K.MOVEMENT_PATTERN}"), "pergerakan")
        .when(text.rlike(f"(?i){K.ADMIN_PATTERN}"), "administratif")
        .otherwise("tak_terklasifikasi")
    )


def classified(tables) -> DataFrame:
    return tables["suspensions"].withColumn("reason_class", reason_class(F.col("reason")))


def keyword_labels(tables, as_of, months: int = K.SSS_MONTHS) -> DataFrame:
    """Suspensions of the window with the keywords found; positive if there is one."""
    day = F.lit(as_of).cast("date")
    known = pit.pit_filter(tables["suspensions"], "suspensions", as_of)
    recent = known.where(F.col("start_date") >= S.months_back(day, months, first_of_month=True))
    found = S.keywords_found(F.col("reason"), K.POSITIVE_REASONS)
    return (
        recent.select("symbol", "start_date", F.coalesce("reason", F.lit("")).alias("reason"),
                      found.alias("matched_keywords"))
        .withColumn("is_positive", F.size("matched_keywords") > 0)
        .orderBy(F.desc("is_positive"), "start_date", "symbol")
    )


def positives_ranked(tables, as_of=None) -> DataFrame:
    """Positive events per symbol: how many and the latest, newest first."""
    rows = tables["suspensions"]
    if as_of is not None:
        rows = pit.pit_filter(rows, "suspensions", as_of)
    positive = rows.where(S.keyword_any(F.col("reason"), K.POSITIVE_REASONS))
    return positive.groupBy("symbol").agg(
        F.count("*").alias("events"), F.max("start_date").alias("latest")
    ).orderBy(F.desc("latest"), "symbol")


def collapse_episodes(suspensions: DataFrame, gap_days: int = K.EPISODE_GAP_DAYS) -> DataFrame:
    """Keep an event only if it lies more than `gap_days` after the last event kept.

    The anchor moves only on kept events, so this is a fold and not a gap session. The folded
    array holds one entry per (symbol, start_date), the table's key.
    """
    day_type = "struct<last: date, kept: array<struct<start_date: date, reason: string>>>"
    empty = F.struct(F.lit(None).cast("date").alias("last"),
                     F.array().alias("kept")).cast(day_type)

    def step(acc: Column, event: Column) -> Column:
        fresh = acc["last"].isNull() | (F.datediff(event["start_date"], acc["last"]) > gap_days)
        grown = F.struct(event["start_date"].alias("last"),
                         F.concat(acc["kept"], F.array(event)).alias("kept")).cast(day_type)
        return F.when(fresh, grown).otherwise(acc)

    events = suspensions.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("start_date", "reason"))).alias("events"))
    kept = F.aggregate("events", empty, step, lambda acc: acc["kept"])
    return events.select("symbol", F.inline(kept)).select(
        "symbol", F.col("start_date").alias("event_date"), "reason")


def price_universe(tables, min_rows: int = K.MIN_PRICE_ROWS) -> DataFrame:
    """Symbols with enough price rows to be measured at all."""
    return pit.price_history(tables).groupBy("symbol").agg(
        F.count("*").alias("price_rows")).where(F.col("price_rows") >= min_rows)


def assessable_events(tables, events: DataFrame) -> DataFrame:
    """Events whose symbol has a price history and whose T-10 session exists."""
    calendar = pit.trading_calendar(tables)
    reachable = pit.with_end_session(events, calendar, strictly_before=True, on="event_date")
    return (
        reachable.where(F.col("end_idx") >= max(K.LAGS)).drop("end_idx")
        .join(price_universe(tables).select("symbol"), "symbol", "left_semi")
    )


# -- controls -------------------------------------------------------------------------------------
def _nearest(wanted: DataFrame, pool: DataFrame, by: list[str], value: str, count: int,
             radius: float | None = None) -> DataFrame:
    """For each wanted row the `count` pool rows nearest in `value`, ties by symbol. Exact.

    Only `count` neighbours below and above can be among the nearest, so each wanted row looks
    up 2 x count positions of the sorted pool by equality; pairs are never enumerated. Below,
    equal values are ranked with the smallest symbol nearest, as above.
    """
    v = F.col(value)
    pool = pool.select(*by, "symbol", v.alias("_v"))
    below = W.partitionBy(*by).orderBy(F.col("_v").asc(), F.col("symbol").desc())
    above = W.partitionBy(*by).orderBy(F.col("_v").asc(), F.col("symbol").asc())
    ranked = pool.withColumn("_below", F.row_number().over(below)).withColumn(
        "_above", F.row_number().over(above))
    points = pool.select(*by, F.col("_v"), F.lit(1).alias("_one")).unionByName(
        wanted.select(*by, v.alias("_v"), F.struct(*wanted.columns).alias("_w")),
        allowMissingColumns=True)
    upto = W.partitionBy(*by).orderBy("_v").rangeBetween(W.unboundedPreceding, W.currentRow)
    placed = points.withColumn("_at", F.coalesce(F.sum("_one").over(upto), F.lit(0))).where(
        "_w is not null").select(*by, "_w", "_v", "_at")
    steps = F.sequence(F.lit(1), F.lit(count))
    lows = placed.withColumn("_pos", F.explode(F.transform(
        steps, lambda s: F.col("_at") - s + 1))).join(
        ranked.select(*by, F.col("_below").alias("_pos"), F.col("symbol").alias("match"),
                      F.col("_v").alias("match_value")), [*by, "_pos"])
    highs = placed.withColumn("_pos", F.explode(F.transform(
        steps, lambda s: F.col("_at") + s))).join(
        ranked.select(*by, F.col("_above").alias("_pos"), F.col("symbol").alias("match"),
                      F.col("_v").alias("match_value")), [*by, "_pos"])
    both = lows.unionByName(highs).withColumn("distance", F.abs(F.col("match_value") - F.col("_v")))
    if radius is not None:
        both = both.where(F.col("distance") <= radius)
    order = W.partitionBy("_w").orderBy("distance", "match")
    best = both.withColumn("match_rank", F.row_number().over(order)).where(
        F.col("match_rank") <= count)
    return best.select("_w.*", "match", "match_value", "distance", "match_rank")


def controls_with_reuse(tables, positives: DataFrame,
                        count: int = K.CONTROLS_PER_POSITIVE) -> DataFrame:
    """`count` controls per positive event, same date, from symbols never positive.

    Same sub-sector (a missing one equals a missing one), nearest log market cap, ties by
    symbol, an unknown cap is infinitely far; without a candidate in the sub-sector the whole
    pool is searched.
    """
    cap = F.col("market_cap").cast("double")
    profile = tables["company_profile"].select(
        "symbol", F.coalesce("sub_sector", F.lit("\u0000")).alias("sector"),
        F.when(cap > 0, F.log10(cap)).alias("log_cap"))
    anyone = "\u0001"
    sector = F.coalesce("sector", F.lit("\u0000"))
    # A few rows per listed security, read by several branches below.
    candidates = cut_lineage(
        price_universe(tables).select("symbol")
        .join(positives.select("symbol").distinct(), "symbol", "left_anti")
        .join(profile, "symbol", "left").withColumn("sector", sector)
    )
    has = candidates.select("sector").distinct().withColumn("has", F.lit(True))
    wanted = (
        positives.select("symbol").distinct().join(profile, "symbol", "left")
        .withColumn("sector", sector).join(has, "sector", "left")
        .select(F.col("symbol").alias("positive"),
                F.when(F.col("has"), F.col("sector")).otherwise(anyone).alias("pool"), "log_cap")
    )
    wanted = cut_lineage(wanted)
    # the whole pool takes part only where a sector without candidates asks for it
    pool = candidates.withColumn("pool", F.explode(F.array("sector", F.lit(anyone)))).select(
        "pool", "symbol", "log_cap").join(wanted.select("pool").distinct(), "pool", "left_semi")
    near = _nearest(wanted.where("log_cap is not null"), pool.where("log_cap is not null"),
                    ["pool"], "log_cap", count).select("positive", "match", "distance")
    # Infinitely far: by symbol, only where fewer than `count` measured ones are left.
    far = pool.withColumn("far_rank", F.row_number().over(
        W.partitionBy("pool", F.col("log_cap").isNull()).orderBy("symbol")))
    blind = pool.withColumn("far_rank", F.row_number().over(
        W.partitionBy("pool").orderBy("symbol"))).where(F.col("far_rank") <= count)
    rest = (
        wanted.where("log_cap is not null").select("positive", "pool")
        .join(far.where("log_cap is null").where(F.col("far_rank") <= count), "pool")
        .unionByName(wanted.where("log_cap is null").select("positive", "pool")
                     .join(blind, "pool"))
        .select("positive", F.col("symbol").alias("match"),
                F.lit(float("inf")).alias("distance"))
    )
    order = W.partitionBy("positive").orderBy("distance", "match")
    chosen = near.unionByName(rest).withColumn("match_rank", F.row_number().over(order)).where(
        F.col("match_rank") <= count)
    return positives.select(F.col("symbol").alias("positive"), "event_date").join(
        chosen, "positive").select(
        F.col("match").alias("symbol"), "event_date", "positive", "match_rank")


def controls_unique(tables, positives: DataFrame, per_positive: int = 2, as_of=None) -> DataFrame:
    """Nearest market cap in the same sub-sector, each control used once.

    A security without a sub-sector is in no group: it gets no control and is none. With
    `as_of`, only profiles known by then take part.

    Choosing without replacement depends on the order of the positives (`rank`), so a
    sub-sector is one sequential pass. It holds one row per listed security of that
    sub-sector, and the sub-sectors run in parallel; a listing is thousands of rows at any size
    of the trade tables.
    """
    cap = F.col("market_cap").cast("double").alias("cap")
    listed = tables["company_profile"]
    if as_of is not None:
        listed = pit.pit_filter(listed, "company_profile", as_of)
    profile = listed.where("market_cap is not null and sub_sector is not null").select(
        "symbol", F.col("sub_sector").alias("sector"), cap)
    rows = profile.join(positives.select("symbol", "rank"), "symbol", "left")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        wanted = group[group["rank"].notna()].sort_values("rank")
        free = group[group["rank"].isna()].sort_values("symbol")
        chosen = []
        for positive, value in zip(wanted["symbol"], wanted["cap"]):
            gap = (free["cap"] - value).abs().sort_values(kind="stable").head(per_positive)
            taken = free.loc[gap.index]
            chosen += [(positive, s, g) for s, g in zip(taken["symbol"], gap)]
            free = free.drop(gap.index)
        return pd.DataFrame(chosen, columns=["positive", "symbol", "cap_gap"])

    return rows.groupBy("sector").applyInPandas(
        pick, "positive string, symbol string, cap_gap double")


def matched_pairs(tables, as_of=None, size: int = 8,
                  tolerance: float = K.FLOAT_TOLERANCE) -> DataFrame:
    """Positives (newest first) each paired with one never-suspended symbol of similar float.

    Neighbours meet by equality in float buckets as wide as the tolerance, so nothing goes through
    one group. At most `size` controls are ever taken, so only the `size` nearest of each
    positive can matter; every pair is then one aggregation over those short lists, for the
    newest positive behind the last one that still has a control, and the driver holds `size` rows.
    """
    floats = tables["free_float"].where("free_float_pct is not null")
    suspended = tables["suspensions"]
    if as_of is not None:
        floats = pit.pit_filter(floats, "free_float", as_of)
        suspended = pit.pit_filter(suspended, "suspensions", as_of)
    newest = floats.groupBy("symbol").agg(
        F.max_by("free_float_pct", "as_of").alias("free_float"))
    bucket = F.floor(F.col("free_float") / tolerance)
    pool = newest.join(suspended.select("symbol").distinct(), "symbol", "left_anti").select(
        bucket.alias("bucket"), F.col("symbol").alias("control"),
        F.col("free_float").alias("control_float"))
    wanted = positives_ranked(tables, as_of).join(newest, "symbol").select(
        F.col("symbol").alias("positive"), "events", "latest",
        F.col("free_float").alias("positive_float"),
        F.explode(F.transform(F.array(*map(F.lit, (-2, -1, 0, 1, 2))), lambda d: bucket + d)).alias("bucket"))
    near = wanted.join(pool, "bucket").withColumn(
        "float_gap", F.abs(F.col("control_float") - F.col("positive_float"))).where(
        F.col("float_gap") <= tolerance)
    nearest = W.partitionBy("positive").orderBy("float_gap", "control")
    short = cut_lineage(near.withColumn("place", F.row_number().over(nearest)).where(
        F.col("place") <= size).drop("bucket"))
    columns = ["positive", "events", "latest", "positive_float", "control", "control_float", "float_gap"]
    newest_first = F.struct((-F.unix_date("latest")).alias("age"), "positive", "place", F.struct(*columns).alias("row"))
    pairs, behind = [], short
    while len(pairs) < size:
        found = behind.agg(F.min(newest_first).alias("best")).first().best
        if found is None:
            break
        pairs.append((len(pairs) + 1, *found.row))
        later = (-F.unix_date("latest") > found.age) | (
            (-F.unix_date("latest") == found.age) & (F.col("positive") > found.positive))
        behind = short.where(later & ~F.col("control").isin([row[5] for row in pairs]))
    return tables["suspensions"].sparkSession.createDataFrame(
        pairs, "pair int, positive string, events long, latest date, positive_float double, "
               "control string, control_float double, float_gap double")


# -- universes ----------------------------------------------------------------------------------------
def global_positions(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `position` from 1 in the whole order, without sorting in one task.

    Ranges are numbered by themselves and shifted by the sizes of the earlier ones; the driver
    holds one number per range.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    starts = [sum(n for other, n in sizes.items() if other < at) for at in range(max(sizes, default=0) + 1)]
    shift = F.get(F.array(*map(F.lit, starts)), F.col("_range"))
    inside = W.partitionBy("_range").orderBy(*order)
    return ranged.withColumn("position", (F.row_number().over(inside) + shift).cast("int")).drop("_range")


def ordered_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two symbol lists (symbol, rank): all of the first by rank, then the second."""
    both = first.select("symbol", F.lit(0).alias("list"), "rank").unionByName(
        second.select("symbol", F.lit(1).alias("list"), "rank"))
    best = both.groupBy("symbol").agg(F.min(F.struct("list", "rank")).alias("place"))
    return global_positions(best.select("place.*", "symbol"), "list", "rank", "symbol").select("symbol", "position")


def universe_by_frequency(tables, as_of=None, size: int = 80) -> DataFrame:
    """Ever-suspended symbols first, then the most traded ones, `size` in all.

    Neither list can give more than `size` symbols, so each is cut before it is numbered.
    """
    trades, suspended = tables["daily_transaction"], tables["suspensions"]
    if as_of is not None:
        trades = pit.pit_filter(trades, "daily_transaction", as_of)
        suspended = pit.pit_filter(suspended, "suspensions", as_of)
    frequent = trades.groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(size)
    required = suspended.select("symbol").distinct().orderBy("symbol").limit(size)
    return ordered_union(
        required.select("symbol", F.struct(F.lit(0).cast("long").alias("n"), "symbol").alias("rank")),
        frequent.select("symbol", F.struct((-F.col("n")).alias("n"), "symbol").alias("rank")),
    ).where(F.col("position") <= size)


def evaluation_universe(tables, min_sessions: int = K.MIN_PRICE_ROWS) -> DataFrame:
    traded = tables["daily_transaction"].groupBy("symbol").agg(F.count("*").alias("sessions"))
    broker = tables["broker_summary"].select("symbol").distinct().withColumn(
        "has_broker", F.lit(True))
    stopped = tables["suspensions"].select("symbol").distinct().withColumn(
        "ever_suspended", F.lit(True))
    out = traded.where(F.col("sessions") >= min_sessions).join(broker, "symbol", "left").join(
        stopped, "symbol", "left")
    return out.select(
        "symbol", "sessions", F.coalesce("has_broker", F.lit(False)).alias("has_broker"),
        F.coalesce("ever_suspended", F.lit(False)).alias("ever_suspended"),
    ).orderBy(F.desc("ever_suspended"), F.desc("has_broker"), F.desc("sessions"), "symbol")
