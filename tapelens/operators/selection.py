"""Who is investigated next: memory, cool-down, requests and refill decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.operators import pit


def recall(grid: DataFrame, investigations: DataFrame) -> DataFrame:
    """The latest investigation strictly before each grid date, as struct `memory`."""
    facts = investigations.select("symbol", F.col("as_of").alias("seen_on"), "score", "band",
                                  "confidence", "credits_total")
    return pit.asof_join(grid, facts, by=["symbol"], grid_on="as_of", fact_on="seen_on",
                         values=["seen_on", "score", "band", "confidence", "credits_total"],
                         strict=True, name="memory")


def cooldown_selection(candidates: DataFrame, investigations: DataFrame, calendar: DataFrame,
                       requests: DataFrame | None = None, top: int = K.DEFAULT_TOP) -> DataFrame:
    """Status of every candidate of a day: investigate, cooldown, done or null (not reached).

    `candidates` holds ranked rows (as_of, symbol, rank, score), at most a watchlist per day.
    A cooled candidate gives its place to the next reserve; one already investigated that day
    keeps its place; a requested symbol comes first and is exempt from the cool-down.
    """
    keys = ["symbol", "as_of"]
    remembered = recall(candidates.select(*keys), investigations).select(
        *keys, F.col("memory.seen_on").alias("seen_on"),
        F.col("memory.confidence").alias("seen_confidence"))
    earlier = candidates.select("symbol", F.col("as_of").alias("seen_on"),
                                F.col("score").alias("seen_score"))
    done = investigations.select(*keys).distinct().withColumn("done", F.lit(True))
    rows = (
        candidates.join(remembered, keys, "left").join(earlier, ["symbol", "seen_on"], "left")
        .join(done, keys, "left")
    )
    rows = pit.with_end_session(rows, calendar)
    oldest = calendar.select(F.col("session_idx").alias("_oldest"),
                             F.col("trade_date").alias("oldest_day"))
    rows = rows.withColumn("_oldest", F.greatest(
        F.col("end_idx") - K.COOLDOWN_SESSIONS, F.lit(1))).join(oldest, "_oldest", "left")
    if requests is None:
        rows = rows.withColumn("requested", F.lit(False))
    else:
        asked = requests.select(*keys).distinct().withColumn("requested", F.lit(True))
        rows = rows.join(asked, keys, "left").withColumn(
            "requested", F.coalesce("requested", F.lit(False)))
    cooled = F.coalesce(
        (F.col("seen_confidence") >= K.COOLDOWN_CONFIDENCE)
        & (F.col("seen_on") >= F.col("oldest_day"))
        & (F.abs(F.col("score") - F.col("seen_score")) < K.COOLDOWN_MOVE), F.lit(False))
    is_done = F.coalesce("done", F.lit(False))
    rows = rows.withColumn("cooled", cooled & ~F.col("requested") & ~is_done)
    # Places taken before this row by candidates that keep theirs. Requests from the reserve
    # do not take a place of the list.
    takes = (~F.col("cooled")) & ~(F.col("requested") & (F.col("rank") > top))
    before = W.partitionBy("as_of").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(takes.cast("int")).over(before), F.lit(0))
    reached = F.col("requested") | (taken < top)
    status = F.when(~reached, None).when(is_done, "done").when(
        F.col("cooled"), "cooldown").otherwise("investigate")
    return rows.withColumn("status", status).select(
        "as_of", "symbol", "rank", "score", "requested", "seen_on", "status")


def request_code(title: Column, body: Column) -> Column:
    """The code asked for: the form field if there is one, else "selidiki: XXXX"."""
    field = F.regexp_extract(
        F.coalesce(body, F.lit("")), r"(?i)###\s*Kode emiten\s*\n+\s*([^\s\n]+)", 1)
    heading = F.regexp_extract(
        F.coalesce(title, F.lit("")), r"(?i)^\s*selidiki\s*:\s*(\S+)", 1)
    return F.upper(F.trim(F.coalesce(F.nullif(field, F.lit("")), F.nullif(heading, F.lit("")))))


def request_quota(requests: DataFrame, known: DataFrame, quota: int = K.REQUEST_QUOTA,
                  by: str = "day") -> DataFrame:
    """First `quota` distinct valid codes per day are accepted, repeats of them too.

    Requests (day, seq, code) are folded to one row per (day, code) before any ordering; an
    invalid code is rejected and its content erased.
    """
    sound = requests.join(known.select(F.col("symbol").alias("code")), "code", "left_semi")
    firsts = sound.groupBy(by, "code").agg(F.min("seq").alias("first_seq"))
    order = W.partitionBy(by).orderBy("first_seq")
    accepted = firsts.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= quota).select(by, "code", F.lit("accepted").alias("_status"))
    valid = firsts.select(by, "code", F.lit(True).alias("_valid"))
    rows = requests.join(valid, [by, "code"], "left").join(accepted, [by, "code"], "left")
    status = F.when(F.col("_valid").isNull(), "rejected").otherwise(
        F.coalesce("_status", F.lit("deferred")))
    return rows.withColumn("status", status).select(
        by, "seq", F.when(F.col("_valid"), F.col("code")).alias("symbol"), "status")


def request_outcome(requests: DataFrame, outcomes: DataFrame, by: str = "day") -> DataFrame:
    """Accepted requests take the outcome of their symbol; one without an outcome failed."""
    found = outcomes.select(by, "symbol", F.col("status").alias("_outcome"))
    return requests.join(found, [by, "symbol"], "left").withColumn(
        "status", F.when(F.col("status") == "accepted",
                         F.coalesce("_outcome", F.lit("failed"))).otherwise(F.col("status"))
    ).drop("_outcome")


def freshness_gaps(tables, grid: DataFrame, table: str = "daily_transaction",
                   holes_count: bool = True, since=None) -> DataFrame:
    """Is a symbol's series behind the last session, or missing one since its first row?

    Sessions are counted, not listed: span minus rows is the number of holes. With `since` the
    count starts there, or at the first row where that is later.
    """
    calendar = pit.trading_calendar(tables)
    markers = pit.with_end_session(grid, calendar).select(
        "symbol", F.col("end_idx").alias("session_idx"), "as_of")
    facts = pit.with_session(tables[table].select("symbol", "trade_date").distinct(), calendar)
    rows = facts.select("symbol", "session_idx", F.lit(1).alias("n")).unionByName(
        markers, allowMissingColumns=True)
    upto = W.partitionBy("symbol").orderBy("session_idx").rangeBetween(
        W.unboundedPreceding, W.currentRow)
    has = F.when(F.col("n") == 1, F.col("session_idx"))
    start = F.lit(1) if since is None else calendar.where(
        F.col("trade_date") >= F.lit(since).cast("date")).agg(F.min("session_idx")).scalar()
    inside = F.when(F.col("session_idx") >= start, F.col("n"))
    seen = rows.select(
        "symbol", "as_of", "session_idx", F.count(inside).over(upto).alias("rows"),
        F.greatest(F.min(has).over(upto), start).alias("first_idx"),
        F.max(has).over(upto).alias("last_idx"),
    ).where("as_of is not null")
    behind = F.col("last_idx") < F.col("session_idx")
    holes = F.col("last_idx") - F.col("first_idx") + 1 - F.col("rows")
    holes = F.greatest(holes, F.lit(0))
    lag = F.coalesce(behind | ((holes > 0) if holes_count else F.lit(False)), F.lit(False))
    return seen.select("symbol", "as_of", "rows", F.coalesce(behind, F.lit(False))
                       .alias("behind"), F.coalesce(holes, F.lit(0)).alias("holes"),
                       lag.alias("stale"))


def fetch_decisions(gaps: DataFrame, bought: DataFrame, endpoint: str, budget: Column,
                    min_rows: int = 1) -> DataFrame:
    """Which symbols to refill: too few rows or stale, not just bought, and affordable."""
    paid = bought.where(F.col("endpoint") == endpoint).select("symbol", "recent")
    short = (F.col("rows") < min_rows) | F.col("stale")
    affordable = F.lit(K.call_cost(endpoint)) <= budget
    out = gaps.join(paid, "symbol", "left").withColumn(
        "recent", F.coalesce("recent", F.lit(False)))
    return out.withColumn("needed", short & ~F.col("recent")).withColumn(
        "affordable", affordable).withColumn(
        "fetch", F.col("needed") & F.col("affordable"))


def profile_signals(tables) -> DataFrame:
    """Sessions available, price change over the history, sub-sector and cap per symbol."""
    prices = pit.price_history(tables).groupBy("symbol").agg(
        F.count("*").alias("sessions"),
        F.min_by("close_price", "trade_date").alias("first_price"),
        F.max_by("close_price", "trade_date").alias("last_price"))
    change = F.when((F.col("sessions") >= 2) & (F.col("first_price") > 0),
                    F.col("last_price") / F.col("first_price") - 1)
    return prices.withColumn("price_change", change).join(
        tables["company_profile"].select("symbol", "sub_sector", "market_cap"), "symbol",
        "left").select("symbol", "sessions", "price_change", "sub_sector", "market_cap")


def rule_finding(sub_score: Column) -> Column:
    return F.when(sub_score.isNull(), "inconclusive").when(
        sub_score >= 60, "confirmed").otherwise("refuted")


def conclude_gate(confidence: Column, cheapest_left: Column, budget_left: Column,
                  minimum: float = 0.4) -> Column:
    """True if an investigation may stop: sure enough, or nothing affordable is left."""
    affordable = F.coalesce(cheapest_left <= budget_left, F.lit(False))
    return (confidence >= minimum) | ~affordable
