"""The six probes: grid (symbol, as_of) -> sub-score 0-100, or the reason there is none.

Every probe returns `symbol, as_of, sub_score, unavailable_reason` plus its measured numbers;
`evidence_rows` turns the numbers into citable rows. Nulls mean "not measured" and are never
turned into zeros.

The three price-and-flow probes share one session panel: a single shuffle on the symbol feeds
all their windows. A panel row is unique per (symbol, session), so a window partition is as
long as the calendar and no longer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S
from tapelens.operators import pit
from tapelens.session import cut_lineage


#: The longest window of the probes that share the panel.
LONGEST = max(K.VAS_LOOKBACK, K.PFD_SESSIONS, K.FRD_SESSIONS)


# -- shared pieces ----------------------------------------------------------------------------
def array_median(values: Column) -> Column:
    """Exact median of a short array."""
    return S.let(F.array_sort(values), lambda a: (
        F.get(a, F.floor(F.size(a) / 2).cast("int"))
        + F.get(a, F.floor((F.size(a) - 1) / 2).cast("int"))) / 2)


def robust_baseline(values: Column) -> Column:
    """struct(median, spread): median and 1.4826 x median absolute deviation."""
    return S.let(array_median(values), lambda m: F.struct(
        m.alias("median"),
        (array_median(F.transform(values, lambda v: F.abs(v - m))) * K.MAD_TO_SIGMA)
        .alias("spread")))


def robust_by_key(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and spread per key by two aggregations, for histories of any length."""
    centre = rows.groupBy(*keys).agg(F.median(value).alias("median"))
    apart = rows.join(centre, keys).groupBy(*keys, "median")
    return apart.agg((F.median(F.abs(F.col(value) - F.col("median"))) * K.MAD_TO_SIGMA).alias("spread"))


def result(df: DataFrame, checks: list[tuple[Column, str | Column]], score: Column,
           *measured: str) -> DataFrame:
    """Apply the give-up checks in order: the first that fails names the reason."""
    reason = F.lit(None).cast("string")
    for failed, text in reversed(checks):
        text = F.lit(text) if isinstance(text, str) else text
        reason = F.when(F.coalesce(failed, F.lit(False)), text).otherwise(reason)
    out = df.withColumn("unavailable_reason", reason)
    ok = F.col("unavailable_reason").isNull()
    return out.select(
        "symbol", "as_of",
        F.when(ok, S.half_even(score, 1)).alias("sub_score"), "unavailable_reason",
        *[F.when(ok, F.col(m)).alias(m) for m in measured],
    )


def session_panel(tables, grid: DataFrame, calendar: DataFrame,
                  sources: tuple[str, ...] = ("tx", "price", "flow"), sessions: int = LONGEST,
                  sparse: bool = False) -> DataFrame:
    """Rows per (symbol, session) with what the tables say, plus the grid rows as markers.

    Rows that no window of `sessions` sessions of the grid can hold are not read.
    """
    ended = pit.with_end_session(grid, calendar)
    read = pit.window_reader(tables, ended, calendar, sessions, sparse)
    parts = []
    if "tx" in sources:
        parts.append(read("daily_transaction").select(
            "symbol", "trade_date", F.col("close_price").alias("tx_close"), "volume"))
    if "price" in sources:
        parts.append(pit.price_history(tables, read))
    if "flow" in sources:
        parts.append(read("foreign_flow").select(
            "symbol", "trade_date", F.col("net_value").alias("net_foreign")))
    facts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = [c for c in facts.columns if c not in ("symbol", "trade_date")]
    facts = facts.repartition("symbol").groupBy("symbol", "trade_date").agg(
        *[F.max(c).alias(c) for c in values])
    facts = pit.with_session(facts, calendar)
    markers = ended.select("symbol", F.col("end_idx").alias("session_idx"), "as_of")
    return facts.unionByName(markers, allowMissingColumns=True)


def _span(sessions: int):
    return W.partitionBy("symbol").orderBy("session_idx").rangeBetween(-(sessions - 1), 0)


def _on_grid(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("as_of").isNotNull())


# -- VAS ----------------------------------------------------------------------------------------
def _volume_columns() -> dict[str, Column]:
    seen = F.when(F.col("volume").isNotNull(),
                  F.struct("session_idx", F.col("volume").cast("double").alias("v"), "trade_date"))
    return {"volume_window": F.collect_list(seen).over(_span(K.VAS_LOOKBACK))}


def _volume_score(panel: DataFrame) -> DataFrame:
    window = F.array_sort("volume_window")
    n = F.size("w")
    first = F.greatest(n - K.VAS_BASELINE, F.lit(1))
    baseline = F.transform(F.slice("w", first, F.greatest(n - first, F.lit(0))), lambda r: r["v"])
    out = (
        panel.withColumn("w", window).withColumn("baseline", baseline)
        .withColumn("baseline_rows", F.size("baseline"))
        .withColumn("latest_volume", F.try_element_at("w", F.lit(-1))["v"])
        .withColumn("evidence_day", F.try_element_at("w", F.lit(-1))["trade_date"])
        .withColumn("robust", robust_baseline(F.col("baseline")))
        .withColumn("median_volume", F.col("robust.median"))
        .withColumn("spread", F.col("robust.spread"))
        .withColumn("zscore", F.when(F.col("spread") > 0, (F.col("latest_volume")
                    - F.col("median_volume")) / F.col("spread")))
        .withColumn("volume_ratio", F.when(F.col("median_volume") != 0,
                    F.col("latest_volume") / F.col("median_volume")))
    )
    checks = [
        (F.size("w") == 0, "no transactions in the window"),
        (F.col("baseline_rows") < K.VAS_MIN_BASELINE, F.concat(
            F.lit("volume history of "), F.col("baseline_rows").cast("string"),
            F.lit(f" sessions, {K.VAS_MIN_BASELINE} needed"))),
        (F.col("spread") <= 0, "no spread in the baseline volume"),
    ]
    return result(out, checks, S.ramp(F.col("zscore"), 0.0, 6.0),
                  "zscore", "volume_ratio", "evidence_day")


def volume_anomaly(tables, grid: DataFrame) -> DataFrame:
    calendar = pit.trading_calendar(tables)
    panel = session_panel(tables, grid, calendar, ("tx",), K.VAS_LOOKBACK).withColumns(_volume_columns())
    return _volume_score(_on_grid(panel))


# -- PFD ----------------------------------------------------------------------------------------
def _price_columns() -> dict[str, Column]:
    span = _span(K.PFD_SESSIONS)
    priced = F.when(F.col("close_price").isNotNull(), F.col("trade_date"))
    return {
        "price_rows": F.count("close_price").over(span),
        "first_price": F.first("close_price", ignorenulls=True).over(span),
        "last_price": F.last("close_price", ignorenulls=True).over(span),
        "price_day": F.max(priced).over(span),
    }


def earnings_growth(tables) -> DataFrame:
    """Per report: net income against the one four reports earlier (by position)."""
    order = W.partitionBy("symbol").orderBy("report_date")
    income = F.col("net_income").cast("double")
    reports = tables["quarterly_financials"].where("net_income is not null")
    return (
        reports.withColumn("quarters", F.row_number().over(order))
        .withColumn("base", F.lag(income, K.PFD_LAG_QUARTERS).over(order))
        .withColumn("yoy", F.when(F.col("base") != 0, (income - F.col("base")) / F.abs("base")))
        .select("symbol", "report_date", "quarters", "base", "yoy")
    )


def _divergence_score(tables, panel: DataFrame) -> DataFrame:
    known = pit.asof_join(
        panel, earnings_growth(tables), by=["symbol"], grid_on="as_of", fact_on="report_date",
        values=["report_date", "quarters", "base", "yoy"], name="report")
    quarters = F.coalesce(F.col("report.quarters"), F.lit(0))
    out = (
        known.withColumn("return_90d", F.when(
            F.col("first_price") > 0, F.col("last_price") / F.col("first_price") - 1))
        .withColumn("earnings_change", F.col("report.yoy"))
        .withColumn("divergence", F.col("return_90d") - F.col("earnings_change"))
        .withColumn("report_day", F.col("report.report_date"))
    )
    checks = [
        (F.col("price_rows") < K.PFD_MIN_SESSIONS, F.concat(
            F.lit("price history of "), F.col("price_rows").cast("string"),
            F.lit(f" sessions, {K.PFD_MIN_SESSIONS} needed"))),
        (F.col("first_price") <= 0, "first price of the window is not positive"),
        (quarters <= K.PFD_LAG_QUARTERS, F.concat(
            F.lit("reports for "), quarters.cast("string"),
            F.lit(f" quarters, more than {K.PFD_LAG_QUARTERS} needed"))),
        (F.col("report.base") == 0, "net income a year earlier is zero"),
    ]
    return result(out, checks, S.ramp(F.col("divergence"), 0.25, 2.50),
                  "return_90d", "earnings_change", "divergence", "price_day", "report_day")


def price_fundamental(tables, grid: DataFrame) -> DataFrame:
    calendar = pit.trading_calendar(tables)
    panel = session_panel(tables, grid, calendar, ("price",), K.PFD_SESSIONS).withColumns(_price_columns())
    kept = _on_grid(panel).select("symbol", "as_of", *_price_columns())
    return _divergence_score(tables, kept)


# -- FRD ----------------------------------------------------------------------------------------
def _flow_columns() -> dict[str, Column]:
    span = _span(K.FRD_SESSIONS)
    priced = F.when(F.col("tx_close").isNotNull(), F.col("trade_date"))
    turnover = F.col("tx_close") * F.coalesce(F.col("volume").cast("double"), F.lit(0.0))
    return {
        "flow_rows": F.count("net_foreign").over(span),
        "foreign_net": F.sum("net_foreign").over(span),
        "market_rows": F.count("tx_close").over(span),
        "turnover": F.sum(turnover).over(span),
        "first_close": F.first("tx_close", ignorenulls=True).over(span),
        "last_close": F.last("tx_close", ignorenulls=True).over(span),
        "market_day": F.max(priced).over(span),
    }


def with_flow_between_sessions(tables, grid: DataFrame, calendar: DataFrame,
                               panel: DataFrame) -> DataFrame:
    """Add the flow of days that are no session to the window sums of the panel.

    Such rows are rare; they are joined to their windows by themselves.
    """
    ended = pit.with_end_session(grid.select("symbol", "as_of"), calendar).withColumn(
        "start_idx", F.col("end_idx") - (K.FRD_SESSIONS - 1))
    rows = pit.window_reader(tables, ended, calendar, K.FRD_SESSIONS)("foreign_flow").where(
        "net_value is not null").select("symbol", "trade_date", "net_value")
    inside = pit.window_join(
        ended, pit.between_sessions(rows, calendar), by=["symbol"], low="start_idx",
        high="end_idx", position="session_idx", width=K.FRD_SESSIONS).where(
        F.col("trade_date") <= F.col("as_of"))
    more = inside.groupBy("symbol", "as_of").agg(
        F.count("net_value").alias("_more_rows"), F.sum("net_value").alias("_more"))
    found = F.col("_more").isNotNull()
    return panel.join(more, ["symbol", "as_of"], "left").withColumn(
        "flow_rows", F.when(found, F.col("flow_rows") + F.col("_more_rows"))
        .otherwise(F.col("flow_rows"))).withColumn(
        "foreign_net", F.when(found, F.coalesce("foreign_net", F.lit(0.0)) + F.col("_more"))
        .otherwise(F.col("foreign_net"))).drop("_more", "_more_rows")


def _flow_score(panel: DataFrame) -> DataFrame:
    out = (
        panel.withColumn("price_change", F.when(
            F.col("first_close") > 0, F.col("last_close") / F.col("first_close") - 1)
            .when(F.col("first_close").isNotNull(), F.lit(0.0)))
        .withColumn("outflow_ratio", F.when(
            F.col("turnover") > 0, F.greatest(F.lit(0.0), -F.col("foreign_net"))
            / F.col("turnover")))
    )
    gate = S.clip(F.col("price_change") / 0.15, 0.0, 1.0)
    checks = [
        (F.col("flow_rows") == 0, "no foreign flow in the window"),
        (F.col("flow_rows") < K.FRD_MIN_SESSIONS, F.concat(
            F.lit("foreign flow for "), F.col("flow_rows").cast("string"),
            F.lit(f" sessions, {K.FRD_MIN_SESSIONS} needed"))),
        (F.col("market_rows") < K.FRD_MIN_SESSIONS, F.concat(
            F.lit("prices for "), F.col("market_rows").cast("string"),
            F.lit(f" sessions, {K.FRD_MIN_SESSIONS} needed"))),
        (F.col("turnover") <= 0, "no turnover in the window"),
    ]
    return result(out, checks, S.ramp(F.col("outflow_ratio"), 0.02, 0.20) * gate,
                  "foreign_net", "outflow_ratio", "price_change", "market_day")


def foreign_flow(tables, grid: DataFrame) -> DataFrame:
    calendar = pit.trading_calendar(tables)
    panel = _on_grid(session_panel(
        tables, grid, calendar, ("tx", "flow"), K.FRD_SESSIONS).withColumns(_flow_columns()))
    panel = panel.select("symbol", "as_of", *_flow_columns())
    return _flow_score(with_flow_between_sessions(tables, grid, calendar, panel))


# -- BCI ----------------------------------------------------------------------------------------
#: More days than any window of sessions; one order key holds the session and the day inside it.
_DAYS = 1 << 20


def broker_net(tables, grid: DataFrame, overlapping: bool = False) -> DataFrame:
    """Net buying per (symbol, as_of, broker) from the first of the last 20 sessions to `as_of`.

    The rows are dealt by (symbol, broker) before they meet the windows that hold them, so what
    the windows repeat is summed where it arises and is not shuffled. Where the windows of a grid
    are `overlapping` (dates a few sessions apart), `last_rows` spares the repeated rows as well;
    on wider grids its one pass over each broker's rows costs more than it saves.
    """
    calendar = pit.trading_calendar(tables)
    ended = pit.with_end_session(grid, calendar).withColumn(
        "start_idx", F.col("end_idx") - (K.BCI_SESSIONS - 1))
    rows = pit.window_reader(tables, ended, calendar, K.BCI_SESSIONS)("broker_summary").select(
        "symbol", "trade_date", "broker_code", "net_value").repartition("symbol", "broker_code")
    facts = rows.join(pit.session_days(calendar, ended.agg(F.max("as_of")).scalar()), "trade_date")
    inside = pit.window_join(
        ended, last_rows(facts) if overlapping else facts, by=["symbol"], low="start_idx", high="end_idx",
        position="session_idx", width=K.BCI_SESSIONS).where(F.col("trade_date") <= F.col("as_of"))
    if not overlapping:
        return inside.groupBy("symbol", "as_of", "broker_code").agg(
            F.sum("net_value").alias("net_value"), F.max("trade_date").alias("last_day"))
    held = F.filter("recent", lambda r: r["session_idx"] >= F.col("start_idx"))
    total = F.aggregate(held, F.lit(None).cast("double"), lambda acc, r: F.coalesce(
        acc + r["net_value"], acc, r["net_value"]))
    return inside.where(F.col("next_day").isNull() | (F.col("as_of") < F.col("next_day"))).select(
        "symbol", "as_of", "broker_code",
        F.when(F.size("recent") == 1, F.col("net_value")).otherwise(total).alias("net_value"),
        F.col("trade_date").alias("last_day"))


def last_rows(facts: DataFrame) -> DataFrame:
    """Add to each broker row the broker's rows of the 20 sessions up to it and the day of its next row.

    A window that takes a broker from its last row only finds every net once and groups nothing.
    """
    order = W.partitionBy("symbol", "broker_code").orderBy(
        F.col("session_idx").cast("long") * _DAYS + F.unix_date("trade_date"))
    recent = order.rangeBetween(-K.BCI_SESSIONS * _DAYS, 0)
    return facts.withColumns({
        "recent": F.collect_list(F.struct("session_idx", "net_value")).over(recent),
        "next_day": F.lead("trade_date").over(order)})


def broker_shares(net: DataFrame) -> DataFrame:
    """Buyer count, Herfindahl index, share and codes of the top three net buyers.

    Totals are plain sums; the top three come from a ranked window whose limit Spark applies
    before the shuffle, so no task needs all the brokers of a busy symbol.
    """
    keys = ["symbol", "as_of"]
    everyone = net.groupBy(*keys).agg(
        F.count_if(F.col("net_value") > 0).alias("buyers"),
        F.sum(F.when(F.col("net_value") > 0, F.col("net_value"))).alias("total"),
        F.sum(F.when(F.col("net_value") > 0, F.col("net_value") * F.col("net_value")))
        .alias("squares"),
        F.max("last_day").alias("broker_day"))
    order = W.partitionBy(*keys).orderBy(F.desc("net_value"), "broker_code")
    top = (
        net.where("net_value > 0").withColumn("rank", F.row_number().over(order))
        .where("rank <= 3").groupBy(*keys).agg(
            F.sum("net_value").alias("top3_net"),
            F.array_sort(F.collect_list(F.struct("rank", "broker_code"))).alias("top3"))
    )
    both = everyone.join(top, keys, "left")
    return both.select(
        *keys, "buyers", "broker_day",
        (F.col("top3_net") / F.col("total")).alias("top3_share"),
        (F.col("squares") / (F.col("total") * F.col("total"))).alias("hhi"),
        F.array_join(F.col("top3.broker_code"), ", ").alias("top3_codes"))


def broker_concentration(tables, grid: DataFrame, overlapping: bool = False) -> DataFrame:
    shares = broker_shares(broker_net(tables, grid, overlapping))
    out = grid.select("symbol", "as_of").join(shares, ["symbol", "as_of"], "left")
    score = (0.6 * S.ramp(F.col("top3_share"), 0.35, 0.85)
             + 0.4 * S.ramp(F.col("hhi"), 0.10, 0.40))
    checks = [
        (F.col("buyers").isNull(), "no broker rows in the window"),
        (F.col("buyers") < K.BCI_MIN_BROKERS, F.concat(
            F.col("buyers").cast("string"),
            F.lit(f" net buyers, {K.BCI_MIN_BROKERS} needed"))),
    ]
    return result(out, checks, score, "top3_share", "hhi", "top3_codes", "buyers", "broker_day")


# -- FFS ----------------------------------------------------------------------------------------
def latest_free_float(tables, grid: DataFrame) -> DataFrame:
    facts = tables["free_float"].where("free_float_pct is not null and as_of is not null").select(
        "symbol", "free_float_pct", F.col("as_of").alias("float_day"))
    return pit.asof_join(grid.select("symbol", "as_of"), facts, by=["symbol"], grid_on="as_of",
                         fact_on="float_day", values=["free_float_pct", "float_day"],
                         name="snapshot")


def free_float(tables, grid: DataFrame) -> DataFrame:
    known = latest_free_float(tables, grid).select(
        "symbol", "as_of", F.col("snapshot.free_float_pct").alias("free_float_pct"),
        F.col("snapshot.float_day").alias("float_day"))
    out = known.withColumn("data_age_days", F.datediff("as_of", "float_day"))
    pct = F.col("free_float_pct")
    checks = [
        (pct.isNull(), "no free float known"),
        (~((pct > 0) & (pct <= 1)), "free float outside 0-1"),
        (F.col("data_age_days") > K.FFS_STALE_DAYS, F.concat(
            F.lit("free float is "), F.col("data_age_days").cast("string"), F.lit(" days old"))),
    ]
    return result(out, checks, S.ramp(-pct, -0.50, -0.05),
                  "free_float_pct", "data_age_days", "float_day")


# -- SSS ----------------------------------------------------------------------------------------
def event_days(tables, risky_actions: list[str] | None = None) -> DataFrame:
    """Suspensions, insider sells and risky actions per (symbol, day) with any of the three events.

    Both the running totals and the first day need all three tables; they are read once and the
    sums, at most one row per symbol and day, are kept as a checkpoint.
    """
    risky = risky_actions or K.RISKY_ACTIONS
    sells = S.keyword_any(F.col("transaction_type"), K.SELL_WORDS)
    risks = S.keyword_any(F.col("action_type"), risky)
    return cut_lineage(
        tables["suspensions"].where("start_date is not null").groupBy(
            "symbol", F.col("start_date").alias("day")).agg(
            F.count("*").alias("n_susp"), F.max("reason").alias("reason"))
        .unionByName(
            tables["filings"].where("filing_date is not null").groupBy(
                "symbol", F.col("filing_date").alias("day")).agg(F.count_if(sells).alias("n_sell")),
            allowMissingColumns=True)
        .unionByName(
            tables["corporate_actions"].where("action_date is not null").groupBy(
                "symbol", F.col("action_date").alias("day")).agg(
                F.count_if(risks).alias("n_risky")),
            allowMissingColumns=True))


def structural_counts(tables, grid: DataFrame, risky_actions: list[str] | None = None,
                      daily: DataFrame | None = None) -> DataFrame:
    """Suspensions (24 months), insider sells (90 days) and risky actions (24 months).

    Running totals per symbol, read at both ends of each window and subtracted: one shuffle on
    the symbol and no fact is copied into the many windows that cover it. The keyless tables
    are summed per (symbol, day) first (`daily`), which bounds the window by days.
    """
    daily = event_days(tables, risky_actions) if daily is None else daily
    since = S.months_back(F.col("as_of"), K.SSS_MONTHS)
    ends = F.array(
        F.struct(F.lit("now").alias("side"), F.col("as_of").alias("day")),
        F.struct(F.lit("months").alias("side"), F.date_sub(since, 1).alias("day")),
        F.struct(F.lit("days").alias("side"),
                 F.date_sub("as_of", K.SSS_FILING_DAYS + 1).alias("day")))
    markers = grid.select("symbol", "as_of", F.inline(ends))
    upto = W.partitionBy("symbol").orderBy("day").rangeBetween(
        W.unboundedPreceding, W.currentRow)
    suspension = F.when(F.col("n_susp").isNotNull(), F.struct("day", "reason"))
    totals = (
        daily.unionByName(markers, allowMissingColumns=True)
        .withColumn("t_susp", F.coalesce(F.sum("n_susp").over(upto), F.lit(0)))
        .withColumn("t_sell", F.coalesce(F.sum("n_sell").over(upto), F.lit(0)))
        .withColumn("t_risky", F.coalesce(F.sum("n_risky").over(upto), F.lit(0)))
        .withColumn("l_susp", F.max(suspension).over(upto))
        .withColumn("l_sell", F.max(F.when(F.col("n_sell") > 0, F.col("day"))).over(upto))
        .withColumn("l_risky", F.max(F.when(F.col("n_risky") > 0, F.col("day"))).over(upto))
        .where("side is not null")
    )

    def at(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    counted = totals.groupBy("symbol", "as_of").agg(
        (at("now", "t_susp") - at("months", "t_susp")).alias("suspensions"),
        (at("now", "t_sell") - at("days", "t_sell")).alias("insider_sells"),
        (at("now", "t_risky") - at("months", "t_risky")).alias("risky_actions"),
        at("now", "l_susp").alias("l_susp"), at("now", "l_sell").alias("l_sell"),
        at("now", "l_risky").alias("l_risky"))
    had = F.col("suspensions") > 0
    return counted.select(
        "symbol", "as_of", "suspensions", "insider_sells", "risky_actions",
        F.when(had, F.col("l_susp.day")).alias("last_suspension"),
        F.when(had, F.col("l_susp.reason")).alias("last_reason"),
        F.when(F.col("insider_sells") > 0, F.col("l_sell")).alias("last_sell"),
        F.when(F.col("risky_actions") > 0, F.col("l_risky")).alias("last_risky"))


def first_event_day(daily: DataFrame) -> DataFrame:
    """The day from which any of the three event tables had a row."""
    return daily.agg(F.min("day").alias("first_day"))


def structural(tables, grid: DataFrame, risky_actions: list[str] | None = None,
               whole_words: bool = False) -> DataFrame:
    daily = event_days(tables, risky_actions)
    counts = structural_counts(tables, grid, daily=daily)
    match = S.word_any if whole_words else S.keyword_any
    out = (
        counts.withColumn("swept", F.coalesce(
            F.col("as_of") >= first_event_day(daily).scalar(), F.lit(False)))
        .withColumn("unusual", (F.col("suspensions") > 0)
                    & match(F.col("last_reason"), K.UNUSUAL_REASONS))
    )
    points = (
        F.when(F.col("suspensions") > 0, 40.0).otherwise(0.0)
        + F.when(F.col("unusual"), 15.0).otherwise(0.0)
        + F.least(F.lit(30.0), 10.0 * F.col("insider_sells"))
        + F.least(F.lit(25.0), 12.0 * F.col("risky_actions"))
    )
    checks = [(~F.col("swept"), "event tables are empty at this date")]
    return result(out, checks, F.least(F.lit(100.0), points), "suspensions", "insider_sells",
                  "risky_actions", "unusual", "last_suspension", "last_sell", "last_risky")


# -- all six --------------------------------------------------------------------------------------
PROBES = {
    "broker_concentration": broker_concentration,
    "volume_anomaly": volume_anomaly,
    "price_fundamental": price_fundamental,
    "free_float": free_float,
    "foreign_flow": foreign_flow,
    "structural": structural,
}


def run_all(tables, grid: DataFrame, exclude: tuple[str, ...] = (), sparse: bool = False,
            overlapping: bool = False) -> DataFrame:
    """One row per grid point with struct columns BCI ... SSS (sub_score, reason, numbers).

    The results of the probes come together by one union and one aggregation on the grid point.
    `sparse` says that the grid has few dates per symbol (see `pit.window_reader`), `overlapping`
    that dates of a symbol lie a few sessions apart (see `broker_net`).
    """
    calendar = pit.trading_calendar(tables)
    columns = {**_volume_columns(), **_price_columns(), **_flow_columns()}
    panel = _on_grid(session_panel(tables, grid, calendar, sparse=sparse).withColumns(columns))
    panel = panel.select("symbol", "as_of", *columns)
    flow = with_flow_between_sessions(
        tables, grid, calendar, panel.select("symbol", "as_of", *_flow_columns()))
    parts = {
        "BCI": broker_concentration(tables, grid, overlapping),
        "VAS": _volume_score(panel),
        "PFD": _divergence_score(tables, panel.drop("volume_window")),
        "FFS": free_float(tables, grid),
        "FRD": _flow_score(flow),
        "SSS": structural(tables, grid),
    }
    nothing = F.struct(F.lit(None).cast("double").alias("sub_score"), F.lit("excluded").alias("unavailable_reason"))
    packed = [grid.select("symbol", "as_of")] + [
        part.select("symbol", "as_of", F.struct(
            *[c for c in part.columns if c not in ("symbol", "as_of")]).alias(code))
        for code, part in parts.items() if code not in exclude]
    met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed).groupBy("symbol", "as_of").agg(
        *[F.first(code, ignorenulls=True).alias(code) for code in parts if code not in exclude])
    return met.select("symbol", "as_of", *[
        nothing.alias(code) if code in exclude else F.col(code) for code in parts])


def score_table(scored: DataFrame) -> DataFrame:
    """symbol, as_of and the six sub-scores as columns."""
    return scored.select("symbol", "as_of",
                         *[F.col(f"{c}.sub_score").alias(c) for c in K.COMPONENTS])


def long_scores(scored: DataFrame) -> DataFrame:
    """One row per (symbol, as_of, component)."""
    rows = F.array(*[
        F.struct(F.lit(probe).alias("probe"), F.lit(code).alias("component"),
                 F.col(f"{code}.sub_score").alias("sub_score"),
                 F.col(f"{code}.unavailable_reason").alias("unavailable_reason"))
        for probe, code in K.PROBE_COMPONENT.items()])
    return scored.select("symbol", "as_of", F.inline(rows))


# -- evidence ---------------------------------------------------------------------------------------
def _entry(id_: str, value: Column, display: Column, day: Column, keep: Column | None = None):
    label, endpoint = K.EVIDENCE[id_]
    probe = next(p for p, c in K.PROBE_COMPONENT.items() if c == id_[:3].upper())
    entry = F.struct(
        F.lit(id_).alias("id"), F.lit(label).alias("label"),
        value.cast("string").alias("value"), display.alias("display"),
        F.lit(probe).alias("probe"), F.lit(endpoint).alias("source_endpoint"),
        S.market_close_stamp(day).alias("as_of"), F.lit(0).alias("credits_spent"))
    return entry if keep is None else F.when(keep, entry)


def evidence_entries(code: str) -> list[Column]:
    """The citable numbers of one component of `run_all` (null entries are absent)."""
    c = lambda name: F.col(f"{code}.{name}")
    text = lambda col, unit: F.concat(col.cast("string"), F.lit(unit))
    if code == "VAS":
        return [
            _entry("vas.zscore", S.half_even(c("zscore"), 2), S.sigma(c("zscore")),
                   c("evidence_day")),
            _entry("vas.volume_ratio", S.half_even(c("volume_ratio"), 2),
                   F.concat(S.fixed(c("volume_ratio"), 1), F.lit("×")), c("evidence_day")),
        ]
    if code == "BCI":
        return [
            _entry("bci.top3_share", S.half_even(c("top3_share"), 4), S.percent(c("top3_share")),
                   c("broker_day")),
            _entry("bci.hhi", S.half_even(c("hhi"), 4), S.fixed(c("hhi"), 2), c("broker_day")),
            _entry("bci.top3_codes", c("top3_codes"), c("top3_codes"), c("broker_day")),
            _entry("bci.broker_count", c("buyers"), text(c("buyers"), " broker"),
                   c("broker_day")),
        ]
    if code == "PFD":
        return [
            _entry("pfd.return_90d", S.half_even(c("return_90d"), 4),
                   S.signed_percent(c("return_90d")), c("price_day")),
            _entry("pfd.earnings_change", S.half_even(c("earnings_change"), 4),
                   S.signed_percent(c("earnings_change")), c("report_day")),
            _entry("pfd.divergence", S.half_even(c("divergence"), 4),
                   F.concat(S.signed_percent(c("divergence")), F.lit(" poin")),
                   c("report_day")),
        ]
    if code == "FFS":
        return [
            _entry("ffs.pct", S.half_even(c("free_float_pct"), 4), S.percent(c("free_float_pct")),
                   c("float_day")),
            _entry("ffs.data_age_days", c("data_age_days"), text(c("data_age_days"), " hari"),
                   c("float_day")),
        ]
    if code == "FRD":
        return [
            _entry("frd.foreign_net_30d", S.half_even(c("foreign_net"), 2),
                   S.money(c("foreign_net")), c("market_day")),
            _entry("frd.outflow_ratio", S.half_even(c("outflow_ratio"), 4),
                   S.percent(c("outflow_ratio"), 1), c("market_day")),
            _entry("frd.price_change_30d", S.half_even(c("price_change"), 4),
                   S.signed_percent(c("price_change")), c("market_day")),
        ]
    had, sold, risky = c("suspensions") > 0, c("insider_sells") > 0, c("risky_actions") > 0
    return [
        _entry("sss.prior_suspension", c("last_suspension"),
               F.date_format(c("last_suspension"), "dd-MM-yyyy"), c("last_suspension"), had),
        _entry("sss.suspension_count", c("suspensions"), text(c("suspensions"), " kali"),
               c("last_suspension"), had),
        _entry("sss.suspension_unusual", F.lit(True), F.lit("ya"), c("last_suspension"),
               c("unusual")),
        _entry("sss.insider_sells", c("insider_sells"), text(c("insider_sells"), " transaksi"),
               c("last_sell"), sold),
        _entry("sss.rights_issues", c("risky_actions"), text(c("risky_actions"), " kali"),
               c("last_risky"), risky),
        _entry("sss.clean", F.lit(0), F.lit("tidak ada"), F.col("as_of"),
               ~(had | sold | risky)),
    ]


def evidence_array(scored: DataFrame, name: str = "evidence") -> DataFrame:
    """Add the evidence book of each row, ordered by probe name, then id."""
    entries = []
    for probe, code in sorted(K.PROBE_COMPONENT.items()):
        measured = F.col(f"{code}.sub_score").isNotNull()
        ids = sorted(evidence_entries(code), key=str)
        entries += [F.when(measured, e) for e in ids]
    book = F.filter(F.array(*entries), lambda e: e.isNotNull())
    by_id = F.array_sort(book, lambda a, b: F.when(
        F.struct(a["probe"], a["id"]) < F.struct(b["probe"], b["id"]), F.lit(-1)).when(
        F.struct(a["probe"], a["id"]) > F.struct(b["probe"], b["id"]), F.lit(1)).otherwise(0))
    return scored.withColumn(name, by_id)


def evidence_rows(scored: DataFrame) -> DataFrame:
    book = evidence_array(scored).select("symbol", F.col("as_of").alias("grid_date"),
                                         F.explode("evidence").alias("e"))
    return book.select("symbol", "grid_date", "e.*")


def evidence_index(evidence: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First entry wins per evidence id."""
    first = W.partitionBy(*keys, "id").orderBy(*order)
    return evidence.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
