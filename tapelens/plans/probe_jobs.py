"""Registered jobs: point-in-time reads, calendar, probes, composite, evidence, screen."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S
from tapelens.operators import pit, probes, scoring, screen, selection
from tapelens.plans import check_sql as C
from tapelens.plans.registry import CHECKS, query


def weekly_grid(t):
    """Every symbol at the last session of every week."""
    calendar = pit.trading_calendar(t)
    return pit.as_of_grid(t["company_profile"].select("symbol"), pit.weekly_sessions(calendar))


def month_dates(t):
    return pit.trading_calendar(t).groupBy(F.trunc("trade_date", "MM").alias("m")).agg(
        F.max("trade_date").alias("as_of")).select("as_of")


def monthly_grid(t):
    return pit.as_of_grid(t["company_profile"].select("symbol"), month_dates(t))


def session_grid(t):
    """Every symbol at every session: the grid of the screen."""
    return pit.as_of_grid(t["company_profile"].select("symbol"), pit.trading_calendar(t).select(
        F.col("trade_date").alias("as_of")))


def r(name: str, digits: int = 6):
    return S.half_even(F.col(name), digits).alias(name)


# -- reads -----------------------------------------------------------------------------------
@query("b1_pit_filter", """
    select m.as_of, count(case when d.trade_date <= m.as_of then 1 end) as transactions,
           (select count(*) from company_profile p
            where p.listing_date is null or p.listing_date <= m.as_of) as profiles
    from monthly m cross join (select trade_date from daily_transaction) d group by m.as_of""")
def pit_counts(t):
    """Rows known at each month end, for a dated table and for the identity table."""
    dates = month_dates(t)

    def known(table, name):
        cut = F.col(pit.TABLES[table].cut)
        days = t[table].groupBy(cut.alias("day")).agg(F.count("*").alias("n"))
        always = days.where("day is null").agg(F.coalesce(F.sum("n"), F.lit(0)))
        upto = pit.W.orderBy("day").rowsBetween(pit.W.unboundedPreceding, pit.W.currentRow)
        totals = days.where("day is not null").withColumn("n", F.sum("n").over(upto))
        looked = pit.asof_join(
            dates.select(F.lit(1).alias("k"), "as_of"), totals.withColumn("k", F.lit(1)),
            by=["k"], grid_on="as_of", fact_on="day", values=["n"])
        extra = always.scalar() if pit.TABLES[table].null_cut_passes else F.lit(0)
        return looked.select("as_of", (F.coalesce("latest.n", F.lit(0)) + extra).alias(name))

    return known("daily_transaction", "transactions").join(
        known("company_profile", "profiles"), "as_of")


@query("b2_symbol_since", """
    select symbol, trade_date, close_price, volume from daily_transaction
    where symbol = 'BRBC' and trade_date >= date '1998-01-01'
      and trade_date <= date '1999-06-30'""")
def symbol_window(t):
    df = pit.symbol_since(t["daily_transaction"], "daily_transaction", "BRBC", "1998-01-01",
                          "1999-06-30")
    return df.select("symbol", "trade_date", "close_price", "volume")


@query("b3_price_history", "select symbol, trade_date, close_price from price_history")
def prices(t):
    return pit.price_history(t)


@query("b4_last_session", "select max(trade_date) as last_session from daily_transaction")
def newest(t):
    return pit.last_session(t["daily_transaction"])


@query("b5_months_back", f"""
    select o_orderkey, {C.months_back('cast(o_orderdate as date)', 24)} as two_years_back,
           cast(date_trunc('month', cast(o_orderdate as date)) - interval 24 month as date)
             as first_of_month
    from orders""")
def back_months(t):
    day = F.to_date("o_orderdate")
    return t["orders"].select("o_orderkey", S.months_back(day, 24).alias("two_years_back"),
                              S.months_back(day, 24, True).alias("first_of_month"))


@query("b6_weekdays_back", """
    select trade_date, string_agg(cast(d as varchar), ',' order by d) as days from (
      select trade_date, d, row_number() over (partition by trade_date order by d desc) as rn
      from (select trade_date, trade_date - cast(i as int) as d
            from calendar cross join range(60) r(i)) x
      where isodow(d) < 6) y
    where rn <= 30 group by trade_date""")
def back_weekdays(t):
    days = S.weekdays_back(F.col("trade_date"), 30)
    return pit.trading_calendar(t).select(
        "trade_date", F.array_join(days.cast("array<string>"), ",").alias("days"))


@query("c1_latest_as_of", """
    select symbol, as_of, pct as free_float_pct, day as float_day from w_ffs""")
def latest_float(t):
    return probes.latest_free_float(t, weekly_grid(t)).select("symbol", "as_of", "snapshot.*")


@query("c2_nth_session_before", """
    select s.symbol, s.start_date as event_date, l.lag, c.trade_date as as_of
    from halts s cross join (select unnest([1, 3, 5, 10]) as lag) l
    join calendar c on c.session_idx =
      (select max(session_idx) from calendar k where k.trade_date < s.start_date) - l.lag + 1""")
def sessions_before(t):
    events = t["halts"].select("symbol", F.col("start_date").alias("event_date"))
    return pit.nth_session_before(events, pit.trading_calendar(t), K.LAGS).select(
        "symbol", "event_date", "lag", "as_of")


@query("d1_trading_calendar", "select trade_date, session_idx from calendar")
def calendar(t):
    return pit.trading_calendar(t)


# -- pieces of the probes ----------------------------------------------------------------------
@query("d2_broker_net", """
    select symbol, as_of, broker_code, round(net_value, 2) as net_value from w_bci_net
    where net_value > 0""")
def broker_net(t):
    return probes.broker_net(t, weekly_grid(t)).where("net_value > 0").select(
        "symbol", "as_of", "broker_code", F.round("net_value", 2).alias("net_value"))


@query("d3_hhi_topk_share", """
    select symbol, as_of, round(top3_share, 6) as top3_share, round(hhi, 6) as hhi, top3_codes,
           coalesce(buyers, 0) as buyers
    from w_bci where buyers is not null""")
def broker_shares(t):
    shares = probes.broker_shares(probes.broker_net(t, weekly_grid(t)))
    return shares.select("symbol", "as_of", F.round("top3_share", 6).alias("top3_share"),
                         F.round("hhi", 6).alias("hhi"), "top3_codes", "buyers")


@query("d4_robust_baseline", """
    select symbol, med as median, median(abs(v - med)) * 1.4826 as spread from (
      select symbol, cast(volume as double) as v,
             median(cast(volume as double)) over (partition by symbol) as med
      from daily_transaction) x group by symbol, med""")
def robust(t):
    return probes.robust_by_key(t["daily_transaction"].select(
        "symbol", F.col("volume").cast("double").alias("v")), ["symbol"], "v")


@query("d5_turnover_sum", """
    select symbol, as_of, round(outflow_ratio, 6) as outflow_ratio,
           round(foreign_net, 2) as foreign_net, round(price_change, 6) as price_change
    from w_frd where sub_score is not null""")
def turnover(t):
    return probes.foreign_flow(t, weekly_grid(t)).where("sub_score is not null").select(
        "symbol", "as_of", F.round("outflow_ratio", 6).alias("outflow_ratio"),
        F.round("foreign_net", 2).alias("foreign_net"),
        F.round("price_change", 6).alias("price_change"))


@query("d6_event_counts", """
    select symbol, as_of, n_susp as suspensions, n_sell as insider_sells,
           n_risky as risky_actions, last_susp as last_suspension, last_sell, last_risky
    from w_sss""")
def event_counts(t):
    return probes.structural_counts(t, weekly_grid(t)).drop("last_reason")


# -- probes ---------------------------------------------------------------------------------------
@query("p1_volume_anomaly", """
    select symbol, as_of, sub_score, case when sub_score is not null then round(zscore, 6) end
             as zscore,
           case when sub_score is not null then round(volume_ratio, 6) end as volume_ratio
    from w_vas""")
def vas(t):
    return probes.volume_anomaly(t, weekly_grid(t)).select(
        "symbol", "as_of", "sub_score", F.round("zscore", 6).alias("zscore"),
        F.round("volume_ratio", 6).alias("volume_ratio"))


@query("p2_broker_concentration", """
    select symbol, as_of, sub_score,
           case when sub_score is not null then top3_codes end as top3_codes from w_bci""")
def bci(t):
    return probes.broker_concentration(t, weekly_grid(t)).select(
        "symbol", "as_of", "sub_score", "top3_codes")


@query("p3_price_fundamental", """
    select symbol, as_of, sub_score,
           case when sub_score is not null then round(divergence, 6) end as divergence
    from w_pfd""")
def pfd(t):
    return probes.price_fundamental(t, weekly_grid(t)).select(
        "symbol", "as_of", "sub_score", F.round("divergence", 6).alias("divergence"))


@query("p4_free_float", """
    select symbol, as_of, sub_score, case when sub_score is not null then age end
             as data_age_days from w_ffs""")
def ffs(t):
    return probes.free_float(t, weekly_grid(t)).select(
        "symbol", "as_of", "sub_score", "data_age_days")


@query("p5_foreign_flow", "select symbol, as_of, sub_score from w_frd")
def frd(t):
    return probes.foreign_flow(t, weekly_grid(t)).select("symbol", "as_of", "sub_score")


@query("p6_structural", """
    select symbol, as_of, sub_score, case when sub_score is not null then unusual end as unusual
    from w_sss""")
def sss(t):
    return probes.structural(t, weekly_grid(t)).select(
        "symbol", "as_of", "sub_score", "unusual")


@query("p7_run_all_probes", "select * from w_scores")
def all_probes(t):
    return probes.score_table(probes.run_all(t, weekly_grid(t)))


@query("p8_composite_score", "select symbol, as_of, score from week_composite")
def composite_score(t):
    table = probes.score_table(probes.run_all(t, weekly_grid(t)))
    return scoring.composite(table).select("symbol", "as_of", "score")


@query("p9_confidence", "select symbol, as_of, confidence from week_composite")
def confidence(t):
    table = probes.score_table(probes.run_all(t, weekly_grid(t)))
    return scoring.composite(table).select("symbol", "as_of", "confidence")


@query("p10_band", """
    select as_of, band, count(*) as n from week_composite group by as_of, band""")
def bands(t):
    table = probes.score_table(probes.run_all(t, weekly_grid(t)))
    return scoring.composite(table).groupBy("as_of", "band").agg(F.count("*").alias("n"))


def evidence_sql() -> str:
    def item(cte, id_, value, keep="true"):
        return (f"select symbol, as_of as grid_date, '{id_}' as id, {value} as value from {cte} "
                f"where sub_score is not null and {keep}")
    had, sold, risky = "n_susp > 0", "n_sell > 0", "n_risky > 0"
    whole = lambda c: f"cast({c} as double)"
    return " union all ".join([
        item("m_vas", "vas.zscore", "round_even(zscore, 2)"),
        item("m_vas", "vas.volume_ratio", "round_even(volume_ratio, 2)"),
        item("m_bci", "bci.top3_share", "round_even(top3_share, 4)"),
        item("m_bci", "bci.hhi", "round_even(hhi, 4)"),
        item("m_bci", "bci.broker_count", whole("buyers")),
        item("m_bci", "bci.top3_codes", "null"),
        item("m_pfd", "pfd.return_90d", "round_even(return_90d, 4)"),
        item("m_pfd", "pfd.earnings_change", "round_even(earnings_change, 4)"),
        item("m_pfd", "pfd.divergence", "round_even(divergence, 4)"),
        item("m_ffs", "ffs.pct", "round_even(pct, 4)"),
        item("m_ffs", "ffs.data_age_days", whole("age")),
        item("m_frd", "frd.foreign_net_30d", "round_even(foreign_net, 2)"),
        item("m_frd", "frd.outflow_ratio", "round_even(outflow_ratio, 4)"),
        item("m_frd", "frd.price_change_30d", "round_even(price_change, 4)"),
        item("m_sss", "sss.prior_suspension", "null", had),
        item("m_sss", "sss.suspension_count", whole("n_susp"), had),
        item("m_sss", "sss.suspension_unusual", "null", "unusual"),
        item("m_sss", "sss.insider_sells", whole("n_sell"), sold),
        item("m_sss", "sss.rights_issues", whole("n_risky"), risky),
        item("m_sss", "sss.clean", "cast(0 as double)",
             f"not ({had} or {sold} or {risky})"),
    ])


def month_evidence(t):
    return probes.evidence_rows(probes.run_all(t, monthly_grid(t)))


@query("p25_evidence_rows", f"select * from ({evidence_sql()}) e")
def evidence(t):
    return month_evidence(t).select("symbol", "grid_date", "id",
                                    F.col("value").try_cast("double").alias("value"))


@query("e8_evidence_book", f"""
    select symbol, grid_date as as_of, string_agg(id, ',' order by case left(id, 3)
             when 'bci' then 1 when 'frd' then 2 when 'ffs' then 3 when 'pfd' then 4
             when 'sss' then 5 else 6 end, id) as book
    from ({evidence_sql()}) e group by 1, 2""")
def book(t):
    scored = probes.evidence_array(probes.run_all(t, monthly_grid(t)))
    return scored.where(F.size("evidence") > 0).select(
        "symbol", "as_of", F.array_join(F.transform("evidence", lambda e: e["id"]), ",")
        .alias("book"))


@query("e9_evidence_index", f"""
    select symbol, id, min(grid_date) as first_cited, count(*) as citations
    from ({evidence_sql()}) e group by 1, 2""")
def index(t):
    rows = month_evidence(t)
    first = probes.evidence_index(rows, ["symbol"], ["grid_date"]).select(
        "symbol", "id", F.col("grid_date").alias("first_cited"))
    counts = rows.groupBy("symbol", "id").agg(F.count("*").alias("citations"))
    return first.join(counts, ["symbol", "id"])


@query("p28_score_table", """
    select symbol, as_of, BCI, VAS, PFD, FFS, FRD, SSS,
           cast((BCI is null)::int + (VAS is null)::int + (PFD is null)::int
                + (FFS is null)::int + (FRD is null)::int + (SSS is null)::int as int)
             as unavailable
    from m_scores""")
def table(t):
    rows = probes.long_scores(probes.run_all(t, monthly_grid(t)))
    return rows.groupBy("symbol", "as_of").pivot("component", K.COMPONENTS).agg(
        F.max("sub_score")).join(
        rows.groupBy("symbol", "as_of").agg(
            F.count_if(F.col("unavailable_reason").isNotNull()).cast("int")
            .alias("unavailable")), ["symbol", "as_of"])


@query("p23_rule_finding", """
    select component, finding, count(*) as n from (
      select component, case when s is null then 'inconclusive' when s >= 60 then 'confirmed'
                             else 'refuted' end as finding
      from (select unnest(['BCI', 'VAS', 'PFD', 'FFS', 'FRD', 'SSS']) as component,
                   unnest([BCI, VAS, PFD, FFS, FRD, SSS]) as s from m_scores) x) y
    group by 1, 2""")
def findings(t):
    rows = probes.long_scores(probes.run_all(t, monthly_grid(t)))
    return rows.groupBy("component", selection.rule_finding(F.col("sub_score"))
                        .alias("finding")).agg(F.count("*").alias("n"))


# -- screen ---------------------------------------------------------------------------------------
C.CTES.update({
    "m_returns": """
        select g.symbol, g.as_of,
               (select count(*) from dated_price p where p.symbol = g.symbol
                 and p.session_idx <= g.end_idx) as price_rows,
               case when a.close_price > 0 and n.n = 6
                    then e.close_price / a.close_price - 1 end as return_5d,
               case when b.close_price > 0 then e.close_price / b.close_price - 1 end
                 as return_20d
        from month_grid g
        left join dated_price e on e.symbol = g.symbol and e.session_idx = g.end_idx
        left join dated_price a on a.symbol = g.symbol and a.session_idx = g.end_idx - 5
        left join dated_price b on b.symbol = g.symbol and b.session_idx = g.end_idx - 20
        left join (select g.symbol, g.as_of, count(*) as n from month_grid g
                   join dated_price p on p.symbol = g.symbol
                    and p.session_idx between g.end_idx - 5 and g.end_idx
                   group by 1, 2) n on n.symbol = g.symbol and n.as_of = g.as_of""",
    "m_volume": """
        select symbol, as_of,
               case when max(n) >= 20 and (max(last_idx) >= max(end_idx) - 5 or max(end_idx) <= 5)
                     and median(abs(v - med)) * 1.4826 > 0
                    then (max(last_v) - max(med)) / (median(abs(v - med)) * 1.4826) end
                 as volume_z
        from (select *, median(case when rn > 1 then v end)
                          over (partition by symbol, as_of) as med
              from (select g.symbol, g.as_of, g.end_idx, cast(d.volume as double) as v,
                           count(*) over (partition by g.symbol, g.as_of) as n,
                           max(d.session_idx) over (partition by g.symbol, g.as_of) as last_idx,
                           first_value(cast(d.volume as double)) over (
                             partition by g.symbol, g.as_of order by d.session_idx desc)
                             as last_v,
                           row_number() over (partition by g.symbol, g.as_of
                                              order by d.session_idx desc) as rn
                    from month_grid g join dated_transaction d on d.symbol = g.symbol
                     and d.session_idx <= g.end_idx) a) b
        where rn > 1 group by symbol, as_of""",
    "m_event": """
        select g.symbol, g.as_of, count(e.d) > 0 as event from month_grid g
        left join (select symbol, start_date as d from suspensions
                   union all select symbol, filing_date from filings) e
          on e.symbol = g.symbol and e.d <= g.as_of and e.d >= g.as_of - 5
        group by 1, 2""",
    "m_small": """
        select g.symbol, g.as_of,
               case when (p.listing_date is null or p.listing_date <= g.as_of)
                     and p.market_cap is not null
                    then case when p.market_cap < 5000000000000 then cast(1 as double)
                              else cast(0 as double) end end as small_cap
        from month_grid g left join company_profile p on p.symbol = g.symbol""",
    "m_screen": """
        select r.*, v.volume_z, s.small_cap, e.event,
               round_even(cast(0 as double)
                 + cast(0.25 as double) * case when r.return_5d is null then 0 else
                     greatest(0, least(1, r.return_5d / cast(0.30 as double))) end
                 + cast(0.15 as double) * case when r.return_20d is null then 0 else
                     greatest(0, least(1, r.return_20d / cast(0.60 as double))) end
                 + cast(0.40 as double) * case when v.volume_z is null then 0 else
                     greatest(0, least(1, v.volume_z / cast(6.0 as double))) end
                 + cast(0.10 as double) * coalesce(s.small_cap, 0)
                 + cast(0.10 as double) * (case when e.event then 1 else 0 end), 4) as score
        from m_returns r
        left join m_volume v on v.symbol = r.symbol and v.as_of = r.as_of
        left join m_small s on s.symbol = r.symbol and s.as_of = r.as_of
        left join m_event e on e.symbol = r.symbol and e.as_of = r.as_of
        where r.price_rows >= 20""",
    "m_reasoned": """
        select *, case when said = '' then 'tidak ada sinyal menonjol' else said end as reason
        from (select *, concat_ws('; ',
            case when volume_z >= 2
                 then format('volume {:.1f}σ di atas baseline', volume_z) end,
            case when abs(return_5d) >= 0.1
                 then format('harga {:+.0f}% dalam 5 hari bursa', return_5d * 100) end,
            case when abs(return_20d) >= 0.2
                 then format('harga {:+.0f}% dalam 20 hari bursa', return_20d * 100) end,
            case when small_cap = 1 then 'kapitalisasi kecil' end,
            case when event then 'ada suspensi/filing baru' end) as said
          from m_screen) x""",
    "m_watchlist": """
        select * from (select *, row_number() over (partition by as_of
                                   order by score desc, symbol) as rank
                       from m_reasoned) x where rank <= 15""",
})


@query("w1_session_align", """
    select symbol, session_idx, close_price from dated_price""")
def aligned(t):
    return screen.aligned_prices(t, pit.trading_calendar(t)).select(
        "symbol", "session_idx", "close_price")


@query("w2_return_n_sessions", """
    select symbol, as_of, price_rows, return_5d, return_20d from m_returns""")
def returns(t, grid=monthly_grid):
    return screen.return_signals(t, grid(t), pit.trading_calendar(t))


@query("w3_volume_zscore", """
    select g.symbol, g.as_of, round(v.volume_z, 6) as volume_z from month_grid g
    join (select distinct symbol from daily_transaction) d on d.symbol = g.symbol
    left join m_volume v on v.symbol = g.symbol and v.as_of = g.as_of""")
def volume_z(t, grid=monthly_grid):
    return screen.volume_zscore(t, grid(t), pit.trading_calendar(t)).select(
        "symbol", "as_of", F.round("volume_z", 6).alias("volume_z"))


@query("w4_window_90_before_last", """
    select symbol, as_of, count(*) as baseline_rows, min(v) as low, max(v) as high from (
      select g.symbol, g.as_of, d.volume as v,
             row_number() over (partition by g.symbol, g.as_of order by d.session_idx desc) as rn
      from grid g join dated_transaction d on d.symbol = g.symbol
       and d.session_idx between g.end_idx - 119 and g.end_idx) x
    where rn between 2 and 91 group by 1, 2""")
def baseline_window(t):
    """The same window by rank instead of by array: rows 2-91 before each grid date."""
    calendar = pit.trading_calendar(t)
    ended = pit.with_end_session(weekly_grid(t), calendar).withColumn(
        "start_idx", F.col("end_idx") - (K.VAS_LOOKBACK - 1))
    rows = pit.window_join(ended, pit.with_session(t["daily_transaction"], calendar),
                           by=["symbol"], low="start_idx", high="end_idx",
                           position="session_idx", width=K.VAS_LOOKBACK)
    newest_first = pit.W.partitionBy("symbol", "as_of").orderBy(F.desc("session_idx"))
    ranked = rows.withColumn("rn", F.row_number().over(newest_first))
    return ranked.where(F.col("rn").between(2, K.VAS_BASELINE + 1)).groupBy(
        "symbol", "as_of").agg(F.count("*").alias("baseline_rows"), F.min("volume").alias("low"),
                               F.max("volume").alias("high"))


@query("w5_first_last_return", """
    select symbol, as_of, round(return_90d, 6) as return_90d from w_pfd
    where sub_score is not null""")
def window_return(t):
    return probes.price_fundamental(t, weekly_grid(t)).where("sub_score is not null").select(
        "symbol", "as_of", F.round("return_90d", 6).alias("return_90d"))


@query("w6_yoy_by_position", "select symbol, report_date, quarters, yoy from report_growth")
def yoy(t):
    return probes.earnings_growth(t).select("symbol", "report_date", "quarters", "yoy")


@query("c4_recent_event_semi", "select symbol, as_of, event from m_event")
def recent(t, grid=monthly_grid):
    return screen.recent_event(t, grid(t))


@query("p11_screen_score", """
    select symbol, as_of, price_rows, round(return_5d, 4) as return_5d,
           round(return_20d, 4) as return_20d, round(volume_z, 4) as volume_z, small_cap, event,
           score from m_screen""")
def screened(t, grid=monthly_grid):
    return screen.screen(t, grid(t)).select(
        "symbol", "as_of", "price_rows", F.round("return_5d", 4).alias("return_5d"),
        F.round("return_20d", 4).alias("return_20d"), F.round("volume_z", 4).alias("volume_z"),
        "small_cap", "event", "score")


@query("p12_screen_reason_text", "select symbol, as_of, reason from m_reasoned")
def reasons(t, grid=monthly_grid):
    return screen.screen(t, grid(t)).select("symbol", "as_of", "reason")


def watchlist(t, grid=monthly_grid):
    return screen.watchlist(screen.screen(t, grid(t)))


def month_watchlist(t):
    return watchlist(t)


@query("e2_watchlist_topk", "select as_of, rank, symbol, score from m_watchlist")
def watch(t, grid=monthly_grid):
    return watchlist(t, grid).select("as_of", "rank", "symbol", "score")


@query("p27_signals_text", """
    select as_of, symbol, concat_ws('|',
             case when volume_z is not null then format('{:.1f}σ di atas baseline', volume_z)
             end, case when return_5d is not null then format('{:+.0f}%', return_5d * 100) end,
             case when small_cap > 0 then 'kecil' end, case when event then 'ada dalam periode'
             end, format('{:.2f}', round_even(score, 2))) as shown
    from m_watchlist""")
def signal_texts(t, grid=monthly_grid):
    s = screen.signals_text(watchlist(t, grid))
    keys = ["volume_z", "return_5_hari_bursa", "kapitalisasi", "peristiwa_korporasi",
            "skor_seleksi_watchlist"]
    return s.select("as_of", "symbol", F.concat_ws("|", *[F.col("signals")[k] for k in keys])
                    .alias("shown"))


# The reference screens every trading day: the same jobs and the same SQL on that grid.
def on_sessions(sql: str) -> str:
    return re.sub(r"\bmonth_grid\b", "session_grid", re.sub(
        r"\bm_(returns|volume|event|small|screen|reasoned|watchlist)\b", r"s_\1", sql))


C.CTES["session_grid"] = """
    select p.symbol, c.trade_date as as_of, c.session_idx as end_idx
    from company_profile p cross join calendar c"""
C.CTES.update({on_sessions(name): on_sessions(sql) for name, sql in C.CTES.items()
               if on_sessions(name) != name and name != "month_grid"})
# On every session the newest volume is scored once and looked up, instead of once per grid date.
C.CTES.update({
    "volume_medians": """
        select symbol, session_idx, cast(volume as double) as v,
               row_number() over (partition by symbol order by session_idx) as n,
               median(cast(volume as double)) over (partition by symbol order by session_idx
                 rows between unbounded preceding and 1 preceding) as med
        from dated_transaction""",
    "volume_scores": """
        select t.symbol, t.session_idx,
               case when t.n >= 20 and median(abs(h.v - t.med)) * 1.4826 > 0
                    then (t.v - t.med) / (median(abs(h.v - t.med)) * 1.4826) end as z
        from volume_medians t join volume_medians h on h.symbol = t.symbol and h.n < t.n
        group by t.symbol, t.session_idx, t.n, t.v, t.med""",
    "s_volume": """
        select g.symbol, g.as_of,
               case when s.session_idx >= g.end_idx - 5 or g.end_idx <= 5 then s.z end as volume_z
        from session_grid g asof join volume_scores s
          on s.symbol = g.symbol and s.session_idx <= g.end_idx""",
})
DAILY = {
    "w2_return_n_sessions": returns, "w3_volume_zscore": volume_z, "c4_recent_event_semi": recent,
    "p11_screen_score": screened, "p12_screen_reason_text": reasons, "e2_watchlist_topk": watch,
    "p27_signals_text": signal_texts,
}
for _name, _job in DAILY.items():
    query(f"{_name}_daily", on_sessions(CHECKS[_name]))(partial(_job, grid=session_grid))


@query("p22_profile_signals", """
    select h.symbol, h.sessions, case when h.first_price > 0
             then round(h.last_price / h.first_price - 1, 6) end as price_change,
           p.sub_sector, cast(p.market_cap as double) as market_cap
    from (select symbol, count(*) as sessions, arg_min(close_price, trade_date) as first_price,
                 arg_max(close_price, trade_date) as last_price
          from price_history group by symbol) h
    left join company_profile p on p.symbol = h.symbol""")
def profiles(t):
    return selection.profile_signals(t).select(
        "symbol", "sessions", F.round("price_change", 6).alias("price_change"), "sub_sector",
        F.col("market_cap").cast("double").alias("market_cap"))
