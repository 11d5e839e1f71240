"""SQL definitions used only to check results in another engine.

Every entry is a CTE body; `with_ctes` puts the ones a statement needs, directly or through
others, in front of it.
"""

from __future__ import annotations

import re

from tapelens import constants as K
from tapelens.plans.market import definitions


def ramp(value: str, low: float, high: float) -> str:
    return (f"greatest(cast(0 as double), least(cast(100 as double), "
            f"(({value}) - cast({low} as double)) / cast({high - low!r} as double) * 100))")


def any_word(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def band(score: str) -> str:
    return (f"case when {score} >= 80 then 'sangat_waspada' when {score} >= 60 then 'waspada' "
            f"when {score} >= 30 then 'perhatian' else 'normal' end")


def months_back(day: str, months: int) -> str:
    first = f"(date_trunc('month', {day}) - interval {months} month)"
    return f"cast({first} + (least(day({day}), 28) - 1) * interval 1 day as date)"


def probes(prefix: str, grid: str, halts: str = "suspensions") -> dict[str, str]:
    """The six probes over a grid CTE (symbol, as_of, end_idx), with the suspensions of `halts`."""
    p = prefix
    return {
        f"{p}_vas": f"""
            select g.symbol, g.as_of, m.z as zscore,
                   case when m.med <> 0 then m.last_v / m.med end as volume_ratio, m.day,
                   case when m.z is not null then round_even({ramp('m.z', 0.0, 6.0)}, 1) end
                       as sub_score
            from {grid} g left join (
              select symbol, as_of, max(day) as day, max(last_v) as last_v, max(med) as med,
                     case when max(n) >= 30 and median(abs(v - med)) * 1.4826 > 0
                          then (max(last_v) - max(med)) / (median(abs(v - med)) * 1.4826) end as z
              from (
                select *, median(case when rn between 2 and 91 then v end)
                            over (partition by symbol, as_of) as med,
                       count(case when rn between 2 and 91 then v end)
                            over (partition by symbol, as_of) as n
                from (select g.symbol, g.as_of, cast(d.volume as double) as v,
                             max(d.trade_date) over (partition by g.symbol, g.as_of) as day,
                             first_value(cast(d.volume as double)) over (
                               partition by g.symbol, g.as_of order by d.trade_date desc)
                               as last_v,
                             row_number() over (partition by g.symbol, g.as_of
                                                order by d.trade_date desc) as rn
                      from {grid} g join dated_transaction d on d.symbol = g.symbol
                       and d.session_idx between g.end_idx - 119 and g.end_idx
                      where d.volume is not null) a) b
              where rn between 2 and 91
              group by symbol, as_of) m
            on m.symbol = g.symbol and m.as_of = g.as_of""",
        f"{p}_bci_net": f"""
            select g.symbol, g.as_of, b.broker_code, sum(b.net_value) as net_value,
                   max(b.trade_date) as day
            from {grid} g join (select b.*, c.session_idx from broker_summary b
                                asof join calendar c on b.trade_date >= c.trade_date) b
              on b.symbol = g.symbol and b.session_idx >= g.end_idx - 19
             and b.trade_date <= g.as_of
            group by 1, 2, 3""",
        f"{p}_bci": f"""
            select g.symbol, g.as_of, r.top3_share, r.hhi, r.top3_codes, r.buyers, r.day,
                   case when r.buyers >= 3
                        then round_even(0.6 * {ramp('r.top3_share', 0.35, 0.85)}
                                        + 0.4 * {ramp('r.hhi', 0.10, 0.40)}, 1) end as sub_score
            from {grid} g left join (
              select symbol, as_of, count(case when net_value > 0 then 1 end) as buyers,
                     sum(case when rk <= 3 and net_value > 0 then net_value end)
                       / max(total) as top3_share,
                     sum(case when net_value > 0 then net_value * net_value end)
                       / (max(total) * max(total)) as hhi,
                     string_agg(case when rk <= 3 and net_value > 0 then broker_code end,
                                ', ' order by rk) as top3_codes,
                     max(day) as day
              from (select *, row_number() over (partition by symbol, as_of
                                                 order by net_value desc, broker_code) as rk,
                           sum(case when net_value > 0 then net_value end)
                             over (partition by symbol, as_of) as total
                    from {p}_bci_net) x
              group by symbol, as_of) r
            on r.symbol = g.symbol and r.as_of = g.as_of""",
        f"{p}_pfd": f"""
            select symbol, as_of, ret as return_90d, yoy as earnings_change,
                   ret - yoy as divergence, price_day, report_day,
                   case when price_rows >= 30 and quarters > 4
                        then round_even({ramp('ret - yoy', 0.25, 2.5)}, 1) end as sub_score
            from (
              select g.symbol, g.as_of, pr.price_rows, pr.price_day,
                     case when pr.first_price > 0 then pr.last_price / pr.first_price - 1 end
                       as ret,
                     f.quarters, f.yoy, f.report_date as report_day
              from {grid} g
              left join (select g.symbol, g.as_of, count(*) as price_rows,
                                arg_min(h.close_price, h.trade_date) as first_price,
                                arg_max(h.close_price, h.trade_date) as last_price,
                                max(h.trade_date) as price_day
                         from {grid} g join dated_price h on h.symbol = g.symbol
                          and h.session_idx between g.end_idx - 99 and g.end_idx
                         group by 1, 2) pr on pr.symbol = g.symbol and pr.as_of = g.as_of
              left join (select g.symbol, g.as_of, arg_max(q.quarters, q.report_date) as quarters,
                                arg_max(q.yoy, q.report_date) as yoy,
                                max(q.report_date) as report_date
                         from {grid} g join report_growth q on q.symbol = g.symbol
                          and q.report_date <= g.as_of
                         group by 1, 2) f on f.symbol = g.symbol and f.as_of = g.as_of) x""",
        f"{p}_ffs": f"""
            select g.symbol, g.as_of, f.pct, date_diff('day', f.day, g.as_of) as age, f.day,
                   case when f.pct > 0 and f.pct <= 1
                         and date_diff('day', f.day, g.as_of) <= 400
                        then round_even({ramp('-f.pct', -0.5, -0.05)}, 1) end as sub_score
            from {grid} g left join (
              select g.symbol, g.as_of, arg_max(f.free_float_pct, f.as_of) as pct,
                     max(f.as_of) as day
              from {grid} g join free_float f on f.symbol = g.symbol and f.as_of <= g.as_of
              group by 1, 2) f on f.symbol = g.symbol and f.as_of = g.as_of""",
        f"{p}_frd": f"""
            select symbol, as_of, net as foreign_net, outflow as outflow_ratio,
                   change as price_change, day,
                   case when flow_rows >= 10 and market_rows >= 10 and turnover > 0
                        then round_even({ramp('outflow', 0.02, 0.20)}
                          * greatest(cast(0 as double), least(cast(1 as double),
                              change / cast(0.15 as double))), 1) end as sub_score
            from (
              select g.symbol, g.as_of, fl.flow_rows, fl.net, mk.market_rows, mk.turnover, mk.day,
                     case when mk.first_close > 0 then mk.last_close / mk.first_close - 1
                          when mk.first_close is not null then 0 end as change,
                     case when mk.turnover > 0
                          then greatest(cast(0 as double), -fl.net) / mk.turnover end as outflow
              from {grid} g
              left join (select g.symbol, g.as_of, count(*) as flow_rows, sum(net_value) as net
                         from {grid} g join (select f.*, c.session_idx from foreign_flow f
                              asof join calendar c on f.trade_date >= c.trade_date) f
                           on f.symbol = g.symbol and f.session_idx >= g.end_idx - 29
                          and f.trade_date <= g.as_of
                         group by 1, 2) fl on fl.symbol = g.symbol and fl.as_of = g.as_of
              left join (select g.symbol, g.as_of, count(*) as market_rows,
                                sum(d.close_price * coalesce(d.volume, 0)) as turnover,
                                arg_min(d.close_price, d.trade_date) as first_close,
                                arg_max(d.close_price, d.trade_date) as last_close,
                                max(d.trade_date) as day
                         from {grid} g join dated_transaction d on d.symbol = g.symbol
                          and d.session_idx between g.end_idx - 29 and g.end_idx
                         group by 1, 2) mk on mk.symbol = g.symbol and mk.as_of = g.as_of) x""",
        f"{p}_sss": f"""
            select symbol, as_of, n_susp, n_sell, n_risky, last_susp, unusual, last_sell,
                   last_risky,
                   case when swept then least(cast(100 as double),
                     (case when n_susp > 0 then 40 else 0 end)
                     + (case when unusual then 15 else 0 end)
                     + least(30, 10 * n_sell) + least(25, 12 * n_risky)) end as sub_score
            from (
              select g.symbol, g.as_of, coalesce(s.n, 0) as n_susp, coalesce(f.n, 0) as n_sell,
                     coalesce(a.n, 0) as n_risky, s.last_day as last_susp,
                     coalesce({any_word("s.reason", K.UNUSUAL_REASONS)}, false) as unusual,
                     f.last_day as last_sell, a.last_day as last_risky,
                     g.as_of >= (select min(d) from (
                        select min(start_date) as d from {halts}
                        union all select min(filing_date) from filings
                        union all select min(action_date) from corporate_actions) e) as swept
              from {grid} g
              left join (select g.symbol, g.as_of, count(*) as n, max(start_date) as last_day,
                                arg_max(coalesce(reason, ''), start_date) as reason
                         from {grid} g join {halts} s on s.symbol = g.symbol
                          and s.start_date <= g.as_of
                          and s.start_date >= {months_back('g.as_of', 24)}
                         group by 1, 2) s on s.symbol = g.symbol and s.as_of = g.as_of
              left join (select g.symbol, g.as_of, count(*) as n, max(filing_date) as last_day
                         from {grid} g join filings f on f.symbol = g.symbol
                          and f.filing_date <= g.as_of and f.filing_date >= g.as_of - 90
                         where {any_word("f.transaction_type", K.SELL_WORDS)}
                         group by 1, 2) f on f.symbol = g.symbol and f.as_of = g.as_of
              left join (select g.symbol, g.as_of, count(*) as n, max(action_date) as last_day
                         from {grid} g join corporate_actions a on a.symbol = g.symbol
                          and a.action_date <= g.as_of
                          and a.action_date >= {months_back('g.as_of', 24)}
                         where {any_word("a.action_type", K.RISKY_ACTIONS)}
                         group by 1, 2) a on a.symbol = g.symbol and a.as_of = g.as_of) x""",
        f"{p}_scores": f"""
            select g.symbol, g.as_of, b.sub_score as BCI, v.sub_score as VAS,
                   p.sub_score as PFD, ff.sub_score as FFS, fr.sub_score as FRD,
                   s.sub_score as SSS
            from {grid} g
            left join {p}_bci b on b.symbol = g.symbol and b.as_of = g.as_of
            left join {p}_vas v on v.symbol = g.symbol and v.as_of = g.as_of
            left join {p}_pfd p on p.symbol = g.symbol and p.as_of = g.as_of
            left join {p}_ffs ff on ff.symbol = g.symbol and ff.as_of = g.as_of
            left join {p}_frd fr on fr.symbol = g.symbol and fr.as_of = g.as_of
            left join {p}_sss s on s.symbol = g.symbol and s.as_of = g.as_of""",
    }


def weighted(condition: str = "true") -> tuple[str, str]:
    """(sum of w*s, sum of w) in component order; `{p}` in the condition is the probe name."""
    top, covered = "cast(0 as double)", "cast(0 as double)"
    for probe, code in K.PROBE_COMPONENT.items():
        ok = f"({code} is not null and {condition.format(p=probe)})"
        w = f"cast({K.WEIGHTS[code]} as double)"
        top += f" + case when {ok} then {w} * {code} else 0 end"
        covered += f" + case when {ok} then {w} else 0 end"
    return top, covered


def composite(source: str, keep: str = "symbol, as_of", condition: str = "true") -> str:
    top, covered = weighted(condition)
    return f"""
        select *, {band('score')} as band from (
          select {keep}, cast(case when covered > 0 then round_even(top / covered, 0) else 0 end
                              as int) as score,
                 round_even(covered, 2) as confidence
          from (select *, {top} as top, {covered} as covered from {source}) x) y"""


CTES: dict[str, str] = {
    **definitions("duckdb"),
    "calendar": """
        select trade_date, cast(row_number() over (order by trade_date) as int) as session_idx
        from (select trade_date from daily_transaction union
              select trade_date from daily_close) d""",
    "price_history": """
        select symbol, trade_date, close_price from (
          select *, row_number() over (partition by symbol, trade_date order by src) as rn from (
            select symbol, trade_date, close_price, 0 as src from daily_transaction
            union all select symbol, trade_date, close_price, 1 from daily_close) a
          where close_price is not null) b where rn = 1""",
    "dated_transaction": """
        select d.*, c.session_idx from daily_transaction d
        join calendar c on c.trade_date = d.trade_date""",
    "dated_price": """
        select h.*, c.session_idx from price_history h
        join calendar c on c.trade_date = h.trade_date""",
    "report_growth": """
        select symbol, report_date, quarters,
               case when base <> 0 then (income - base) / abs(base) end as yoy
        from (select symbol, report_date, cast(net_income as double) as income,
                     lag(cast(net_income as double), 4) over (
                       partition by symbol order by report_date) as base,
                     row_number() over (partition by symbol order by report_date) as quarters
              from quarterly_financials where net_income is not null) q""",
    "weekly": """
        select max(trade_date) as as_of, max(session_idx) as end_idx from calendar
        group by date_trunc('week', trade_date)""",
    "monthly": """
        select max(trade_date) as as_of, max(session_idx) as end_idx from calendar
        group by date_trunc('month', trade_date)""",
    "grid": "select p.symbol, w.as_of, w.end_idx from company_profile p cross join weekly w",
    "month_grid":
        "select p.symbol, w.as_of, w.end_idx from company_profile p cross join monthly w",
    **probes("w", "grid"),
    **probes("m", "month_grid"),
    **probes("h", "month_grid", "halts"),
    "month_composite": composite("m_scores"),
    "week_composite": composite("w_scores"),
}


def with_ctes(sql: str) -> str:
    """Prefix `sql` with the CTEs it uses, in order of dependency."""
    ordered: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in dict.fromkeys(re.findall(r"(?:from|join)\s+(\w+)", text)):
            if name in CTES and name not in ordered and name not in path:
                visit(CTES[name], (*path, name))
                ordered.append(name)

    visit(sql, ())
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{name} as ({CTES[name]})" for name in ordered)
    return f"with {ctes}\n{sql.strip()}"
