"""Registered jobs: selection policies, budgets, work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.functions import scalar as S
from tapelens.operators import pit, policies, probes
from tapelens.plans import check_sql as C
from tapelens.plans.probe_jobs import monthly_grid
from tapelens.plans.registry import query


def cost_case(column: str) -> str:
    return "case " + column + " " + " ".join(
        f"when '{p}' then {c}" for p, c in K.PROBE_COST.items()) + " end"


def call_case(column: str) -> str:
    return "case " + column + " " + " ".join(
        f"when '{e}' then {K.call_cost(e)}" for e in K.ENDPOINTS) + " end"


# A budget per symbol: what its dearest earlier investigation cost.
_PROBE_LIST = ", ".join(f"'{p}'" for p in K.PROBES)
_COST_LIST = ", ".join(str(K.PROBE_COST[p]) for p in K.PROBES)
_CODE_LIST = ", ".join(f"'{c}'" for c in K.COMPONENTS)


def greedy_cte(order_by: str) -> str:
    """Greedy fill as a recursive walk over the ordered probes of each symbol."""
    return f"""
        select symbol, string_agg(probe, ',' order by n) as chosen from (
          with recursive items as (
            select b.symbol, b.budget, p.probe, p.cost,
                   row_number() over (partition by b.symbol order by {order_by}) as n
            from budgets b cross join (
              select unnest([{_PROBE_LIST}]) as probe, unnest([{_COST_LIST}]) as cost,
                     unnest(range(6)) as pos) p),
          walk as (
            select symbol, n, probe, cost <= budget as taken,
                   case when cost <= budget then budget - cost else budget end as left_over
            from items where n = 1
            union all
            select i.symbol, i.n, i.probe, i.cost <= w.left_over,
                   case when i.cost <= w.left_over then w.left_over - i.cost
                        else w.left_over end
            from walk w join items i on i.symbol = w.symbol and i.n = w.n + 1)
          select * from walk where taken) x group by symbol"""


def arm_sql(arm: str, chosen: str, source: str, scores: str) -> str:
    top, covered = C.weighted("contains(',' || chosen || ',', ',{p},')")
    cost = " + ".join(f"case when contains(',' || chosen || ',', ',{p},') then {c} else 0 end"
                      for p, c in K.PROBE_COST.items())
    return f"""
        select symbol, as_of, '{arm}' as arm, chosen, credits, score, confidence,
               {C.band('score')} as band
        from (select symbol, as_of, chosen, {cost} as credits,
                     cast(case when covered > 0 then round_even(top / covered, 0) else 0 end
                          as int) as score, round_even(covered, 2) as confidence
              from (select *, {top} as top, {covered} as covered
                    from (select s.*, {chosen} as chosen from {scores} s {source}) y) z) u"""


def arm_ctes(scores: str, prefix: str = "") -> dict[str, str]:
    """The five arms over a CTE of sub-scores, and each row next to the exhaustive arm's."""
    p = prefix
    return {
        f"{p}arm_exhaustive": arm_sql("exhaustive", f"'{_all}'", "", scores),
        f"{p}arm_fixed_order": arm_sql(
            "fixed_order", "coalesce(c.chosen, '')",
            "left join fixed_choice c on c.symbol = s.symbol", scores),
        f"{p}arm_random": arm_sql(
            "random", "coalesce(c.chosen, '')",
            "left join random_choice c on c.symbol = s.symbol", scores),
        f"{p}arm_oracle": arm_sql(
            "oracle", "coalesce(c.chosen, '')",
            "left join oracle_choice c on c.symbol = s.symbol", scores),
        f"{p}arm_cheapest_two": arm_sql("cheapest_two", f"'{_two}'", "", scores),
        f"{p}arms": f"""
        select * from {p}arm_exhaustive union all select * from {p}arm_fixed_order
        union all select * from {p}arm_random union all select * from {p}arm_oracle
        union all select * from {p}arm_cheapest_two""",
        f"{p}judged": f"""
        select a.*, e.band as ref_band, e.credits as ref_credits, e.chosen as ref_chosen
        from {p}arms a join {p}arm_exhaustive e on e.symbol = a.symbol and e.as_of = a.as_of""",
    }


_all = ",".join(K.PROBES)
_two = ",".join(policies.cheapest_two())
C.CTES.update({
    "budgets": """
        select p.symbol, coalesce(i.budget, 6) as budget from company_profile p
        left join (select symbol, max(credits_total) as budget from investigations group by 1) i
          on i.symbol = p.symbol""",
    "fixed_choice": greedy_cte("p.pos"),
    "random_choice": greedy_cte("md5(b.symbol || '|' || p.probe || '|0')"),
    "subsets": f"""
        select mask, sum(cost) as cost, sum(w) as weight, string_agg(probe, ',' order by pos)
                 as chosen, count(*) as size, string_agg(cast(pos as varchar), '' order by pos)
                 as enum
        from (select unnest(range(1, 64)) as mask) m
        cross join (select unnest([{_PROBE_LIST}]) as probe, unnest([{_COST_LIST}]) as cost,
                           unnest([{', '.join(f'cast({K.WEIGHTS[c]} as decimal(4,2))' for c in K.COMPONENTS)}])
                             as w, unnest(range(6)) as pos) p
        where (mask >> pos) & 1 = 1 group by mask""",
    "oracle_choice": """
        select symbol, chosen from (
          select b.symbol, s.chosen, row_number() over (partition by b.symbol
                   order by s.weight desc nulls last, s.size, s.enum) as rn
          from budgets b left join subsets s on s.cost <= b.budget) x where rn = 1""",
    **arm_ctes("m_scores"),
    **arm_ctes("h_scores", "h_"),
})


def month_scores(t):
    """The six sub-scores per symbol and month end, with the symbol's budget."""
    spent = t["investigations"].groupBy("symbol").agg(F.max("credits_total").alias("budget"))
    table = probes.score_table(probes.run_all(t, monthly_grid(t)))
    return table.join(spent, "symbol", "left").withColumn(
        "budget", F.coalesce("budget", F.lit(6)))


def arms(t):
    return policies.standard_arms(month_scores(t))


def joined(name="chosen"):
    return F.array_join(name, ",").alias(name)


@query("q1_cost_table", f"""
    select probe, list_cost, coalesce(sum(calls), 0) as ledger_calls from (
      select unnest([{_PROBE_LIST}]) as probe, unnest([{_COST_LIST}]) as list_cost) p
    left join (select unnest([{', '.join(repr(p) for p, es in K.PROBE_ENDPOINTS.items() for _ in es)}]) as pr,
                      unnest([{', '.join(repr(e) for es in K.PROBE_ENDPOINTS.values() for e in es)}]) as endpoint) x
      on x.pr = p.probe
    left join (select endpoint, count(*) as calls from credit_ledger group by 1) l
      on l.endpoint = x.endpoint
    group by 1, 2""")
def cost_table(t):
    return policies.cost_catalogue(t.spark, t["credit_ledger"]).select(
        "probe", F.col("credit_cost").alias("list_cost"), "ledger_calls")


@query("q15_cost_catalogue", f"""
    select probe, sum(cost) as credit_cost, string_agg(x.endpoint, ',' order by x.endpoint)
             as endpoints, string_agg(distinct route, ',' order by route) as transports,
           coalesce(sum(credits), 0) as ledger_credits
    from (select unnest([{', '.join(repr(p) for p, es in K.PROBE_ENDPOINTS.items() for _ in es)}]) as probe,
                 unnest([{', '.join(repr(e) for es in K.PROBE_ENDPOINTS.values() for e in es)}]) as endpoint,
                 unnest([{', '.join(str(K.call_cost(e)) for es in K.PROBE_ENDPOINTS.values() for e in es)}]) as cost,
                 unnest([{', '.join(repr(K.ENDPOINTS[e][3]) for es in K.PROBE_ENDPOINTS.values() for e in es)}]) as route) x
    left join (select endpoint, sum(credits) as credits from credit_ledger group by 1) l
      on l.endpoint = x.endpoint
    group by 1""")
def catalogue(t):
    return policies.cost_catalogue(t.spark, t["credit_ledger"]).select(
        "probe", "credit_cost", "endpoints", "transports", "ledger_credits")


@query("q2_billed_units", """
    select endpoint, count(*) as calls, sum(credits) as recorded, sum(billed) as billed,
           sum(billed) - sum(credits) as gap
    from (select *, case endpoint when 'fetch-free-float' then greatest(1, ceil(rows_returned / 100))
                     when 'fetch-quarterly-financials' then greatest(1, rows_returned)
                     when 'fetch-broker-summary-top' then 2 else 1 end as billed
          from credit_ledger) x group by 1""")
def reconcile(t):
    calls = t["credit_ledger"].withColumn(
        "billed", policies.billed(F.col("endpoint"), F.col("rows_returned")))
    return calls.groupBy("endpoint").agg(
        F.count("*").alias("calls"), F.sum("credits").alias("recorded"),
        F.sum("billed").alias("billed"),
        (F.sum("billed") - F.sum("credits")).alias("gap"))


def one_arm(name):
    def job(t):
        chosen = {
            "exhaustive": policies.exhaustive(),
            "fixed_order": policies.fixed_order(F.col("budget")),
            "random": policies.random_order(F.col("symbol"), F.col("budget")),
            "oracle": policies.oracle_subset(F.col("budget")),
            "cheapest_two": F.array(*[F.lit(p) for p in policies.cheapest_two()]),
        }[name]
        rows = policies.arm_rows(month_scores(t), {name: chosen})
        return rows.select("symbol", "as_of", joined(), "credits", "score", "band", "confidence")

    return job


for key, arm in (("q3_arm_exhaustive", "exhaustive"), ("q4_arm_fixed_order", "fixed_order"),
                 ("q5_arm_random", "random"), ("q6_arm_oracle_knapsack", "oracle"),
                 ("q7_arm_cheapest_two", "cheapest_two")):
    query(key, f"select symbol, as_of, chosen, credits, score, band, confidence "
               f"from arm_{arm}")(one_arm(arm))


@query("q8_equal_split_budget", """
    select as_of, symbol, position,
           total // n + case when position <= total % n then 1 else 0 end as budget
    from (select m.as_of, m.symbol, row_number() over (partition by m.as_of order by m.symbol)
                   as position, count(*) over (partition by m.as_of) as n,
                 sum(b.budget) over (partition by m.as_of) as total
          from month_grid m join budgets b on b.symbol = m.symbol) x""")
def equal_split(t):
    spent = t["investigations"].groupBy("symbol").agg(F.max("credits_total").alias("spent"))
    cases = monthly_grid(t).join(spent, "symbol", "left").withColumn(
        "spent", F.coalesce("spent", F.lit(6)))
    total = F.sum("spent").over(pit.W.partitionBy("as_of"))
    return policies.equal_split(cases.withColumn("total", total), F.col("total"), ["symbol"],
                                ["as_of"]).select("as_of", "symbol", "position", "budget")


@query("q9_band_agreement", """
    select arm, as_of, sum(credits) as credits, count(case when band = ref_band then 1 end)
             as agreed, count(*) as cases from judged group by 1, 2""")
def agreement(t):
    judged = policies.with_reference_band(arms(t))
    return judged.groupBy("arm", "as_of").agg(
        F.sum("credits").alias("credits"),
        F.count_if(F.col("band") == F.col("reference_band")).alias("agreed"),
        F.count("*").alias("cases"))


@query("d18_arm_summary", """
    select arm, count(*) as cases, sum(credits) as total_credits,
           round_even(avg(credits), 2) as mean_credits,
           round_even(100 * (1 - sum(credits) / (count(*) * 16)), 1) as saving_pct,
           count(case when band = ref_band then 1 end) as agreed,
           round_even(100 * count(case when band = ref_band then 1 end) / count(*), 1)
             as agreed_pct
    from h_judged group by 1""")
def summary(t):
    """No controls are chosen here, so the suspensions of unlisted securities count too."""
    return policies.arm_summary(arms(t.with_halts()))


@query("d19_run_noise", """
    select arm, count(*) as runs, min(v) as low, max(v) as high,
           round_even(max(v) - min(v), 2) as spread, round_even(avg(v), 2) as mean,
           round_even(case when count(*) > 2 then stddev_samp(v) end, 2) as deviation
    from (select arm, as_of, round_even(100 * count(case when band = ref_band then 1 end)
                   / count(*), 1) as v from judged group by 1, 2) x
    group by 1 having count(*) >= 2""")
def noise(t):
    """Each month end is one run of the same policy: how far its agreement moves."""
    judged = policies.with_reference_band(arms(t))
    runs = judged.groupBy("arm", "as_of").agg(S.half_even(
        100 * F.count_if(F.col("band") == F.col("reference_band")) / F.count("*"), 1)
        .alias("value"))
    return policies.run_noise(runs, by=["arm"])


@query("c10_arm_pairwise_compare", """
    select symbol, as_of, arm, credits - ref_credits as credit_gap, band = ref_band as same_band,
           chosen = ref_chosen as same_choice from judged where arm <> 'exhaustive'""")
def compare(t):
    return policies.pairwise(arms(t))


@query("q10_escalation_precision", f"""
    select escalated, count(*) as total,
           count(case when band <> full_band then 1 end) as useful,
           round_even(100 * count(case when band <> full_band then 1 end) / count(*), 1)
             as precision_pct
    from (select e.escalated, e.full_band, {C.band('cast(case when covered > 0 then round_even(top / covered, 0) else 0 end as int)')} as band
          from (select *, {C.weighted("contains(',' || chosen || ',', ',{p},') and escalated <> '{p}'")[0]} as top,
                       {C.weighted("contains(',' || chosen || ',', ',{p},') and escalated <> '{p}'")[1]} as covered
                from (select s.*, a.chosen, a.band as full_band,
                             unnest(string_split(a.chosen, ',')) as escalated
                      from arm_oracle a join m_scores s on s.symbol = a.symbol
                       and s.as_of = a.as_of) x
                where escalated not in ('{_two.replace(",", "', '")}') and escalated <> '') e) y
    group by 1""")
def escalation(t):
    table = month_scores(t)
    return policies.escalation_precision(
        table, policies.standard_arms(table), "oracle")


@query("q11_choice_sensitivity", """
    select count(*) as cases, count(case when a.chosen <> b.chosen then 1 end) as different,
           round_even(100 * count(case when a.chosen <> b.chosen then 1 end) / count(*), 1)
             as different_pct
    from arm_fixed_order a join arm_random b on b.symbol = a.symbol and b.as_of = a.as_of""")
def sensitivity(t):
    return policies.choice_sensitivity(arms(t), "fixed_order", "random")


@query("q12_savings_pct", """
    select id, cast(round_even((1 - credits_total / 16) * 100, 0) as int) as saving_pct
    from investigations""")
def savings(t):
    return t["investigations"].select("id", policies.saving_pct(
        F.col("credits_total"), F.lit(K.BASELINE_COST)).alias("saving_pct"))


C.CTES.update({
    "plan_day": "select max(trade_date) as d from calendar",
    "windows": """
        select p.symbol, 'fetch-daily-transaction' as endpoint,
               d - cast(n * 136 as int) - 135 as start, d - cast(n * 136 as int) as "end"
        from (select symbol from daily_transaction group by 1) p cross join plan_day
        cross join (select unnest(range(2)) as n) k""",
    "tier2": f"""
        select p.symbol, endpoint,
               case when endpoint in ({', '.join(repr(e) for e in K.TIER2_DATED)})
                    then first_day end as start,
               case when endpoint in ({', '.join(repr(e) for e in K.TIER2_DATED)})
                    then d end as "end",
               case when endpoint = 'fetch-quarterly-financials' then 8 end as n_quarters
        from (select symbol from daily_transaction group by 1) p cross join plan_day
        cross join (select unnest([{', '.join(repr(e) for e in K.TIER2_ENDPOINTS)}]) as endpoint) e
        cross join (select min(day) as first_day from (
          select d - cast(i as int) as day from plan_day cross join range(300) r(i)
          where isodow(d - cast(i as int)) < 6 order by day desc limit 120) w) f""",
})


def plan_day(t):
    return pit.trading_calendar(t).agg(F.max("trade_date")).scalar()


def tier2(t):
    span = pit.trading_calendar(t).agg(F.max("trade_date").alias("day")).select(
        policies.first_weekday(F.col("day")).alias("start"))
    return policies.tier2_calls(traded(t), span.scalar(), plan_day(t))


def traded(t):
    return t["daily_transaction"].select("symbol").distinct()


@query("q13_fetch_windows", "select * from windows")
def windows(t):
    return policies.fetch_windows(traded(t), plan_day(t))


@query("q14_tier2_worklist", "select * from tier2")
def worklist(t):
    return tier2(t)


@query("d22_plan_cost", f"""
    select stage, endpoint, count(*) as calls, sum({call_case('endpoint')}) as credits
    from (select 1 as stage, endpoint from windows union all select 3, endpoint from tier2) x
    group by rollup (stage, endpoint)""")
def plan_cost(t):
    calls = policies.fetch_windows(traded(t), plan_day(t)).select(
        F.lit(1).alias("stage"), "endpoint").unionByName(
        tier2(t).select(F.lit(3).alias("stage"), "endpoint"))
    return policies.plan_cost(calls)
