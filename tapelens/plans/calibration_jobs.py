"""Registered jobs: labels, controls, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelens import constants as K

from tapelens.operators import calibration, labels, pit, scoring
from tapelens.plans import check_sql as C
from tapelens.plans.registry import query
from tapelens.session import cut_lineage

AS_OF = "1999-12-31"

C.CTES.update({
    "classified": f"""
        select *, case when regexp_matches(coalesce(reason, ''), '(?i){K.MOVEMENT_PATTERN}')
                       then 'pergerakan'
                       when regexp_matches(coalesce(reason, ''), '(?i){K.ADMIN_PATTERN}')
                       then 'administratif' else 'tak_terklasifikasi' end as reason_class
        from suspensions""",
    "episodes": """
        select symbol, start_date as event_date, reason from (
          with recursive numbered as (
            select symbol, start_date, reason,
                   row_number() over (partition by symbol order by start_date) as n
            from classified where reason_class = 'pergerakan'),
          walk as (
            select symbol, start_date, reason, n, start_date as anchor, true as kept
            from numbered where n = 1
            union all
            select m.symbol, m.start_date, m.reason, m.n,
                   case when m.start_date - w.anchor > 10 then m.start_date else w.anchor end,
                   m.start_date - w.anchor > 10
            from walk w join numbered m on m.symbol = w.symbol and m.n = w.n + 1)
          select * from walk) x where kept""",
    "price_universe": """
        select symbol, count(*) as price_rows from price_history group by symbol
        having count(*) >= 40""",
    "assessable": """
        select e.* from episodes e
        where (select count(*) from calendar c where c.trade_date < e.event_date) >= 10
          and e.symbol in (select symbol from price_universe)""",
    "control_rows": """
        select symbol, event_date, positive, match_rank from (
          select *, row_number() over (partition by positive, event_date
                                       order by distance, symbol) as match_rank
          from (
            select p.event_date, p.symbol as positive, c.symbol,
                   case when pp.market_cap > 0 and cp.market_cap > 0
                        then abs(log10(cast(pp.market_cap as double))
                                 - log10(cast(cp.market_cap as double)))
                        else cast('infinity' as double) end as distance,
                   pp.sub_sector is not distinct from cp.sub_sector as same,
                   max(case when pp.sub_sector is not distinct from cp.sub_sector then 1 else 0
                       end) over (partition by p.symbol, p.event_date) as any_same
            from assessable p
            cross join (select symbol from price_universe
                        where symbol not in (select symbol from assessable)) c
            left join company_profile pp on pp.symbol = p.symbol
            left join company_profile cp on cp.symbol = c.symbol) x
          where same or any_same = 0) y
        where match_rank <= 3""",
    "labelled": """
        select symbol, event_date, 1 as label from assessable
        union all select symbol, event_date, 0 from control_rows""",
    "lagged": """
        select l.symbol, l.event_date, l.label, g.lag, c.trade_date as as_of, c.session_idx
        from labelled l cross join (select unnest([1, 3, 5, 10]) as lag) g
        join calendar c on c.session_idx =
          (select max(session_idx) from calendar k where k.trade_date < l.event_date)
          - g.lag + 1""",
    "event_grid": "select distinct symbol, as_of, session_idx as end_idx from lagged",
    **C.probes("o", "event_grid"),
    "observed": """
        select l.symbol, l.event_date, l.lag, l.as_of, l.label, s.BCI, s.VAS, s.PFD, s.FFS,
               s.FRD, s.SSS
        from lagged l join o_scores s on s.symbol = l.symbol and s.as_of = l.as_of""",
    "observed_long": """
        select lag, label, unnest(['BCI', 'VAS', 'PFD', 'FFS', 'FRD', 'SSS']) as component,
               unnest([BCI, VAS, PFD, FFS, FRD, SSS]) as s from observed""",
    "auc": """
        select n.component, n.position,
               case when sum(case when label = 1 then 1 end) > 0
                     and sum(case when label = 0 then 1 end) > 0
                    then (sum(case when label = 1 then rk end)
                          - sum(case when label = 1 then 1 end)
                            * (sum(case when label = 1 then 1 end) + 1) / 2)
                         / (sum(case when label = 1 then 1 end)
                            * sum(case when label = 0 then 1 end)) end as auc
        from (select unnest(['BCI', 'VAS', 'PFD', 'FFS', 'FRD', 'SSS']) as component,
                     unnest([0, 1, 2, 3, 4, 5]) as position) n
        left join (select component, label,
                          rank() over (partition by component order by s)
                          + (count(*) over (partition by component, s) - 1) / 2 as rk
                   from observed_long where s is not null) r on r.component = n.component
        group by 1, 2""",
    "weights": """
        select component, auc,
               case when total > 0 and (select count(*) from assessable) >= 30
                    then round_even(rounded + case when place = 1 then residual else 0 end, 2)
                    else prior end as weight
        from (select *, cast(1 as double) - sum(rounded) over () as residual,
                     row_number() over (order by rounded desc, position) as place
              from (select *, round_even(case when total > 0 then excess / total end, 2)
                              as rounded
                    from (select *, sum(excess) over () as total from (
                            select component, position, auc,
                                   greatest(0, coalesce(auc, 0.5) - 0.5) as excess,
                                   case component when 'BCI' then 0.25 when 'VAS' then 0.22
                                     when 'PFD' then 0.12 when 'FFS' then 0.18
                                     when 'FRD' then 0.15 else 0.08 end as prior
                            from auc) a) b) c) d""",
})
_top, _covered = C.weighted()
C.CTES.update({
    "observed_scored": f"""
        select *, case when covered > 0 then top / covered end as composite, covered as conf
        from (select *, {_top} as top, {_covered} as covered from observed) x""",
    "peaks": """
        select symbol, event_date, label, max(composite) as peak,
               max(case when composite >= 60 then lag end) as lead, sum(conf) as conf_sum,
               count(*) as n_rows
        from observed_scored where composite is not null group by 1, 2, 3""",
    "split": """
        select *, case when event_date < (
            select event_date from (select event_date, row_number() over (order by event_date) - 1
                                      as n from (select distinct event_date from observed) d) e
            where n = (select cast(floor(count(distinct event_date) * 0.75) as bigint)
                       from observed))
          then 'calibration' else 'test' end as part from observed""",
})


def r6(name):
    return F.round(name, 6).alias(name)


@query("p13_label_positive_keywords", f"""
    select symbol, start_date, coalesce(reason, '') as reason,
           {C.any_word("coalesce(reason, '')", K.POSITIVE_REASONS)} as is_positive
    from suspensions where start_date <= date '{AS_OF}' and start_date >= date '1997-12-01'""")
def keywords(t):
    return labels.keyword_labels(t, AS_OF).select("symbol", "start_date", "reason", "is_positive")


@query("p14_label_reason_class", """
    select symbol, start_date, reason_class from classified""")
def classes(t):
    return labels.classified(t).select("symbol", "start_date", "reason_class")


@query("d8_positives_ranked", f"""
    select symbol, count(*) as events, max(start_date) as latest from suspensions
    where {C.any_word("coalesce(reason, '')", K.POSITIVE_REASONS)} group by symbol""")
def ranked(t):
    return labels.positives_ranked(t)


@query("d9_reason_class_counts", """
    select reason_class, count(*) as n from classified group by 1""")
def class_counts(t):
    return calibration.reason_class_counts(t)


@query("d10_table_inventory", """
    select 'broker_summary' as table_name, count(distinct symbol) as symbols,
           count(distinct trade_date) as dates from broker_summary
    union all select 'foreign_flow', count(distinct symbol), count(distinct trade_date)
    from foreign_flow
    union all select 'free_float', count(distinct symbol), count(distinct as_of)
    from free_float""")
def inventory(t):
    return calibration.table_inventory(t)


@query("c12_episode_collapse", "select symbol, event_date, reason from episodes")
def episodes(t):
    return labels.collapse_episodes(labels.classified(t).where("reason_class = 'pergerakan'"))


@query("p15_assessable_events", "select symbol, event_date from assessable")
def assessable(t):
    return positives(t).select("symbol", "event_date")


def positives(t):
    moves = labels.classified(t).where("reason_class = 'pergerakan'")
    return cut_lineage(labels.assessable_events(t, labels.collapse_episodes(moves)))


@query("c5_eval_universe", """
    select h.symbol, h.sessions, b.symbol is not null as has_broker,
           s.symbol is not null as ever_suspended
    from (select symbol, count(*) as sessions from daily_transaction group by 1) h
    left join (select distinct symbol from broker_summary) b on b.symbol = h.symbol
    left join (select distinct symbol from suspensions) s on s.symbol = h.symbol
    where h.sessions >= 40""")
def universe(t):
    return labels.evaluation_universe(t)


@query("c6_matched_controls_with_reuse",
       "select symbol, event_date, positive, match_rank from control_rows")
def controls(t):
    return labels.controls_with_reuse(t, positives(t))


def ranked_positives(t):
    order = labels.positives_ranked(t).select("symbol", "latest")
    return order.withColumn("rank", F.row_number().over(
        pit.W.orderBy(F.desc("latest"), "symbol")))


@query("c7_matched_controls_unique", f"""
    select * from (with recursive profile as (
        select symbol, sub_sector as sector, cast(market_cap as double) as cap from company_profile
        where market_cap is not null and sub_sector is not null),
      wanted as (
        select p.*, row_number() over (partition by sector order by latest desc, p.symbol) as k
        from profile p join (
          select symbol, max(start_date) as latest from suspensions
          where {C.any_word("coalesce(reason, '')", K.POSITIVE_REASONS)} group by 1) e
          on e.symbol = p.symbol),
      free as (
        select sector, list({{'symbol': symbol, 'cap': cap}}) as pool from profile
        where symbol not in (select symbol from wanted) group by 1),
      chosen as (
        select sector, cast(0 as bigint) as k, cast('' as varchar) as positive,
               cast([] as struct(gap double, symbol varchar)[]) as taken,
               cast([] as varchar[]) as used from free
        union all
        select sector, k, positive, taken, list_concat(used, [x.symbol for x in taken]) from (
          select c.sector, w.k, w.symbol as positive, c.used,
                 list_sort([{{'gap': abs(x.cap - w.cap), 'symbol': x.symbol}} for x in f.pool
                            if not list_contains(c.used, x.symbol)])[1:2] as taken
          from chosen c join wanted w on w.sector = c.sector and w.k = c.k + 1
          join free f on f.sector = c.sector) s)
    select positive, x.symbol as symbol, x.gap as cap_gap
    from (select positive, unnest(taken) as x from chosen) t) y""")
def unique_controls(t):
    return labels.controls_unique(t, ranked_positives(t))


@query("c8_matched_pairs_float", f"""
    select * from (with recursive newest as (
        select symbol, arg_max(free_float_pct, as_of) as ff from free_float
        where free_float_pct is not null group by 1),
      pool as (select * from newest where symbol not in (select symbol from suspensions)),
      wanted as (
        select e.*, n.ff, row_number() over (order by latest desc, e.symbol) as k from (
          select symbol, count(*) as events, max(start_date) as latest from suspensions
          where {C.any_word("coalesce(reason, '')", K.POSITIVE_REASONS)} group by 1) e
        join newest n on n.symbol = e.symbol),
      options as (
        select w.k, list_sort(list({{'gap': abs(p.ff - w.ff), 'symbol': p.symbol, 'ff': p.ff}})) as near
        from wanted w join pool p on abs(p.ff - w.ff) <= {K.FLOAT_TOLERANCE} group by 1),
      walk as (
        select cast(0 as bigint) as k, cast([] as varchar[]) as used,
               cast(null as struct(gap double, symbol varchar, ff double)) as took
        union all
        select k, case when took is null then used else list_append(used, took.symbol) end, took from (
          select w.k, g.used, case when len(g.used) < 8 then
                 [x for x in coalesce(o.near, []) if not list_contains(g.used, x.symbol)][1] end as took
          from walk g join wanted w on w.k = g.k + 1 left join options o on o.k = w.k) s)
    select cast(row_number() over (order by g.k) as int) as pair, w.symbol as positive, w.events,
           w.latest, w.ff as positive_float, g.took.symbol as control, g.took.ff as control_float,
           g.took.gap as float_gap
    from walk g join wanted w on w.k = g.k where g.took is not null) y""")
def float_pairs(t):
    return labels.matched_pairs(t)


@query("d7_universe_by_frequency", """
    select symbol, cast(row_number() over (order by grp, symbol_rank, symbol) as int) as position
    from (
      select symbol, 0 as grp, row_number() over (order by symbol) as symbol_rank
      from (select distinct symbol from suspensions) s
      union all
      select symbol, 1, row_number() over (order by n desc, symbol) from (
        select symbol, count(*) as n from daily_transaction
        where symbol not in (select symbol from suspensions) group by 1) d) x
    qualify position <= 80""")
def by_frequency(t):
    return labels.universe_by_frequency(t)


@query("e11_universe_union", """
    select symbol, cast(row_number() over (order by grp, rk) as int) as position from (
      select symbol, 0 as grp, row_number() over (order by symbol) as rk
      from (select distinct symbol from filings) f
      union all
      select symbol, 1, row_number() over (order by symbol)
      from (select distinct symbol from company_profile
            where symbol not in (select symbol from filings)) p) x""")
def union_order(t):
    def ranked_list(name):
        return t[name].select("symbol").distinct().withColumn("rank", F.col("symbol"))

    return labels.ordered_union(ranked_list("filings"), ranked_list("company_profile"))


@query("c3_event_lag_grid", "select symbol, event_date, label, lag, as_of from lagged")
def lag_grid(t):
    return calibration.lag_grid(t, calibration.labelled_events(t)).select(
        "symbol", "event_date", "label", "lag", "as_of")


def observations(t):
    return calibration.observation_matrix(t, calibration.labelled_events(t))


@query("p16_observation_matrix", "select * from observed")
def matrix(t):
    return observations(t)


@query("p17_composite_row", """
    select symbol, event_date, lag, label, round(composite, 6) as composite,
           round(conf, 6) as confidence from observed_scored""")
def row_scores(t):
    return scoring.composite_row(observations(t)).select(
        "symbol", "event_date", "lag", "label", r6("composite"), r6("confidence"))


@query("d11_class_lag_means", """
    select lag, label, round(avg(BCI), 6) as BCI, round(avg(VAS), 6) as VAS,
           round(avg(PFD), 6) as PFD, round(avg(FFS), 6) as FFS, round(avg(FRD), 6) as FRD,
           round(avg(SSS), 6) as SSS, count(*) as n from observed group by 1, 2""")
def lag_means(t):
    return calibration.class_lag_means(observations(t)).select(
        "lag", "label", *[r6(c) for c in K.COMPONENTS], "n")


@query("d12_auc_rank", "select component, position, round(auc, 9) as auc from auc")
def auc(t):
    return calibration.auc_by_component(observations(t)).withColumn(
        "auc", F.round("auc", 9))


@query("d13_weights_from_auc", "select component, weight from weights")
def weights(t):
    events = calibration.labelled_events(t)
    enough = events.agg(
        F.count_if(F.col("label") == 1) >= K.MIN_POSITIVES_FOR_CALIBRATION).scalar()
    fitted = calibration.weights_from_auc(
        calibration.auc_by_component(calibration.observation_matrix(t, events)), enough)
    return fitted.select("component", "weight")


@query("d14_evaluation_metrics", """
    select count(*) as n, count(case when label = 1 then 1 end) as n_positive,
           count(case when label = 0 then 1 end) as n_control,
           least(20, count(*)) as k,
           round((select avg(label) from (select label from peaks
                    order by peak desc, symbol, event_date, label desc limit 20) x), 6)
             as precision_at_k,
           round(cast(count(case when label = 1 and peak >= 60 then 1 end) as double)
             / count(case when label = 1 then 1 end), 6) as recall,
           count(case when label = 0 and peak >= 60 then 1 end) as false_positive,
           median(case when label = 1 then lead end) as median_lead,
           round(sum(conf_sum) / sum(n_rows), 6) as mean_confidence
    from peaks""")
def metrics(t):
    return calibration.evaluate(observations(t)).select(
        "n", "n_positive", "n_control", "k", r6("precision_at_k"), r6("recall"),
        "false_positive", "median_lead", r6("mean_confidence"))


@query("w10_time_split", """
    select part, count(*) as n, min(event_date) as first, max(event_date) as last
    from split group by 1""")
def split(t):
    return calibration.time_split(observations(t)).groupBy("part").agg(
        F.count("*").alias("n"), F.min("event_date").alias("first"),
        F.max("event_date").alias("last"))


