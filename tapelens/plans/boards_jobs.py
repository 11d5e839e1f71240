"""Registered jobs: ledger reports, memory, selection of the day, boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.operators import boards, ledger, pit, selection
from tapelens.plans import check_sql as C
from tapelens.plans import probe_jobs
from tapelens.plans.probe_jobs import month_watchlist, monthly_grid
from tapelens.plans.registry import query
from tapelens.session import cut_lineage

_PHASES = ", ".join(f"'{p}'" for p in K.PHASE_CAPS)
_CAPS = ", ".join(str(c) for c in K.PHASE_CAPS.values())
C.CTES["caps"] = f"select unnest([{_PHASES}]) as phase, unnest([{_CAPS}]) as cap"


# -- ledger ---------------------------------------------------------------------------------------
@query("d15_spend_by_phase", """
    select *, case when phase = 'TOTAL' then '' when pct >= 0.9 then '90%'
                   when pct >= 0.7 then '70%' else '' end as flag
    from (select coalesce(phase, 'TOTAL') as phase, cap, spent, cap - spent as remaining,
                 round(spent / cap, 6) as pct
          from (select c.phase, sum(c.cap) as cap, sum(coalesce(s.spent, 0)) as spent
                from caps c left join (select phase, sum(credits) as spent from credit_ledger
                                       group by 1) s on s.phase = c.phase
                group by rollup (c.phase)) x) y""")
def by_phase(t):
    return ledger.spend_by_phase(t["credit_ledger"]).withColumn("pct", F.round("pct", 6))


@query("d16_spend_by_endpoint", """
    select endpoint, sum(credits) as credits, count(*) as calls, max(ts) as last_ts
    from credit_ledger group by 1""")
def by_endpoint(t):
    return ledger.spend_by_endpoint(t["credit_ledger"])


@query("d17_model_usage", """
    select coalesce(provider, 'TOTAL') as provider, coalesce(model, '') as model,
           count(*) as calls, sum(input_tokens) as input_tokens,
           sum(output_tokens) as output_tokens, round(sum(seconds), 2) as seconds
    from (select transport as provider, phase as model, length(cast(ts as varchar)) as input_tokens,
                 credits as output_tokens, cast(seconds as decimal(18,2)) as seconds
          from credit_ledger) u
    group by grouping sets ((provider, model), ())""")
def usage(t):
    calls = t["credit_ledger"].select(
        F.col("transport").alias("provider"), F.col("phase").alias("model"),
        F.length(F.col("ts").cast("string")).alias("input_tokens"),
        F.col("credits").alias("output_tokens"),
        F.col("seconds").cast("decimal(18,2)").alias("seconds"))
    return ledger.usage_by_model(calls).withColumn("seconds", F.round("seconds", 2))


@query("d23_call_stats", """
    select coalesce(transport, 'TOTAL') as transport, count(*) as calls,
           count(case when cached then 1 end) as cache_hits,
           round(count(case when cached then 1 end) / count(*), 6) as hit_rate,
           sum(case when cached then 0 else credits end) as credits, sum(retries) as retries
    from credit_ledger group by rollup (transport)""")
def call_stats(t):
    return ledger.call_stats(t["credit_ledger"]).withColumn("hit_rate", F.round("hit_rate", 6))


@query("w7_first_threshold_crossing", """
    select phase, level, cap, ts, event_id, spent from (
      select r.phase, l.level, c.cap, r.ts, r.event_id, r.spent,
             row_number() over (partition by r.phase, l.level order by r.ts, r.event_id) as rn
      from (select phase, ts, event_id, sum(credits) over (
              partition by phase order by ts, event_id) as spent from credit_ledger) r
      join caps c on c.phase = r.phase
      cross join (select unnest([0.7, 0.9]) as level) l
      where r.spent / c.cap >= l.level) x where rn = 1""")
def crossings(t):
    return ledger.first_crossings(t["credit_ledger"])


def fingerprinted(t):
    params = F.create_map(F.lit("symbol"), F.col("symbol"),
                          F.lit("rows"), F.col("rows_returned").cast("string"),
                          F.lit("cursor"), F.lit(None).cast("string"))
    return t["credit_ledger"].withColumn(
        "fingerprint", ledger.fingerprint(F.col("endpoint"), params))


@query("e12_ledger_call_dedup", """
    select fingerprint, min(ts) as ts, arg_min(event_id, ts) as event_id, count(*) as requests
    from (select ts, event_id, sha256(endpoint || '|{"rows":"' || rows_returned
                   || '","symbol":"' || symbol || '"}') as fingerprint
          from credit_ledger) x group by 1""")
def dedup(t):
    return ledger.first_calls(fingerprinted(t)).drop("credits")


@query("p19_recently_bought", """
    select endpoint, symbol, max(cast(ts as date)) as last_bought,
           max(cast(ts as date)) >= date '2024-01-31' - 7 as recent
    from credit_ledger group by 1, 2""")
def bought(t):
    return ledger.recently_bought(t["credit_ledger"], F.lit("2024-01-31").cast("date"), 7)


C.CTES["gaps"] = """
    select g.symbol, g.as_of, count(d.session_idx) as rows,
           coalesce(max(d.session_idx) < g.end_idx, false) as behind,
           coalesce(max(d.session_idx) - min(d.session_idx) + 1 - count(d.session_idx), 0)
             as holes
    from month_grid g left join dated_transaction d on d.symbol = g.symbol
     and d.session_idx <= g.end_idx
    group by g.symbol, g.as_of, g.end_idx"""


@query("p18_freshness_gap_audit", """
    select symbol, as_of, rows, behind, holes, behind or holes > 0 as stale from gaps""")
def gaps(t):
    return selection.freshness_gaps(t, monthly_grid(t))


@query("p20_fetch_decision", """
    select g.symbol, g.as_of, (g.rows < 1000 or g.behind) and not coalesce(b.recent, false)
             as needed, g.rows % 3 >= 1 as affordable,
           (g.rows < 1000 or g.behind) and not coalesce(b.recent, false) and g.rows % 3 >= 1
             as fetch
    from gaps g left join (
      select symbol, max(cast(ts as date)) >= date '2024-01-30' as recent from credit_ledger
      where endpoint = 'fetch-daily-transaction' group by 1) b on b.symbol = g.symbol""")
def decisions(t):
    stale = selection.freshness_gaps(t, monthly_grid(t), holes_count=False)
    recent = ledger.recently_bought(t["credit_ledger"], F.lit("2024-01-31").cast("date"), 1)
    return selection.fetch_decisions(stale, recent, "fetch-daily-transaction",
                                     F.col("rows") % 3, min_rows=1000).select(
        "symbol", "as_of", "needed", "affordable", "fetch")


# -- memory and selection ------------------------------------------------------------------------
C.CTES["recalled"] = """
    select g.symbol, g.as_of, max(i.as_of) as seen_on, arg_max(i.score, i.as_of) as score,
           arg_max(i.confidence, i.as_of) as confidence
    from month_grid g left join investigations i on i.symbol = g.symbol and i.as_of < g.as_of
    group by 1, 2"""


@query("e1_recall_latest_before", "select symbol, as_of, seen_on, score from recalled")
def recall(t):
    return selection.recall(monthly_grid(t), t["investigations"]).select(
        "symbol", "as_of", "memory.seen_on", "memory.score")


def remembered(t):
    """Month-end investigations of the two best of each watchlist, as a memory to select by."""
    picked = month_watchlist(t).where("rank % 3 = 1").select("symbol", "as_of", "score")
    return picked.select(
        "symbol", "as_of", (F.col("score") * 100).cast("int").alias("score"),
        F.lit("normal").alias("band"), F.lit(0.7).alias("confidence"),
        F.lit(5).alias("credits_total"))


def session_watchlist(t):
    return probe_jobs.watchlist(t, probe_jobs.session_grid)


C.CTES.update({
    "daily_memory": """
        select symbol, as_of, 0.7 as confidence from s_watchlist where (rank + day(as_of)) % 3 = 1""",
    "daily_recalled": """
        select w.as_of, w.symbol, w.rank, w.score, w.rank % 4 = 2 and day(w.as_of) % 2 = 0 as requested,
               d.symbol is not null as done, m.as_of as seen_on, e.score as seen_score,
               coalesce(m.as_of >= o.trade_date and abs(w.score - e.score) < 0.05, false) as recent
        from s_watchlist w
        left join daily_memory d on d.symbol = w.symbol and d.as_of = w.as_of
        left join lateral (select max(as_of) as as_of from daily_memory k
                           where k.symbol = w.symbol and k.as_of < w.as_of) m on true
        left join s_watchlist e on e.symbol = w.symbol and e.as_of = m.as_of
        left join calendar c on c.trade_date = w.as_of
        left join calendar o on o.session_idx = greatest(c.session_idx - 2, 1)""",
    "daily_cooled": """
        select *, recent and not requested and not done as cooled from daily_recalled""",
})


@query("e3_cooldown_selection", """
    select as_of, symbol, rank, requested,
           case when not (requested or taken < 3) then null when done then 'done'
                when cooled then 'cooldown' else 'investigate' end as status
    from (select *, coalesce(sum(case when cooled or (requested and rank > 3) then 0 else 1 end) over (
                      partition by as_of order by rank
                      rows between unbounded preceding and 1 preceding), 0) as taken
          from daily_cooled) x""")
def cooldown(t):
    """Every session's watchlist against a memory of earlier ones, with requests."""
    listed = cut_lineage(session_watchlist(t).select("as_of", "symbol", "rank", "score"))
    memory = listed.where((F.col("rank") + F.day("as_of")) % 3 == 1).select(
        "symbol", "as_of", F.lit(50).alias("score"), F.lit("normal").alias("band"),
        F.lit(0.7).alias("confidence"), F.lit(5).alias("credits_total"))
    asked = listed.where((F.col("rank") % 4 == 2) & (F.day("as_of") % 2 == 0)).select("symbol", "as_of")
    return selection.cooldown_selection(listed, memory, pit.trading_calendar(t), asked).select(
        "as_of", "symbol", "rank", "requested", "status")


C.CTES.update({
    "requests": """
        select cast(o_orderdate as date) as day, o_orderkey as seq,
               case when o_custkey % 7 = 0 then 'X1' else c.symbol end as code
        from orders o join statements c on c.doc_id = o.o_orderkey""",
    "quoted": """
        select r.day, r.seq, case when f.first_seq is not null then r.code end as symbol,
               case when f.first_seq is null then 'rejected' when f.place <= 3 then 'accepted'
                    else 'deferred' end as status
        from requests r left join (
          select day, code, first_seq, row_number() over (partition by day order by first_seq)
                   as place
          from (select day, code, min(seq) as first_seq from requests
                where code in (select symbol from free_float) group by 1, 2) x) f
          on f.day = r.day and f.code = r.code""",
})


def requests(t):
    """Orders read as requests: the code stands in the title or in the form field."""
    asked = t["statements"].select(F.col("doc_id").alias("o_orderkey"), "symbol")
    rows = t["orders"].join(asked, "o_orderkey")
    code = F.when(F.col("o_custkey") % 7 == 0, "X1").otherwise(F.lower("symbol"))
    in_form = F.col("o_custkey") % 2 == 0
    title = F.when(~in_form, F.concat(F.lit("Selidiki : "), code)).otherwise("permintaan")
    body = F.when(in_form, F.concat(F.lit("### Kode emiten\n\n"), code, F.lit("\nterima kasih")))
    return rows.select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("seq"),
                       selection.request_code(title, body).alias("code"))


@query("t13_parse_request_code", "select day, seq, code from requests")
def request_codes(t):
    return requests(t)


@query("e4_request_quota", "select day, seq, symbol, status from quoted")
def quota(t):
    return selection.request_quota(requests(t), t["free_float"].select("symbol").distinct())


@query("e5_request_status", """
    select q.day, q.seq, q.symbol, case when q.status <> 'accepted' then q.status
             when d.symbol is not null then 'investigated' else 'failed' end as status
    from quoted q left join (select distinct trade_date as day, symbol from daily_transaction) d
      on d.day = q.day and d.symbol = q.symbol""")
def outcomes(t):
    asked = selection.request_quota(requests(t), t["free_float"].select("symbol").distinct())
    done = t["daily_transaction"].select(
        F.col("trade_date").alias("day"), "symbol").distinct().withColumn(
        "status", F.lit("investigated"))
    return selection.request_outcome(asked, done).select("day", "seq", "symbol", "status")


@query("p24_conclude_gate", """
    select id, confidence >= 0.4 or not (1 <= 16 - credits_total) as may_conclude
    from investigations""")
def gate(t):
    return t["investigations"].select("id", selection.conclude_gate(
        F.col("confidence"), F.lit(1), F.lit(K.BASELINE_COST) - F.col("credits_total"))
        .alias("may_conclude"))


# -- boards ------------------------------------------------------------------------------------------
@query("e6_investigation_board_order",
       "select symbol, as_of, score, band, id from investigations")
def order(t):
    return boards.board_order(t["investigations"]).select(
        "symbol", "as_of", "score", "band", "id")


@query("e7_latest_per_symbol", """
    select symbol, arg_max(id, as_of) as id from investigations group by 1""")
def latest(t):
    return boards.latest_per_symbol(t["investigations"])


@query("w8_score_delta", """
    select symbol, as_of, score, cov, score - lag(score) over (partition by symbol order by as_of)
             as delta, score >= 60 and cov <= 2 as thin from investigations""")
def delta(t):
    return boards.score_changes(t["investigations"])


@query("d21_history_tiles", """
    select count(*) as total, count(distinct symbol) as symbols,
           count(case when band <> 'normal' then 1 end) as flagged,
           round(avg(cov), 6) as mean_components from investigations""")
def tiles(t):
    return boards.history_tiles(t["investigations"]).withColumn(
        "mean_components", F.round("mean_components", 6))


_SYMBOLS = [f"BR{chr(65 + n // 10)}{chr(65 + n % 10)}" for n in range(1, 26)]


@query("w11_score_trend_pivot", "select as_of, " + ", ".join(
    f"max(case when symbol = '{s}' then score end) as {s}" for s in _SYMBOLS)
    + " from investigations group by 1")
def trend(t):
    return boards.trend_matrix(t["investigations"], _SYMBOLS)


@query("c9_selection_to_investigation", """
    select w.as_of, w.symbol, w.rank, i.id as investigation_id,
           i.score as investigation_score
    from m_watchlist w left join investigations i on i.symbol = w.symbol and i.as_of = w.as_of""")
def selected(t):
    return boards.selection_with_results(month_watchlist(t), t["investigations"]).select(
        "as_of", "symbol", "rank", "investigation_id", "investigation_score")


@query("e10_activity_feed", """
    select cast(as_of as varchar) || 'T00:00:00+00:00' as ts, as_of as date, 'sweep' as kind,
           count(*) as n_candidates, null as id from m_watchlist group by as_of
    union all
    select cast(as_of as varchar) || 'T17:30:00+07:00', as_of, 'investigation', null, id
    from investigations""")
def feed(t):
    sweeps = month_watchlist(t).groupBy("as_of").agg(
        F.count("*").alias("n_candidates")).select(
        "as_of", F.lit(None).cast("string").alias("generated_at"), "n_candidates",
        F.lit(5).alias("credits_spent"))
    return boards.activity_feed(sweeps, t["investigations"]).select(
        "ts", "date", "kind", "n_candidates", "id")


@query("e13_name_coverage", """
    select coalesce(a.name, b.name) as name, case when b.name is null then 'missing'
             when a.name is null then 'unused' else 'matched' end as status
    from (select distinct symbol as name from investigations) a
    full join (select distinct symbol as name from suspensions) b on a.name = b.name""")
def coverage(t):
    return boards.name_coverage(
        t["investigations"].select(F.col("symbol").alias("name")),
        t["suspensions"].select(F.col("symbol").alias("name")))
