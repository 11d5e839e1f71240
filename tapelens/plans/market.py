"""Market tables derived from the order tables at hand.

The text is valid Spark SQL and DuckDB SQL, so the checks can use the same definitions as
CTEs. Each heavy view starts with one aggregation whose partial step runs before the shuffle;
what follows works on at most one row per symbol and date (or per symbol, date and broker).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tapelens.session import cut_lineage

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def code(n: str) -> str:
    """SQL for a four-letter security code from a small number."""
    return (f"concat('BR', chr(65 + cast(floor(({n}) / 10) as int)), "
            f"chr(65 + cast(({n}) % 10 as int)))")


_BRAND = "cast(substr(p_brand, 7) as int)"
_MONEY = "cast(l_extendedprice as decimal(18,2))"
_QTY = "cast(l_quantity as decimal(18,2))"

# One row per security and day with a returned line of 48 or more, listed or not.
_HALTS = f"""select {code(_BRAND)} as symbol, cast(l_shipdate as date) as start_date,
                     case when min(l_linestatus) = 'F'
                          then cast(cast(l_shipdate as date) + interval '7' day as date) end
                         as end_date,
                     max(case when l_tax > 0.055
                              then 'Terjadinya peningkatan harga kumulatif yang signifikan'
                              when l_tax > 0.035
                              then 'Dalam rangka cooling down sebagai bentuk perlindungan'
                              when l_tax > 0.025 then 'Belum menyampaikan laporan keuangan'
                              when l_tax > 0.015 then 'Pengumuman bursa'
                              when l_tax > 0.005 then 'Aktivitas transaksi di luar kebiasaan' end)
                         as reason
              from lineitem join part on l_partkey = p_partkey
              where l_returnflag = 'R' and l_quantity >= 48
              group by 1, 2, cast(l_shipdate as date)"""

VIEWS: dict[str, str] = {
    "daily_transaction": f"""
        select cast(l_shipdate as date) as trade_date, {code(_BRAND)} as symbol,
               cast(sum({_MONEY}) as double) / cast(sum({_QTY}) as double) as close_price,
               cast(sum({_QTY}) as bigint) as volume, cast(null as decimal(38,0)) as market_cap
        from lineitem join part on l_partkey = p_partkey
        group by 1, 2""",
    "daily_close": f"""
        select cast(o_orderdate as date) as trade_date, {code("c_nationkey + 1")} as symbol,
               cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) / 100
                   as close_price
        from orders join customer on o_custkey = c_custkey
        group by 1, 2""",
    "broker_summary": f"""
        select cast(l_shipdate as date) as trade_date, {code(_BRAND)} as symbol,
               cast(l_suppkey as string) as broker_code,
               cast(sum(case l_returnflag when 'N' then {_MONEY} when 'R' then -{_MONEY} end)
                    as double) as net_value,
               cast(sum(case when l_returnflag = 'N' then {_MONEY} else 0 end) as double)
                   as buy_value,
               cast(sum(case when l_returnflag = 'R' then {_MONEY} else 0 end) as double)
                   as sell_value
        from lineitem join part on l_partkey = p_partkey
        where l_returnflag in ('N', 'R')
        group by 1, 2, 3""",
    "foreign_flow": f"""
        select cast(l_shipdate as date) as trade_date, {code(_BRAND)} as symbol,
               cast(sum(case l_returnflag when 'N' then {_MONEY} when 'A' then -{_MONEY} end)
                    as double) as net_value
        from lineitem join part on l_partkey = p_partkey
        where l_returnflag in ('N', 'A')
        group by 1, 2""",
    "free_float": f"""
        select symbol, cast(n as double) / (select count(*) from supplier) as free_float_pct,
               as_of
        from (select symbol, as_of, count(*) as n
              from (select distinct {code(_BRAND)} as symbol, l_suppkey,
                           last_day(cast(l_shipdate as date)) as as_of
                    from lineitem join part on l_partkey = p_partkey) s
              group by symbol, as_of) t""",
    "suspensions": f"""
        select s.symbol, start_date, end_date, reason
        from ({_HALTS}) s
        join company_profile c on c.symbol = s.symbol
        where c.listing_date is not null""",
    "halts": _HALTS,
    "filings": f"""
        select distinct cast(l_shipdate as date) as filing_date, {code(_BRAND)} as symbol,
               concat('Holder ', cast(l_suppkey as string)) as holder_name,
               case when l_linenumber <= 2 then 'institution' else 'insider' end as holder_type,
               case when l_linestatus = 'F' then 'Sell' else 'Buy' end as transaction_type,
               cast(l_quantity as bigint) * 100 as shares,
               l_extendedprice / l_quantity as price
        from lineitem join part on l_partkey = p_partkey
        where l_returnflag = 'R' and l_quantity >= 45""",
    "corporate_actions": f"""
        select distinct {code(_BRAND)} as symbol, cast(l_shipdate as date) as action_date,
               case p_type when 'PROMO' then 'right_issue' when 'STANDARD' then 'dividend'
                    when 'ECONOMY' then 'stock_split' when 'SMALL' then 'private_placement'
                    when 'LARGE' then 'agm' else 'warrant' end as action_type,
               p_name as detail
        from lineitem join part on l_partkey = p_partkey
        where l_discount > 0.095 and l_quantity >= 48""",
    "quarterly_financials": f"""
        select {code(_BRAND)} as symbol,
               last_day(cast(date_trunc('quarter', cast(l_shipdate as date))
                             + interval '2' month as date)) as report_date,
               cast(round(sum({_MONEY}), 0) as decimal(38,0)) as revenue,
               cast(round(sum({_MONEY} * (cast(0.95 as decimal(3,2))
                                          - cast(l_discount as decimal(3,2)))
                              - {_MONEY} * cast(0.90 as decimal(3,2))), 0)
                    as decimal(38,0)) as net_income,
               cast(round(sum({_QTY}), 0) * 1000 as decimal(38,0)) as total_assets
        from lineitem join part on l_partkey = p_partkey
        group by 1, 2""",
    "company_profile": f"""
        select {code(_BRAND)} as symbol, max(p_brand) as company_name,
               concat('Sector ', cast(max({_BRAND}) % 5 as string)) as sub_sector,
               cast(round(cast(sum(cast(p_retailprice as decimal(18,2))) as double) / count(*)
                          * max({_BRAND}), 0) * 1000000000 as decimal(38,0)) as market_cap,
               case when max({_BRAND}) % 7 > 0
                    then cast(date '1995-01-01' + max({_BRAND}) * interval '30' day as date) end
                   as listing_date
        from part
        group by 1""",
    "credit_ledger": """
        select event_id, ts,
               case event_type when 'click' then 'dev' when 'view' then 'backfill'
                    when 'error' then 'eval' when 'purchase' then 'daily'
                    else 'reserve' end as phase,
               case k % 5 when 0 then 'fetch-daily-transaction' when 1 then 'fetch-free-float'
                    when 2 then 'fetch-broker-summary-top' when 3 then 'fetch-foreign-flow'
                    else 'fetch-quarterly-financials' end as endpoint,
               case when k % 2 = 0 then 'rest' else 'mcp' end as transport,
               cast(ceil(value / 100) as int) as credits,
               k as rows_returned, value < 5 as cached, k % 3 as retries, value as seconds,
               """ + code("user_id % 25 + 1") + """ as symbol, user_id
        from (select event_id, ts, user_id, event_type, value,
                     cast(json_k as int) as k from event_fields) e""",
    "investigations": """
        select symbol, as_of, score,
               case when score >= 80 then 'sangat_waspada' when score >= 60 then 'waspada'
                    when score >= 30 then 'perhatian' else 'normal' end as band,
               confidence, credits_total, cov, concat(symbol, '-', cast(as_of as string)) as id
        from (select """ + code("conv_id % 25 + 1") + """ as symbol,
                     cast(date '1996-01-01' + cast(conv_id as int) * interval '1' day as date)
                         as as_of,
                     cast(sum(length(text)) % 101 as int) as score,
                     cast(count(*) % 5 as int) + 2 as cov,
                     cast(cast(sum(length(text)) % 100 as double) / 100 as double)
                         as confidence,
                     cast(sum(length(text)) % 17 as int) as credits_total
              from conversations group by conv_id) c""",
    "statements": """
        select o_orderkey as doc_id, """ + code("o_custkey % 25 + 1") + """ as symbol,
               concat(case when o_orderstatus = 'F' then 'Harga ' else 'Volume ' end,
                      """ + code("o_custkey % 25 + 1") + """, ' naik ',
                      cast(o_custkey % 97 as string), ',', cast(o_orderkey % 10 as string),
                      '% dengan nilai Rp ', cast(o_orderkey % 900 as string), ' M selama ',
                      cast(o_custkey % 3 + 1 as string), '.500 transaksi',
                      case o_orderpriority
                           when '1-URGENT' then '. Saatnya beli sekarang'
                           when '2-HIGH' then ' jual insider. RUPS berikutnya'
                           when '3-MEDIUM' then concat(' seperti ', """ + code(
                               "o_orderkey % 25 + 1") + """, ', target  harga baru')
                           when '5-LOW' then
    '. Layanan adalah alat informasi dan analisis, bukan saran investasi.'
                           else ' (4,1σ) — kapitalisasi 12 jt' end, '.') as narrative,
               concat(cast(o_custkey % 97 as string), ',', cast(o_orderkey % 10 as string), '%')
                   as display_1,
               concat('Rp ', cast((o_orderkey + o_orderkey % 2) % 900 as string), ' M')
                   as display_2,
               concat('Nilai transaksi ', cast(o_custkey % 3 + 1 as string), '500 kali')
                   as label_2,
               cast((o_orderkey + o_orderkey % 2) % 900 as double) as value_2
        from orders""",
    "transcript_steps": """
        select doc_id, symbol, as_of, step, n_steps, probe, cost, spent, finding, next_action,
               case when next_action = 'escalate' then next_probe end as new_probe, granted,
               case when role = 'user'
                    then 'Keputusan cadangan berbasis aturan: tanpa keluaran'
                    else 'Volume naik, lanjut' end as reason,
               sub_score, len, text,
               cast(12 - sum(spent) over w + sum(granted) over w
                    + case when len % 11 = 0 then 1 else 0 end as int) as credits_remaining
        from (
          select *, case when len % 4 = 0 then 0 else cost end as spent,
                 case when next_action = 'escalate' and len % 2 = 0 then 2 else 0 end as granted
          from (
            select conv_id * 1000 + part as doc_id, """ + code("conv_id % 25 + 1") + """ as symbol,
                   cast(date '1996-01-01' + (cast(conv_id as int) + part) * interval '1' day
                        as date) as as_of,
                   cast(turn % 8 as int) + 1 as step, role, text, len,
                   cast(last_turn % 8 as int) + 1 as n_steps,
                   case pidx when 0 then 'broker_concentration' when 1 then 'volume_anomaly'
                        when 2 then 'price_fundamental' when 3 then 'free_float'
                        when 4 then 'foreign_flow' else 'structural' end as probe,
                   case pidx when 5 then 'broker_concentration' when 0 then 'volume_anomaly'
                        when 1 then 'price_fundamental' when 2 then 'free_float'
                        when 3 then 'foreign_flow' else 'structural' end as next_probe,
                   case pidx when 0 then 3 when 1 then 1 when 2 then 6 when 3 then 1
                        when 4 then 2 else 3 end as cost,
                   case len % 3 when 0 then 'confirmed' when 1 then 'refuted'
                        else 'inconclusive' end as finding,
                   case when turn = last_turn and len % 7 > 0 then 'conclude'
                        when len % 5 = 0 then 'escalate' else 'continue' end as next_action,
                   case when len % 9 > 0 then cast(len % 101 as double) end as sub_score
            from (select conv_id, turn, role, text, cast(length(text) as int) as len,
                         cast(floor(turn / 8) as int) as part,
                         cast((turn + conv_id) % 6 as int) as pidx,
                         max(turn) over (partition by conv_id, floor(turn / 8)) as last_turn
                  from conversations) a) b) c
        window w as (partition by doc_id order by step)""",
    "transcript_heads": """
        select doc_id, symbol, as_of, n_steps, spent, score,
               case when doc_id % 7 = 0 then 'normal'
                    when score >= 80 then 'sangat_waspada' when score >= 60 then 'waspada'
                    when score >= 30 then 'perhatian' else 'normal' end as band,
               covered + case when doc_id % 8 = 0 then 0.05 else 0 end as confidence, covered,
               case when doc_id % 3 = 0 then 'Rencana cadangan berbasis aturan: murah dulu'
                    else 'Mulai dari volume' end as rationale,
               case when doc_id % 2 = 0 then 'llm' else 'template' end as narrative_source,
               case when doc_id % 5 = 0
                    then concat(symbol, '-', cast(as_of as string)) end as memory_ref,
               narrative
        from (select doc_id, max(symbol) as symbol, max(as_of) as as_of,
                     max(n_steps) as n_steps, sum(spent) as spent,
                     cast(sum(len) % 101 as int) as score,
                     cast(sum(len) % 100 as double) / 100 as covered,
                     max(case when step = 1 then text end) as narrative
              from transcript_steps group by doc_id) h""",
    "corpus": """
        select doc_id, text from documents
        union all
        select -1 - doc_id as doc_id, narrative as text from statements""",
    "whole_texts": """
        select 'statement' as source, doc_id, 0 as turn, narrative as text from statements
        union all
        select 'document', doc_id, 0, text from documents
        union all
        select 'conversation', conv_id, turn, text from conversations""",
}

# The one place where the two dialects differ: reading a number out of a JSON text.
_EVENT_FIELDS = {
    "spark": """select event_id, ts, user_id, event_type, value,
                get_json_object(props, '$.k') as json_k from events""",
    "duckdb": """select event_id, ts, user_id, event_type, value,
                 json_extract_string(props, '$.k') as json_k from events""",
}


# In Spark the code of a security is worked out once per part instead of once per line, and the
# three tables of one row per security and day or quarter come from one pass over the lines.
# Decimal sums are exact, so sums of the sums per day are those of the lines.
_SPARK = {
    "coded_part": f"select *, {code(_BRAND)} as p_symbol from part",
    "line_days": f"""
        select cast(l_shipdate as date) as trade_date, {code(_BRAND)} as symbol,
               sum({_MONEY}) as money, sum({_QTY}) as quantity,
               sum(case l_returnflag when 'N' then {_MONEY} when 'A' then -{_MONEY} end)
                   as net_flow,
               count(case when l_returnflag in ('N', 'A') then 1 end) as flow_lines,
               sum({_MONEY} * (cast(0.95 as decimal(3,2)) - cast(l_discount as decimal(3,2)))
                   - {_MONEY} * cast(0.90 as decimal(3,2))) as income
        from lineitem join part on l_partkey = p_partkey
        group by 1, 2""",
    "daily_transaction": """
        select trade_date, symbol, cast(money as double) / cast(quantity as double) as close_price,
               cast(quantity as bigint) as volume, cast(null as decimal(38,0)) as market_cap
        from line_days""",
    "foreign_flow": """
        select trade_date, symbol, cast(net_flow as double) as net_value
        from line_days where flow_lines > 0""",
    "quarterly_financials": """
        select symbol, last_day(cast(date_trunc('quarter', trade_date)
                                     + interval '2' month as date)) as report_date,
               cast(round(sum(money), 0) as decimal(38,0)) as revenue,
               cast(round(sum(income), 0) as decimal(38,0)) as net_income,
               cast(round(sum(quantity), 0) * 1000 as decimal(38,0)) as total_assets
        from line_days
        group by 1, 2""",
}
#: Read by several operators of one query; at most one row per security and day.
_HELD = {"line_days"}


def definitions(dialect: str) -> dict[str, str]:
    shared = {"event_fields": _EVENT_FIELDS[dialect], **VIEWS}
    if dialect != "spark":
        return shared
    return {name: text if name == "coded_part" else
            re.sub(r"\b(from|join) part\b", r"\1 coded_part", text.replace(code(_BRAND), "p_symbol"))
            for name, text in {**shared, **_SPARK}.items()}


class MarketTables(dict):
    """Name -> DataFrame, built on first use; base tables and market views alike."""

    def __init__(self, spark: SparkSession, directory: str):
        super().__init__()
        self.spark, self.directory = spark, directory
        self.calendar: DataFrame | None = None

    def with_halts(self) -> MarketTables:
        """These tables with the suspensions of unlisted securities too."""
        out = MarketTables(self.spark, self.directory)
        out.update(self, suspensions=self["halts"])
        out.calendar = self.calendar
        return out

    def __missing__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            frame = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        else:
            text = definitions("spark")[name]
            known = {*BASE_TABLES, *definitions("spark")} - {name}
            used = {n for n in known if re.search(rf"(from|join)\s+{n}\b", text)}
            text = re.sub(r"\b(from|join)\s+(\w+)\b",
                          lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text)
            frame = self.spark.sql(text, **{n: self[n] for n in sorted(used)})
            frame = cut_lineage(frame) if name in _HELD else frame
        self[name] = frame
        return frame
