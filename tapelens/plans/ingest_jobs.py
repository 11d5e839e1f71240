"""Registered jobs: warehouse reads and writes, JSON payloads, logs and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelens.functions import scalar as S
from tapelens.operators import pit
from tapelens.plans.probe_jobs import month_watchlist
from tapelens.plans.registry import query
from tapelens.schemas import TABLES
from tapelens.session import scratch_dir
from tapelens.sources import documents, payloads, tables


def stored(t, *names: str) -> tables.Warehouse:
    warehouse = tables.Warehouse(t.spark, scratch_dir(t.spark))
    for name in names:
        warehouse.upsert(name, t[name], count=False)
    return warehouse


# -- warehouse ---------------------------------------------------------------------------------
@query("a1_parquet_scan", "select trade_date, symbol, net_value from foreign_flow")
def scan(t):
    return stored(t, "foreign_flow")["foreign_flow"]


@query("a2_missing_table_as_empty", """
    select 'suspensions' as table_name, count(*) as n from suspensions
    union all select 'filings', 0""")
def missing(t):
    warehouse = stored(t, "suspensions")
    counts = [warehouse[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
              for n in ("suspensions", "filings")]
    return counts[0].unionByName(counts[1])


@query("a3_table_read_filtered", """
    select symbol, start_date, end_date, reason from suspensions
    where start_date <= date '1999-12-31' and symbol = 'BRAB'""")
def filtered(t):
    return stored(t, "suspensions").read("suspensions", "1999-12-31", "symbol = 'BRAB'")


@query("a4_keyed_upsert", """
    select symbol, start_date, end_date,
           case when start_date >= date '1998-01-01' then 'revised' else reason end as reason
    from suspensions""")
def upsert(t):
    warehouse = stored(t, "suspensions")
    batch = t["suspensions"].where("start_date >= '1998-01-01'").withColumn(
        "reason", F.lit("revised"))
    warehouse.upsert("suspensions", batch, count=False)
    return warehouse["suspensions"]


@query("a5_append_distinct", "select filing_date, symbol, holder_name, shares from filings")
def append_distinct(t):
    warehouse = stored(t, "filings")
    warehouse.upsert("filings", t["filings"], count=False)
    return warehouse["filings"].select("filing_date", "symbol", "holder_name", "shares")


@query("a6_sorted_write", """
    select symbol, count(*) as n, min(trade_date) as first, max(trade_date) as last,
           cast(0 as bigint) as out_of_order, true as ranges_apart
    from daily_close group by 1""")
def sorted_write(t):
    """Read back with the place of every row: rows of a file ascend, files of a folder do not overlap."""
    spec, path = TABLES["daily_close"], scratch_dir(t.spark)
    rows = t["daily_close"].withColumn(tables.PART, tables.partition_value(spec))
    tables.write_sorted(rows, spec, path)
    key = F.struct(*spec.key)
    placed = t.spark.read.schema(f"{spec.ddl}, part string").parquet(path).select(
        "part", "symbol", "trade_date", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"), key.alias("key"))
    in_file = Window.partitionBy("file").orderBy("row")
    rows = placed.withColumn("late", F.coalesce(F.lag("key").over(in_file) > F.col("key"), F.lit(False)))
    files = placed.groupBy("part", "file").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    ahead = F.lag("high").over(Window.partitionBy("part").orderBy("low", "file"))
    apart = files.withColumn("apart", F.coalesce(ahead < F.col("low"), F.lit(True))).select("file", "apart")
    return rows.join(apart, "file").groupBy("symbol").agg(
        F.count("*").alias("n"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"),
        F.count_if("late").alias("out_of_order"), F.bool_and("apart").alias("ranges_apart"))


@query("a7_conform_to_schema", """
    select trade_date, symbol, close_price, cast(null as bigint) as volume,
           cast(null as double) as market_cap from daily_close""")
def conform(t):
    rows = t["daily_close"].withColumn("extra", F.lit(1))
    return tables.conform(rows, TABLES["daily_transaction"]).withColumn(
        "market_cap", F.col("market_cap").cast("double"))


@query("a23_stamp_missing_date", """
    select symbol, coalesce(listing_date, date '2002-01-31') as listing_date
    from company_profile""")
def stamp(t):
    return tables.stamp_missing_date(
        t["company_profile"].select("symbol", "listing_date"), "2002-01-31", "listing_date")


@query("a26_warehouse_summary", """
    select 'foreign_flow' as table_name, count(*) as rows, min(trade_date) as first,
           max(trade_date) as last from foreign_flow
    union all select 'suspensions', count(*), min(start_date), max(start_date) from suspensions
    union all select unnest(['daily_close', 'daily_transaction', 'broker_summary', 'free_float',
      'filings', 'corporate_actions', 'quarterly_financials', 'company_profile', 'investigations']), 0, null, null""")
def summary(t):
    return stored(t, "foreign_flow", "suspensions").summary()


@query("b7_valid_symbol_list", "select distinct symbol from free_float")
def symbols(t):
    return tables.known_symbols(t)


# -- payloads -----------------------------------------------------------------------------------
def by_month(df: DataFrame, day: str, *more: str) -> tuple[DataFrame, list]:
    """Rows of a symbol and month: the unit one payload carries, at most 31 sessions."""
    return df.withColumn("month", F.date_format(day, "yyyy-MM")), ["symbol", "month", *more]


def flow_payloads(t) -> DataFrame:
    rows, keys = by_month(t["foreign_flow"], "trade_date")
    return rows.groupBy(*keys).agg(F.to_json(F.struct(
        F.first("symbol").alias("symbol"), F.collect_list(F.struct(
            F.col("trade_date").cast("string").alias("date"),
            F.col("net_value").alias("net_foreign_inflow"))).alias("data"))).alias("payload")
    ).select(F.concat_ws("/", *keys).alias("payload_id"), "payload")


@query("a8_flatten_envelope", "select symbol, trade_date, net_value from foreign_flow")
def envelope(t):
    rows = payloads.good_rows(payloads.parse(flow_payloads(t), "fetch-foreign-flow"))
    return rows.select("symbol", "trade_date", "net_value")


def traded_payloads(t) -> DataFrame:
    rows, keys = by_month(t["daily_transaction"], "trade_date")
    day = F.struct(F.col("trade_date").cast("string").alias("key"), F.array(F.struct(
        "symbol", F.col("close_price").alias("price"), "volume")).alias("value"))
    return rows.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.collect_list(day)))
                                   .alias("payload"))


@query("a9_flatten_keyed_by_date", """
    select symbol, trade_date, close_price as price, volume from daily_transaction""")
def keyed(t):
    rows = payloads.good_rows(payloads.parse(
        traded_payloads(t).select("payload"), "fetch-most-traded-stocks"))
    return rows.select("symbol", "trade_date", "price", "volume")


def change_payloads(t) -> DataFrame:
    rows, keys = by_month(t["daily_transaction"], "trade_date")
    entry = F.struct("symbol", (F.col("volume") / 100).alias("price_change"),
                     F.col("close_price").alias("last_close_price"))

    def side(even):
        keep = (F.col("volume") % 2 == 0) == F.lit(even)
        return F.struct(F.collect_list(F.when(keep, entry)).alias("1d"))

    return rows.groupBy(*keys).agg(F.to_json(F.struct(
        side(True).alias("top_gainers"), side(False).alias("top_losers"))).alias("payload"))


@query("a10_flatten_top_changes", """
    select symbol, case when volume % 2 = 0 then 'top_gainers' else 'top_losers' end as direction,
           round(volume / 100, 6) as price_change, close_price as last_close
    from daily_transaction""")
def changes(t):
    rows = payloads.good_rows(payloads.parse(
        change_payloads(t).select("payload"), "fetch-companies-top-changes"))
    return rows.select("symbol", "direction", F.round("price_change", 6).alias("price_change"),
                       "last_close")


@query("a11_flatten_profile", """
    select symbol, company_name, sub_sector, cast(market_cap as bigint) as market_cap,
           listing_date from company_profile""")
def profile(t):
    p = t["company_profile"]
    coarse = F.col("sub_sector") == "Sector 1"
    report = F.to_json(F.struct("symbol", "company_name", F.struct(
        F.when(~coarse, F.col("sub_sector")).alias("sub_sector"),
        F.when(coarse, F.col("sub_sector")).alias("sub_industry"), "market_cap",
        F.col("listing_date").cast("string").alias("listing_date")).alias("overview")))
    return payloads.good_rows(payloads.parse(
        p.select(report.alias("payload")), "fetch-company-report"))


@query("a12_flatten_broker_top", """
    select symbol, last_day(trade_date) as trade_date, broker_code, net_value
    from broker_summary""")
def brokers(t):
    rows, keys = by_month(t["broker_summary"], "trade_date")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("broker_code", "trade_date"), F.lit(32)))
    entry = F.struct(F.concat(F.lit(" "), F.col("broker_code")).alias("code"),
                     F.col("net_value").alias("net_idr"))
    body = rows.groupBy(*keys, "slice").agg(
        F.max(F.last_day("trade_date")).cast("string").alias("end"),
        F.collect_list(F.when(F.col("net_value") > 0, entry)).alias("top_buyers"),
        F.collect_list(F.when(F.col("net_value") <= 0, entry)).alias("top_sellers"))
    packed = body.select(F.to_json(F.struct("symbol", "end", "top_buyers", "top_sellers"))
                         .alias("payload"))
    return payloads.good_rows(payloads.parse(packed, "fetch-broker-summary-top")).select(
        "symbol", "trade_date", "broker_code", "net_value")


@query("a13_flatten_actions", """
    select symbol, action_date, action_type from corporate_actions
    where action_type <> 'warrant'""")
def actions(t):
    rows, keys = by_month(t["corporate_actions"], "action_date")
    day = F.col("action_date").cast("string")
    kind = F.col("action_type")
    item = F.struct("detail", F.when(kind == "agm", day).alias("agm_date"),
                    F.when(kind == "stock_split", day).alias("date"),
                    F.when(~kind.isin("agm", "stock_split", "warrant"), day).alias("ex_date"))
    each = rows.groupBy(*keys, "action_type").agg(F.collect_list(item).alias("items"))
    packed = each.groupBy(*keys).agg(F.to_json(F.struct(
        F.first("symbol").alias("symbol"), F.map_from_entries(F.collect_list(
            F.struct("action_type", "items"))).alias("corporate_actions"))).alias("payload"))
    return payloads.good_rows(payloads.parse(
        packed.select("payload"), "fetch-corporate-actions")).select(
        "symbol", "action_date", "action_type")


@query("a14_field_aliases", """
    select symbol, trade_date, close_price from daily_close""")
def aliases(t):
    odd = F.dayofmonth("trade_date") % 2 == 1
    day, price = F.col("trade_date").cast("string"), F.col("close_price")
    row = F.to_json(F.struct(
        F.when(odd, F.col("symbol")).alias("ticker"), F.when(~odd, F.col("symbol")).alias("kode"),
        F.when(odd, day).alias("date"), F.when(~odd, day).alias("tanggal"),
        F.when(odd, price).alias("close"), F.when(~odd, price).alias("price")))
    return payloads.good_rows(payloads.parse(
        t["daily_close"].select(row.alias("payload")), "fetch-close"))


@query("a15_normalise_row", """
    select symbol, free_float_pct, as_of from free_float""")
def normalise(t):
    row = F.to_json(F.struct(
        F.concat(F.lit(" "), F.lower("symbol"), F.lit(".jk ")).alias("symbol"),
        F.when(F.col("free_float_pct") >= 0.02, F.round(F.col("free_float_pct") * 100, 6))
        .otherwise(F.col("free_float_pct")).alias("free_float"),
        F.concat(F.col("as_of").cast("string"), F.lit("T19:36:14")).alias("as_of")))
    rows = payloads.good_rows(payloads.parse(
        t["free_float"].select(row.alias("payload")), "fetch-free-float"))
    return rows.withColumn("free_float_pct", F.round("free_float_pct", 9))


def mixed_payloads(t) -> DataFrame:
    """Foreign-flow payloads of which June's carry a bad code and December's an API error."""
    p = flow_payloads(t)
    month = F.right("payload_id", F.lit(2))
    broken = F.regexp_replace("payload", '"symbol":"(\\w\\w)\\w\\w"', '"symbol":"$1-7"')
    return p.withColumn("payload", F.when(month == "06", broken).when(
        month == "12", '{"error":"quota"}').when(month == "11", '{"results":[]}')
        .otherwise(F.col("payload")))


PAYLOAD_IDS = """select distinct concat(symbol, '/', strftime(trade_date, '%Y-%m')) as payload_id
                 from foreign_flow"""


@query("a16_validate_rows", f"""
    select payload_id, right(payload_id, 2) not in ('06', '12') as valid,
           case right(payload_id, 2) when '06' then 'invalid row'
                when '12' then 'API error: quota' end as failure
    from ({PAYLOAD_IDS}) p""")
def validate(t):
    return payloads.parse(mixed_payloads(t), "fetch-foreign-flow").select(
        "payload_id", "valid", "failure")


@query("a17_quarantine_split", f"""
    select 'good' as part, count(*) as n from foreign_flow
    where month(trade_date) not in (6, 11, 12)
    union all select 'quarantine', count(*) from ({PAYLOAD_IDS}) p
    where right(payload_id, 2) in ('06', '12')""")
def split(t):
    root = scratch_dir(t.spark)
    payloads.split_and_store(payloads.parse(mixed_payloads(t), "fetch-foreign-flow"),
                             f"{root}/good", f"{root}/quarantine")
    counts = [t.spark.read.parquet(f"{root}/{n}").agg(F.count("*").alias("n")).select(
        F.lit(n).alias("part"), "n") for n in ("good", "quarantine")]
    return counts[0].unionByName(counts[1])


@query("a18_quarantine_replay", f"""
    select payload_id, right(payload_id, 2) = '06' as recovered from ({PAYLOAD_IDS}) p
    where right(payload_id, 2) in ('06', '12')""")
def replay(t):
    bad = payloads.quarantined(payloads.parse(mixed_payloads(t), "fetch-foreign-flow"))
    again = payloads.replay(bad, "fetch-foreign-flow", "^[A-Z]{2}-[0-9]$")
    return again.select("payload_id", F.col("valid").alias("recovered"))


@query("a24_sweep_mapping", """
    select trade_date, symbol, close_price, volume from daily_transaction
    union all select last_day(trade_date), symbol, close_price, null from daily_transaction
    where volume % 2 = 0""")
def sweep(t):
    most = payloads.good_rows(payloads.parse(
        traded_payloads(t).select("payload"), "fetch-most-traded-stocks"))
    first = tables.sweep_to_table("fetch-most-traded-stocks", most, F.lit(None).cast("date"))
    moved = t["daily_transaction"].select(
        "symbol", F.when(F.col("volume") % 2 == 0, F.col("close_price")).alias("last_close"),
        F.last_day("trade_date").alias("pulled"))
    second = tables.sweep_to_table("fetch-companies-top-changes", moved, F.col("pulled"))
    return first.drop("market_cap").unionByName(second, allowMissingColumns=True)


@query("t15_payload_shape", f"""
    select p.payload_id, 'dict' as kind, n as n_rows, 'date,net_foreign_inflow,symbol' as keys
    from ({PAYLOAD_IDS}) p
    join (select concat(symbol, '/', strftime(trade_date, '%Y-%m')) as payload_id, count(*) as n
          from foreign_flow group by 1) c on c.payload_id = p.payload_id""")
def shapes(t):
    return payloads.payload_shape(flow_payloads(t)).withColumn(
        "keys", F.array_join("keys", ","))


# -- logs and documents ----------------------------------------------------------------------------
def ledger_lines(t) -> DataFrame:
    """Ledger lines as text, each followed by a broken and a blank line for view events."""
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "phase", "endpoint",
        F.when(F.col("transport") == "rest", F.col("transport")).alias("transport"), "credits",
        F.lit("h").alias("params_hash"), "symbol"))
    noise = F.when(F.col("phase") == "backfill", F.concat(line, F.lit('\n{"ts": "cut off\n')))
    return t["credit_ledger"].select(F.coalesce(noise, line).alias("value"))


LEDGER_SQL = """
    select phase, endpoint, case when transport = 'rest' then 'rest' else '?' end as transport,
           count(*) as calls, {credits} as credits
    from credit_ledger group by 1, 2, 3"""


def ledger_totals(ledger):
    return ledger.groupBy("phase", "endpoint", "transport").agg(
        F.count("*").alias("calls"), F.sum("credits").alias("credits"))


@query("a19_ledger_scan", LEDGER_SQL.format(credits="sum(credits)"))
def ledger_scan(t):
    path = scratch_dir(t.spark)
    ledger_lines(t).write.text(path)
    return ledger_totals(documents.read_ledger(t.spark, path))


@query("a20_ledger_append", LEDGER_SQL.format(credits="2 * sum(credits)").replace(
    "count(*) as calls", "2 * count(*) as calls"))
def ledger_append(t):
    path = scratch_dir(t.spark)
    entries = t["credit_ledger"].select(
        F.col("ts").cast("string").alias("ts"), "phase", "endpoint",
        F.when(F.col("transport") == "rest", F.col("transport")).alias("transport"), "credits",
        F.lit("h").alias("params_hash"), "symbol")
    for _ in range(2):
        documents.append_ledger(entries, path)
    return ledger_totals(documents.read_ledger(t.spark, path))


def watchlist_documents(t) -> DataFrame:
    """One document per month end: at most 15 candidates each."""
    rows = month_watchlist(t).select(
        "as_of", F.struct("symbol", "score", F.struct(
            "return_5d", "return_20d", "volume_z", "small_cap",
            F.col("event").cast("double").alias("event")).alias("signals"), "reason")
        .alias("candidate"))
    return rows.groupBy("as_of").agg(F.collect_list("candidate").alias("candidates")).select(
        F.date_format("as_of", "yyyy-MM-dd").alias("folder"),
        F.when(F.dayofmonth("as_of") == 31, F.col("as_of").cast("string")).alias("as_of"),
        F.lit(5).alias("credits_spent"), "candidates")


@query("a22_watchlist_scan", """
    select cast(as_of as varchar) as as_of, cast(count(*) as int) as n_candidates,
           5 as credits_spent, 2 as log_lines
    from m_watchlist group by 1""")
def watchlist_scan(t):
    root = scratch_dir(t.spark)
    docs = watchlist_documents(t)
    docs.select("folder", F.to_json(F.struct("as_of", "credits_spent", "candidates"))
                .alias("value")).write.partitionBy("folder").text(f"{root}/lists")
    docs.select("folder", F.lit("[17:28:52Z] sweep\n[17:28:55Z] done").alias("value")
                ).write.partitionBy("folder").text(f"{root}/logs")
    lists = documents.read_watchlists(
        t.spark, root, "lists/folder=*/*.txt", "logs/folder=*/*.txt")
    return lists.select("as_of", "n_candidates", "credits_spent",
                        F.size("run_log").alias("log_lines"))


@query("a25_json_export", """
    select symbol, as_of, score, band from investigations""")
def export(t):
    path = scratch_dir(t.spark)
    rows = t["investigations"].select("symbol", F.col("as_of"), "score", "band")
    documents.export_json(rows.withColumn("year", F.year("as_of")), path, by="year")
    back = t.spark.read.schema("symbol string, as_of date, score int, band string").json(path)
    return back.select("symbol", "as_of", "score", "band")


@query("h8_source_stamp", """
    select trade_date, epoch(cast(trade_date as timestamp)) + 9 * 3600 as close_epoch
    from calendar""")
def close_stamp(t):
    return pit.trading_calendar(t).select("trade_date", F.unix_timestamp(
        S.market_close_stamp(F.col("trade_date"))).alias("close_epoch"))
