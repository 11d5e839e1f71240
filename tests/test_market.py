import re
from datetime import date

import market
from tapelens import constants as K
from tapelens.operators import calibration, pit, probes
from tapelens.plans import registry
from tapelens.plans.market import MarketTables


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_every_listed_security_has_all_its_suspensions(spark, tmp_path):
    write(spark, tmp_path, "part", [(n, f"Brand#{n}", 900.0 + n) for n in (1, 7, 25)],
          "p_partkey long, p_brand string, p_retailprice double")
    lines = [  # a line on the first of the month that is no suspension leads by its discount
        (1000 + i, brand, i, flag, quantity, discount, f"1998-0{month}-{day:02d}")
        for brand in (1, 7, 25) for month in (1, 2)
        for i, (day, flag, quantity, discount) in enumerate([
            (1, "N", 10.0, 0.10), (2, "R", 48.0, 0.01), (9, "R", 50.0, 0.02),
            (9, "R", 49.0, 0.02), (20, "R", 47.0, 0.02), (21, "A", 50.0, 0.02)])]
    write(spark, tmp_path, "lineitem",
          [(key, part, n, flag, quantity, discount, 0.06, "F", day)
           for key, part, n, flag, quantity, discount, day in lines],
          "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_quantity double,"
          " l_discount double, l_tax double, l_linestatus string, l_shipdate string")
    got = sorted((r.symbol, str(r.start_date))
                 for r in MarketTables(spark, str(tmp_path))["suspensions"].collect())
    days = ["1998-01-02", "1998-01-09", "1998-02-02", "1998-02-09"]
    assert got == [(symbol, day) for symbol in ("BRAB", "BRCF") for day in days]


def halted_market(spark, folder):
    """Listed securities 1 and 2 and the unlisted 7, each halted on the 20th and 21st of four months."""
    write(spark, folder, "part", [(n, f"Brand#{n}", 900.0 + n) for n in (1, 2, 7)],
          "p_partkey long, p_brand string, p_retailprice double")
    first = date(1998, 1, 1).toordinal()
    days = [date.fromordinal(first + n) for n in range(120)]
    write(spark, folder, "lineitem", [
        (day.toordinal(), part, n, supplier, flag, quantity, 100.0, discount, 0.06, "F", str(day))
        for part in (1, 2, 7) for day in days for n, supplier, flag, quantity, discount in
        # the line with the highest discount of a month is no halt
        [(1, 1, "N", 10.0, 0.10), (2, 2, "N", 5.0, 0.0), (3, 3, "R", 48.0, 0.01)][:3 if day.day in (20, 21) else 2]],
        "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_returnflag string,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_linestatus string, l_shipdate string")
    write(spark, folder, "customer", [(1, 0)], "c_custkey long, c_nationkey int")
    write(spark, folder, "orders", [(1, str(days[0]), 1000.0)],
          "o_custkey long, o_orderdate string, o_totalprice double")
    return days


def test_sessions_before_halts_of_unlisted_securities_too(spark, tmp_path):
    days = halted_market(spark, tmp_path)
    got = sorted(map(tuple, registry.queries()["c2_nth_session_before"](spark, str(tmp_path)).collect()))
    assert got == sorted(
        (symbol, day, lag, date.fromordinal(day.toordinal() - lag))
        for symbol in ("BRAB", "BRAC", "BRAH") for day in days if day.day in (20, 21) for lag in (1, 3, 5, 10))


def test_arm_summary_counts_halts_of_unlisted_securities_too(spark, tmp_path):
    days = ["1998-01-05", "1998-02-05", "1998-03-05"]
    write(spark, tmp_path, "part", [(n, f"Brand#{n}", 900.0 + n, "MEDIUM", "") for n in (1, 7)],
          "p_partkey long, p_brand string, p_retailprice double, p_type string, p_name string")
    write(spark, tmp_path, "lineitem",
          [(i, part, 1, 1, "R", 48.0, 100.0, 0.01, 0.06, "O", day)
           for part in (1, 7) for i, day in enumerate(days)],
          "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_returnflag string,"
          " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
          " l_linestatus string, l_shipdate string")
    write(spark, tmp_path, "supplier", [(n,) for n in range(20)], "s_suppkey long")
    write(spark, tmp_path, "customer", [(1, 0)], "c_custkey long, c_nationkey int")
    write(spark, tmp_path, "orders", [(1, days[0], 1000.0)],
          "o_custkey long, o_orderdate string, o_totalprice double")
    write(spark, tmp_path, "conversations", [(2, "x")], "conv_id long, text string")
    rows = registry.queries()["d18_arm_summary"](spark, str(tmp_path)).collect()
    # the halt alone is 55 in January; from February on the float's 100 and the halt make 86
    assert {r.arm: (r.cases, r.agreed) for r in rows if r.arm in ("exhaustive", "cheapest_two")} == {
        "exhaustive": (6, 6), "cheapest_two": (6, 4)}


def test_every_listed_event_has_its_controls_and_lags(spark, tmp_path):
    days, jobs = halted_market(spark, tmp_path), registry.queries()
    events = [(symbol, day) for symbol in ("BRAB", "BRAC") for day in days if day.day == 20]
    controls = jobs["c6_matched_controls_with_reuse"](spark, str(tmp_path)).collect()
    # BRAC shares its sub-sector with BRAH, BRAB takes it from the whole pool
    assert sorted((r.positive, r.event_date, r.symbol, r.match_rank) for r in controls) == [
        (*event, "BRAH", 1) for event in events]
    lagged = jobs["c3_event_lag_grid"](spark, str(tmp_path)).collect()
    wanted = sorted((symbol if label else "BRAH", day, label, lag, date.fromordinal(day.toordinal() - lag))
                    for symbol, day in events for label in (0, 1) for lag in (1, 3, 5, 10))
    assert sorted(map(tuple, lagged)) == wanted


class Counted(dict):
    """Tables that count how often each is asked for."""

    def __init__(self, tables):
        super().__init__(tables)
        self.asked = []

    def __getitem__(self, name):
        self.asked.append(name)
        return super().__getitem__(name)


def test_tables_are_read_once_by_the_broker_and_the_event_probe(spark, tmp_path):
    tables = Counted(market.tables(spark))
    tables["broker_summary"].write.parquet(f"{tmp_path}/broker_summary")
    dict.__setitem__(tables, "broker_summary", spark.read.parquet(f"{tmp_path}/broker_summary"))
    grid = tables["company_profile"].select("symbol").crossJoin(
        spark.createDataFrame([(market.AS_OF,)], "as_of date"))
    plan = probes.broker_net(tables, grid)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[.*broker_code", plan)) == 1
    tables.asked.clear()
    probes.structural(tables, grid)
    assert sorted(tables.asked) == ["corporate_actions", "filings", "suspensions"]


def test_days_without_a_session_belong_to_the_one_before(spark):
    calendar = spark.createDataFrame(
        [(date(2026, 1, 2), 1), (date(2026, 1, 5), 2)], "trade_date date, session_idx int")
    last = spark.createDataFrame([(date(2026, 1, 7),)], "d date").agg({"d": "max"}).scalar()
    got = sorted((r.trade_date.day, r.session_idx) for r in pit.session_days(calendar, last).collect())
    assert got == [(2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2)]


def test_one_pass_over_the_lines_serves_the_tables_of_days(spark, tmp_path):
    write(spark, tmp_path, "part", [(1, "Brand#1", 901.0)],
          "p_partkey long, p_brand string, p_retailprice double")
    write(spark, tmp_path, "lineitem",
          [(1, "N", 2.0, 10.25, 0.01, "1998-01-05"), (1, "A", 3.0, 4.5, 0.09, "1998-01-05"),
           (1, "R", 4.0, 7.75, 0.05, "1998-02-06")],
          "l_partkey long, l_returnflag string, l_quantity double, l_extendedprice double,"
          " l_discount double, l_shipdate string")
    tables = MarketTables(spark, str(tmp_path))
    assert sorted((str(r.trade_date), r.close_price, r.volume)
                  for r in tables["daily_transaction"].collect()) == [
        ("1998-01-05", 2.95, 5), ("1998-02-06", 1.9375, 4)]
    assert [(str(r.trade_date), r.net_value) for r in tables["foreign_flow"].collect()] == [("1998-01-05", 5.75)]
    quarter, = tables["quarterly_financials"].collect()
    assert (str(quarter.report_date), int(quarter.revenue), int(quarter.total_assets)) == ("1998-03-31", 23, 9000)
    for name in ("daily_transaction", "foreign_flow", "quarterly_financials"):
        assert "lineitem" not in tables[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "l_shipdate" not in tables[name]._jdf.queryExecution().optimizedPlan().toString()


def test_evaluation_reads_the_matrix_once(spark, tmp_path):
    day, scores = date(1998, 1, 20), ", ".join(f"{c} double" for c in K.COMPONENTS)
    write(spark, tmp_path, "matrix", [
        (symbol, day, lag, day, label, *[score] * 6)
        for symbol, label, score in (("AAAA", 1, 90.0), ("BBBB", 0, 10.0)) for lag in (1, 3)],
        f"symbol string, event_date date, lag int, as_of date, label int, {scores}")
    found = calibration.evaluate(spark.read.parquet(f"{tmp_path}/matrix.parquet"))
    assert "parquet" not in found._jdf.queryExecution().optimizedPlan().toString()
    row, = found.collect()
    assert (row.n, row.k, row.precision_at_k, row.recall, row.median_lead) == (2, 2, 0.5, 1.0, 3.0)
