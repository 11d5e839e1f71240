"""Rows on days without a session count by their date."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tapelens.operators import probes
from tapelens.schemas import TABLES

START = date(2026, 1, 5)
DAYS = [START + timedelta(days=i) for i in range(60) if (START + timedelta(days=i)).weekday() < 5]
SATURDAY = date(2026, 2, 14)


class Tables(dict):
    calendar = None


def tables(spark):
    frame = lambda name, rows: spark.createDataFrame(rows, TABLES[name].ddl)
    return Tables(
        daily_transaction=frame("daily_transaction", [(d, "AAAA", 10.0, 100, None) for d in DAYS]),
        daily_close=frame("daily_close", []),
        broker_summary=frame("broker_summary", [(d, "AAAA", "B1", 5.0, 5.0, 0.0) for d in (*DAYS, SATURDAY)]),
        foreign_flow=frame("foreign_flow", [(d, "AAAA", 5.0) for d in (*DAYS, SATURDAY)]))


def test_windows_hold_days_without_a_session(spark):
    t = tables(spark)
    friday, monday = date(2026, 2, 13), date(2026, 2, 16)
    grid = spark.createDataFrame([("AAAA", d) for d in (friday, SATURDAY, monday)], "symbol string, as_of date")
    net = {r.as_of: r.net_value for r in probes.broker_net(t, grid).collect()}
    assert net == {friday: 100.0, SATURDAY: 105.0, monday: 105.0}
    flow = {r.as_of: r.foreign_net for r in probes.foreign_flow(t, grid).select(
        "as_of", "foreign_net").where(F.col("foreign_net").isNotNull()).collect()}
    assert flow == {friday: 150.0, SATURDAY: 155.0, monday: 155.0}
