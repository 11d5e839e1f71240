import random
from datetime import date, timedelta

import pytest

from tapelens.operators import probes
from tapelens.schemas import TABLES

ALL_DAYS = [date(2026, 1, 5) + timedelta(days=i) for i in range(75)]
SESSIONS = [d for d in ALL_DAYS if d.weekday() < 5]


class Tables(dict):
    calendar = None


def market(spark, rows):
    frame = lambda name, data: spark.createDataFrame(data, TABLES[name].ddl)
    return Tables(
        daily_transaction=frame("daily_transaction", [(d, "AAAA", 10.0, 100, None) for d in SESSIONS]),
        daily_close=frame("daily_close", []),
        broker_summary=frame("broker_summary", [(d, "AAAA", b, v, None, None) for d, b, v in rows]))


@pytest.mark.parametrize("overlapping", [False, True])
def test_net_of_every_window_is_the_sum_of_its_rows(spark, overlapping):
    draw = random.Random(5)
    rows = [(d, broker, draw.choice([None, -3.0, 2.0, 7.0])) for broker, share in (("B1", 1.0), ("B2", 0.3), ("B3", 0.03))
            for d in ALL_DAYS if draw.random() < share]
    rows += [(SESSIONS[7], "B4", None), (SESSIONS[9], "B5", 4.0)]
    grid = spark.createDataFrame([("AAAA", d) for d in ALL_DAYS], "symbol string, as_of date")
    got = {(r.as_of, r.broker_code): (r.net_value, r.last_day)
           for r in probes.broker_net(market(spark, rows), grid, overlapping).collect()}
    want = {}
    for as_of in ALL_DAYS:
        past = [d for d in SESSIONS if d <= as_of]
        if len(past) < 20:
            start = date.min
        else:
            start = past[-20]
        for broker in {b for _, b, _ in rows}:
            held = [(d, v) for d, b, v in rows if b == broker and start <= d <= as_of]
            if held:
                known = [v for _, v in held if v is not None]
                want[as_of, broker] = (sum(known) if known else None, max(d for d, _ in held))
    assert got == want


def test_overlapping_windows_are_not_grouped_again_by_broker(spark):
    grid = spark.createDataFrame([("AAAA", d) for d in SESSIONS], "symbol string, as_of date")
    net = probes.broker_net(market(spark, [(SESSIONS[0], "B1", 1.0)]), grid, overlapping=True)
    plan = net._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "broker_code" in line]
