import json

import pytest

from tapelens.sources import payloads


@pytest.mark.parametrize("endpoint", ["fetch-broker-summary-top", "fetch-foreign-flow"])
def test_rows_of_a_payload_are_read_once(spark, endpoint):
    text = spark.createDataFrame([(1, "{}")], "id int, payload string")
    plan = payloads.good_rows(payloads.parse(text, endpoint))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^[A-Z]{4}$") == 1
    assert "Filter" not in plan


def test_one_bad_row_drops_its_payload_and_no_other(spark):
    def payload(*brokers):
        return json.dumps({"symbol": "BRAB", "end": "1998-01-31", "top_sellers": [], "top_buyers": [
            {"code": code, "net_idr": value} for code, value in brokers]})

    text = spark.createDataFrame([
        (1, payload((" a1 ", 5.5), ("b2", None))), (2, payload(("c3", 1.0), ("d4", "no number"))),
        (3, payload((None, 1.0))), (4, '{"symbol": "BRAB", "error": "limit"}'), (5, payload()), (6, None)],
        "id int, payload string")
    parsed = payloads.parse(text, "fetch-broker-summary-top")
    assert sorted((r.id, r.broker_code, r.net_value) for r in payloads.good_rows(parsed).collect()) == [
        (1, "A1", 5.5), (1, "B2", None)]
    assert {r.id: r.failure for r in parsed.collect()} == {
        1: None, 2: "invalid row", 3: "invalid row", 4: "API error: limit",
        5: "no readable rows", 6: "no readable rows"}
