from datetime import date

from pyspark.sql import functions as F

import market
from tapelens.schemas import TABLES
from tapelens.sources import documents, payloads
from tapelens.sources.tables import Warehouse


def test_upsert_is_idempotent_and_new_wins(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    ddl = TABLES["foreign_flow"].ddl
    first = spark.createDataFrame([(date(2026, 1, 5), "AAAA", 1.0),
                                   (date(2026, 2, 5), "AAAA", 2.0)], ddl)
    assert w.upsert("foreign_flow", first) == 2
    assert w.upsert("foreign_flow", first) == 2
    assert w.upsert("foreign_flow", spark.createDataFrame(
        [(date(2026, 2, 5), "AAAA", 9.0), (date(2026, 2, 6), "AAAA", 3.0)], ddl)) == 3
    values = {r["trade_date"].isoformat(): r["net_value"] for r in w["foreign_flow"].collect()}
    assert values == {"2026-01-05": 1.0, "2026-02-05": 9.0, "2026-02-06": 3.0}


def test_null_keys_match_and_history_is_kept(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    ddl = TABLES["free_float"].ddl
    w.upsert("free_float", spark.createDataFrame(
        [("AAAA", 0.5, None), ("AAAA", 0.4, date(2026, 1, 1))], ddl))
    assert w.upsert("free_float", spark.createDataFrame([("AAAA", 0.6, None)], ddl)) == 2
    assert {r[0] for r in w["free_float"].select("free_float_pct").collect()} == {0.6, 0.4}


def test_identity_table_and_keyless_table(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    tables = market.tables(spark)
    assert w.upsert("company_profile", tables["company_profile"]) == 5
    assert w.upsert("company_profile", tables["company_profile"].withColumn(
        "listing_date", F.lit(date(2020, 1, 1)))) == 5
    assert w.upsert("filings", tables["filings"]) == 3
    assert w.upsert("filings", tables["filings"]) == 3


def test_missing_table_is_empty(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    assert w["suspensions"].columns == TABLES["suspensions"].columns
    assert w["suspensions"].count() == 0
    assert {r["rows"] for r in w.summary().collect()} == {0}


def parse_one(spark, payload, endpoint):
    df = spark.createDataFrame([(1, payload)], "id int, payload string")
    return payloads.parse(df, endpoint).first()


def test_shapes(spark):
    r = parse_one(spark, '{"symbol":"abcd.jk","data":[{"date":"2026-01-05",'
                         '"net_foreign_inflow":7}]}', "fetch-foreign-flow")
    assert r["valid"] and r["records"][0].asDict() == {
        "symbol": "ABCD", "trade_date": date(2026, 1, 5), "net_value": 7.0}
    r = parse_one(spark, '{"2026-01-05":[{"symbol":"ABCD","price":5,"volume":10}]}',
                  "fetch-most-traded-stocks")
    assert r["records"][0]["trade_date"] == date(2026, 1, 5)
    r = parse_one(spark, '{"symbol":"ABCD","corporate_actions":{"agm":[{"agm_date":"2026-01-05"},'
                         '{"note":"no date"}],"stock_split":[{"date":"2026-02-05"}]}}',
                  "fetch-corporate-actions")
    assert {(x["action_type"], str(x["action_date"])) for x in r["records"]} == {
        ("agm", "2026-01-05"), ("stock_split", "2026-02-05")}


def test_validation(spark):
    bad = parse_one(spark, '[{"symbol":"ABCD","date":"2026-01-05"},{"symbol":"AB","date":"x"}]',
                    "fetch-close")
    assert not bad["valid"] and bad["failure"] == "invalid row"
    assert parse_one(spark, '{"results":[],"pagination":{"total_count":0}}',
                     "fetch-suspensions")["valid"]
    assert not parse_one(spark, '{"error":"no credit"}', "fetch-suspensions")["valid"]
    assert not parse_one(spark, "not json", "fetch-suspensions")["valid"]


def test_ledger_skips_broken_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text(
        '{"ts":"2026-01-05T00:00:00","phase":"dev","credits":2}\n\n{"ts": broken\n')
    rows = documents.read_ledger(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["endpoint"] == "?" and rows[0]["credits"] == 2


def test_transcript_files_keep_the_unreadable(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"symbol": "ABCD",\n "as_of": "2026-09-05"}')
    (tmp_path / "b.json").write_text('{"symbol": ')
    rows = {r["path"][-6:]: r["problem"] for r in documents.read_transcripts(
        spark, f"{tmp_path}/*.json").collect()}
    assert rows["a.json"] is None and rows["b.json"]


def test_scans_are_pruned_by_month(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    ddl = TABLES["foreign_flow"].ddl
    rows = [(date(2026, m, 5), "AAAA", float(m)) for m in range(1, 7)]
    warehouse.upsert("foreign_flow", spark.createDataFrame(rows, ddl))
    read = warehouse.read("foreign_flow", "2026-02-20")
    plan = read._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "2026-02" in filters and read.count() == 2
    batch = spark.createDataFrame([(date(2026, 3, 5), "AAAA", 7.0), (date(2026, 3, 5), "AAAA", 9.0)], ddl)
    assert warehouse.upsert("foreign_flow", batch) == 6
    assert warehouse["foreign_flow"].where("trade_date = '2026-03-05'").first().net_value == 9.0
