from datetime import date, datetime

from pyspark.sql import functions as F

from tapelens.schemas import TABLES
from tapelens.sources.tables import Warehouse
from tapelens.streaming import twins


def test_stream_upsert(spark, tmp_path):
    ddl = TABLES["foreign_flow"].ddl
    spark.createDataFrame([(date(2026, 1, 5), "AAAA", 1.0)], ddl).write.parquet(f"{tmp_path}/in")
    warehouse = Warehouse(spark, f"{tmp_path}/wh")
    stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
    twins.stream_upsert(stream, warehouse, "foreign_flow", f"{tmp_path}/cp").awaitTermination(60)
    assert warehouse["foreign_flow"].count() == 1


def test_first_calls(spark, tmp_path):
    rows = [(datetime(2026, 1, 5, 1), "e", {"a": "1", "b": None}),
            (datetime(2026, 1, 5, 2), "e", {"a": "1"}), (datetime(2026, 1, 5, 3), "f", {"a": "1"})]
    ddl = "ts timestamp, endpoint string, params map<string,string>"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/in")
    out = twins.stream_first_calls(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"))
    q = (out.select("endpoint").writeStream.format("memory").queryName("first_calls")
         .trigger(availableNow=True).start())
    q.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("first_calls").collect()) == ["e", "f"]


def test_spend_alarm(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ddl = "phase string, ts timestamp, credits int"
    rows = [("dev", datetime(2026, 1, 5, i), 20) for i in range(8)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = twins.stream_spend_alarm(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"))
    q = (out.writeStream.format("memory").queryName("alarms")
         .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    q.awaitTermination(90)
    got = spark.table("alarms").select("level", F.col("spent")).orderBy("level").collect()
    assert [tuple(r) for r in got] == [(0.7, 100), (0.9, 120)]
