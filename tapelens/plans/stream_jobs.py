"""Registered jobs: streaming forms, fed from files in several micro-batches and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelens import constants as K
from tapelens.plans.registry import query
from tapelens.schemas import TABLES
from tapelens.session import ROCKSDB, STATE_STORE, scratch_dir
from tapelens.sources import tables
from tapelens.streaming import twins

FILES_PER_BATCH = 3


def file_stream(t, rows: DataFrame, files: int = 8) -> DataFrame:
    """The rows as a stream: written to several files, a few of which make a micro-batch."""
    folder = f"{scratch_dir(t.spark)}/in"
    rows.repartition(files).write.parquet(folder)
    return t.spark.readStream.schema(rows.schema).option(
        "maxFilesPerTrigger", FILES_PER_BATCH).parquet(folder)


@query("z1_stream_upsert", "select trade_date, symbol, net_value from foreign_flow")
def upsert(t):
    spec = TABLES["foreign_flow"]
    rows = tables.conform(t["foreign_flow"], spec)
    folder = scratch_dir(t.spark)
    warehouse = tables.Warehouse(t.spark, f"{folder}/tables")
    stream = file_stream(t, rows.unionByName(rows))  # every key twice, in any batches
    twins.stream_upsert(stream, warehouse, spec.name, f"{folder}/progress").awaitTermination()
    return warehouse[spec.name]


_SPENT = "case when event_id % 9 = 0 then 'unplanned' else phase end"


@query("z2_stream_spend_alarm", f"""
    select s.phase, l.level, cast(1 as bigint) as alarms, true as reached
    from (select {_SPENT} as phase, sum(credits) as spent from credit_ledger group by 1) s
    join (values {", ".join(f"('{k}', {v})" for k, v in K.PHASE_CAPS.items())}) c(phase, cap)
      on c.phase = s.phase
    join (select unnest([{", ".join(f"cast({x} as double)" for x in K.ALARM_LEVELS)}]) as level) l
      on s.spent / c.cap >= l.level""")
def spend_alarm(t):
    """The alarms of a ledger that arrives in several micro-batches; one phase has no cap."""
    calls = t["credit_ledger"].select(
        F.expr(_SPENT).alias("phase"), F.col("ts").cast("timestamp").alias("ts"), "credits")
    folder, store = scratch_dir(t.spark), t.spark.conf.get(STATE_STORE)
    t.spark.conf.set(STATE_STORE, ROCKSDB)  # for sessions that others built
    try:
        twins.stream_spend_alarm(file_stream(t, calls)).writeStream.option(
            "checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(
            f"{folder}/out").awaitTermination()
    finally:
        t.spark.conf.set(STATE_STORE, store)
    caps = F.create_map(*[F.lit(x) for kv in K.PHASE_CAPS.items() for x in kv])
    fired = t.spark.read.schema("phase string, level double, ts timestamp, spent long").parquet(f"{folder}/out")
    return fired.groupBy("phase", "level").agg(
        F.count("*").alias("alarms"),
        F.bool_and(F.col("spent") / caps[F.col("phase")] >= F.col("level")).alias("reached"))


@query("z3_stream_call_dedup", """
    select endpoint, count(distinct symbol || '|' || rows_returned) as calls
    from credit_ledger group by 1""")
def first_calls(t):
    params = F.create_map(F.lit("symbol"), F.col("symbol"),
                          F.lit("rows"), F.col("rows_returned").cast("string"))
    calls = t["credit_ledger"].select(F.col("ts").cast("timestamp").alias("ts"), "endpoint",
                                      params.alias("params"))
    folder = scratch_dir(t.spark)
    first = twins.stream_first_calls(file_stream(t, calls), delay="7300 days")
    first.select("endpoint").writeStream.option("checkpointLocation", f"{folder}/progress").trigger(
        availableNow=True).start(f"{folder}/out").awaitTermination()
    return t.spark.read.schema("endpoint string").parquet(f"{folder}/out").groupBy("endpoint").agg(
        F.count("*").alias("calls"))
