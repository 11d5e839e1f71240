"""Streaming forms of three batch jobs: upsert, spend alarm and call de-duplication.

Their state is bounded: the upsert keeps none, the alarm keeps one total and two flags per
phase, the de-duplication keeps fingerprints for as long as the watermark allows.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapelens import constants as K
from tapelens.operators import ledger
from tapelens.sources.tables import Warehouse


def stream_upsert(stream: DataFrame, warehouse: Warehouse, table: str, checkpoint: str):
    """Each micro-batch goes through the batch upsert; a replayed batch changes nothing."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: warehouse.upsert(table, batch, count=False))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class SpendAlarm(StatefulProcessor):
    """Running spend per phase; each level fires once.

    Entries count in the order they arrive, one Arrow batch in memory at a time, so a phase
    with most of the ledger needs no more memory than a quiet one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spend", "spent long, fired int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values):
        phase = key[0]
        spent, fired = self.state.get() if self.state.exists() else (0, 0)
        cap = K.PHASE_CAPS.get(phase)
        if cap is None:  # a phase without a cap has no alarm, as in the batch form
            return
        alarms = []
        for chunk in rows:
            running = spent + chunk["credits"].cumsum()
            while fired < len(K.ALARM_LEVELS) and running.iloc[-1] / cap >= K.ALARM_LEVELS[fired]:
                at = int((running / cap >= K.ALARM_LEVELS[fired]).to_numpy().argmax())
                alarms.append((phase, K.ALARM_LEVELS[fired], chunk["ts"].iloc[at],
                               int(running.iloc[at])))
                fired += 1
            spent = int(running.iloc[-1])
        self.state.update((spent, fired))
        if alarms:
            yield pd.DataFrame(alarms, columns=["phase", "level", "ts", "spent"])

    def close(self) -> None:
        pass


def by_minute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Credits per phase and minute of each batch, stamped with the last entry of the minute."""
    for batch in batches:
        minute = batch["ts"].dt.floor("min").rename("minute")
        yield batch.groupby(["phase", minute], sort=True).agg(
            ts=("ts", "max"), credits=("credits", "sum")).reset_index()[["phase", "ts", "credits"]]


def stream_spend_alarm(stream: DataFrame) -> DataFrame:
    """Alarm rows (phase, level, ts, spent) from a stream of ledger entries.

    Entries are summed per minute before they meet the state of their phase, so the task of a phase
    with most of the ledger reads a row per minute and input task, not every call. Needs the
    RocksDB state store, which `session.build_session` sets.
    """
    summed = stream.select("phase", "ts", F.col("credits").cast("long").alias("credits")).mapInPandas(
        by_minute, "phase string, ts timestamp, credits long")
    return summed.groupBy("phase").transformWithStateInPandas(
        statefulProcessor=SpendAlarm(),
        outputStructType="phase string, level double, ts timestamp, spent long",
        outputMode="append", timeMode="none")


def stream_first_calls(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each request fingerprint once within the watermark."""
    marked = stream.withColumn("fingerprint", ledger.fingerprint(F.col("endpoint"),
                                                                 F.col("params")))
    return marked.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint"])
