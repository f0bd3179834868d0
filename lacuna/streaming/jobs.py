"""Jobs as a stateful stream: changes may come in any order, more than once, and late."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lacuna.shipping import ship
from lacuna.streaming.events import TRANSITIONS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SEQ = StructType([StructField("seq", LongType())])
_STATE = StructType([StructField("state", StringType())])
_NOW = StructType([StructField("state", StringType()), *[StructField(c, LongType()) for c in ("next", "illegal", "version")]])
OUT = StructType([StructField("job_id", LongType()), StructField("state", StringType()), StructField("n_illegal", LongType()), StructField("version", LongType())])


class Jobs(StatefulProcessor):
    """State of a job: where it is, the next change it waits for, and changes that came before their turn. A job whose source has not
    come `patience_ms` after it began to fetch goes on as PARTIAL, by a timer; the source's change still moves it on when it comes."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", _NOW)
        self.ahead = handle.getMapState("ahead", _SEQ, _STATE)

    def _read(self) -> list[Any]:
        return list(self.now.get()) if self.now.exists() else ["QUEUED", 0, 0, 0]

    def _out(self, key: Any, now: list[Any]) -> Iterator[pd.DataFrame]:
        now[3] += 1
        self.now.update(tuple(now))
        yield pd.DataFrame({"job_id": [key[0]], "state": [now[0]], "n_illegal": [now[2]], "version": [now[3]]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = self._read()
        first, fetching = now[1], now[0]
        for batch in rows:
            for seq, state in zip(batch["seq"].tolist(), batch["state"].tolist()):
                if seq >= now[1]:  # the others have been seen
                    self.ahead.updateValue((seq,), (state,))
        while self.ahead.containsKey((now[1],)):
            state = self.ahead.getValue((now[1],))[0]
            self.ahead.removeKey((now[1],))
            now[1] += 1
            if state in TRANSITIONS[now[0]]:
                now[0] = state
            else:
                now[2] += 1
        if now[0] == "FETCHING" and fetching != "FETCHING":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        if now[1] > first:
            yield from self._out(key, now)
        else:
            self.now.update(tuple(now))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = self._read()
        if now[0] == "FETCHING":
            now[0] = "PARTIAL"
            yield from self._out(key, now)

    def close(self) -> None:
        pass


def job_stream(changes: DataFrame, patience_ms: int = 600_000) -> DataFrame:
    """(job_id, state, n_illegal, version) of a stream of changes (job_id, seq, state), whenever a job moves on; seq counts a job's
    changes from 0. Whatever the order, the repeats and the cut into batches, a job's last row is that of events.job_states,
    but for jobs that timers have made PARTIAL. Rows with a null are left out. The session's state store becomes RocksDB."""
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ship(spark)
    rows = changes.select(F.col("job_id").cast("bigint").alias("job_id"), F.col("seq").cast("bigint").alias("seq"), "state").where("job_id is not null and seq is not null and state is not null")
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Jobs(patience_ms), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime")


def put(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes a micro-batch in a folder of its own, whole or not at all: one that is delivered again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def keep(states: DataFrame, path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Starts writing job_stream's rows below `path`. Timers go on as long as the query runs, so it ends when it is stopped."""
    return states.writeStream.outputMode("update").foreachBatch(lambda batch, k: put(batch, k, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def table(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, state, n_illegal): each job's latest row of those that `keep` wrote."""
    rows = spark.read.schema(OUT).parquet(path)
    best = rows.groupBy("job_id").agg(F.max(F.struct("version", "state", "n_illegal")).alias("x"))
    return best.select("job_id", "x.state", "x.n_illegal")
