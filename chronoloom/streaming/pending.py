"""Pending references as a stream: every micro-batch is one increment of the orphan state.

`changes` keeps the state of each key in the state store (RocksDB), reads and writes only the keys of the increment, and
emits what begins or ends to wait. `start` keeps whole states as tables, one a micro-batch, for inspection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from chronoloom.operators import orphans

#: Change events: a reference (key, source_table, ref_id, period), a parent that arrived, or one that was deleted (key).
EVENTS = "kind string, key long, source_table string, ref_id long, period string"
PARTS = ("parents", "waiting", "resolved")


def _path(folder: str, batch: int, part: str) -> str:
    return f"{folder}/state/{batch:012d}/{part}"


def state_at(spark: SparkSession, folder: str, batch: int) -> orphans.OrphanState:
    """The state after a micro-batch; before the first it is empty."""
    if batch < 0:
        return orphans.OrphanState.empty(spark)
    return orphans.OrphanState(*[spark.read.parquet(_path(folder, batch, p)) for p in PARTS])


def start(events: DataFrame, folder: str, **trigger) -> StreamingQuery:  # noqa: ANN003
    """Run the stream; states are written to folder/state by micro-batch, counts to folder/counts.

    A micro-batch that is run again after a failure reads the state before it and overwrites its own, so the result is
    the same as if it had run once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        of = lambda k: batch.where(F.col("kind") == k)
        state = orphans.advance(state_at(spark, folder, number - 1), of("reference").select("source_table", "ref_id", "key", "period"), of("arrived").select("key"), of("deleted").select("key"))
        for part in PARTS:
            getattr(state, part).write.mode("overwrite").parquet(_path(folder, number, part))
        orphans.snapshot_counts(state_at(spark, folder, number)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


#: What `changes` emits: a reference that begins (waits) or ends to wait.
CHANGE = "source_table string, ref_id long, key long, period string, waits boolean"


class Pending(StatefulProcessor):
    """The state of one key: whether its parent is there, and its references. Rows of a key come in bounded batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.there = handle.getValueState("there", "there boolean")
        self.refs = handle.getMapState("refs", "source_table string, ref_id long, period string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        kinds, new = set(), {}
        for pdf in rows:
            kinds |= set(pdf["kind"])
            wanted = pdf[(pdf["kind"] == "reference") & pdf["ref_id"].notna()]
            new.update(dict.fromkeys(zip(wanted["source_table"], wanted["ref_id"].astype("int64"), wanted["period"].fillna("unknown"))))
        before = bool(self.there.exists() and self.there.get()[0])
        now = "arrived" in kinds or (before and "deleted" not in kinds)
        old = list(self.refs.keys()) if before != now else []
        out = [(*r, now) for r in map(tuple, old)]
        for r in new:
            if not self.refs.containsKey(r):
                self.refs.updateValue(r, (True,))
                out += [] if now else [(*r, False)]
        if before != now:
            self.there.update((now,))
        if out:
            t, i, p, there = zip(*out)
            yield pd.DataFrame({"source_table": t, "ref_id": i, "key": [key[0]] * len(out), "period": p, "waits": [not x for x in there]})

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """What begins and ends to wait (CHANGE), from a stream of EVENTS; needs the RocksDB state store (`keyed_state`)."""
    return events.where("key is not null").groupBy("key").transformWithStateInPandas(statefulProcessor=Pending(), outputStructType=CHANGE, outputMode="Update", timeMode="None")


def keyed_state(spark: SparkSession) -> None:
    """Choose the state store that keeps several states a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
