"""Holds a container's events in keyed state until what they wait for comes, with event-time timers.

Events wait in a list in RocksDB, to which each batch only appends; a second state of a few numbers says whether the container is open, how many wait and which of them are lost.
The list is read when the container opens, when its grace period ends, and once for every `most` events that are lost. What still waits
when the stream ends is read from the operator's state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MOST = 100_000
#: Rows that are given at once.
SLICE = 50_000
OUT = "cid string, seq long, t_ns long, outcome string, n long"
NS_OF_MS = 1_000_000

_STORE = "spark.sql.streaming.stateStore"
STORE = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def on_disk(spark: SparkSession):
    """State in RocksDB while streams start within; the session's own settings come back."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Hold(StatefulProcessor):
    """One container's events.

    `open_` rows open the container: what waits goes, in order of arrival, and later events pass. An event that finds it closed waits, and the first one sets a timer. When the
    clock (the watermark) passes the timer, one row tells of `late`, with the first waiting event and how many wait; with `drop` they go with it, and the next event waits
    anew, else they stay. A container is told of once: later rows of the kind are `late_again`. Beyond `most`, the oldest are lost, and a `lost` row counts them.
    """

    def __init__(self, grace_ns: int, most: int, late: str, late_again: str, drop: bool):
        self.grace_ns, self.most, self.late, self.late_again, self.drop = grace_ns, most, late, late_again, drop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "seq long, t_ns long")
        self.meta = handle.getValueState("meta", "opened boolean, n long, skip long, due_ms long, told boolean")

    def _get(self) -> tuple:
        return tuple(self.meta.get()) if self.meta.exists() else (False, 0, 0, None, False)

    def _waiting(self, skip: int) -> list[tuple[int, int]]:
        return [(int(s), int(t)) for s, t in self.held.get()][skip:] if self.held.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, n, skip, due, told = self._get()
        at = pd.concat(list(rows)).sort_values(["seq", "t_ns"], kind="stable")
        opens = bool((at["what"] == "open").any())
        events = at.loc[at["what"] == "event", ["seq", "t_ns"]]
        if opened or opens:
            waiting = self._waiting(skip) if n else []
            if due is not None:
                self.handle.deleteTimer(due)
            if n:
                self.held.clear()
            go = pd.concat([pd.DataFrame(waiting, columns=["seq", "t_ns"], dtype="int64"), events]) if waiting else events
            for i in range(0, len(go), SLICE):
                part = go.iloc[i : i + SLICE]
                yield pd.DataFrame({"cid": key[0], "seq": part["seq"].to_numpy(), "t_ns": part["t_ns"].to_numpy(), "outcome": "released", "n": 1})
            self.meta.update((True, 0, 0, None, told))
            return
        if not len(events):
            return
        if due is None and not (told and not self.drop):
            due = (int(events["t_ns"].iloc[0]) + self.grace_ns) // NS_OF_MS
            self.handle.registerTimer(due)
        self.held.appendList([(int(s), int(t)) for s, t in zip(events["seq"], events["t_ns"], strict=True)])
        n += len(events)
        if (lost := n - self.most) > 0:
            skip, n = skip + lost, self.most
            if skip >= self.most:
                self.held.put(self._waiting(skip))
                skip = 0
            yield pd.DataFrame({"cid": [key[0]], "seq": pd.array([None], "Int64"), "t_ns": pd.array([None], "Int64"), "outcome": ["lost"], "n": [lost]})
        self.meta.update((False, n, skip, due, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        opened, n, skip, due, told = self._get()
        if opened or not n:
            return
        waiting = self._waiting(skip)
        yield pd.DataFrame({"cid": [key[0]], "seq": [waiting[0][0]], "t_ns": [waiting[0][1]], "outcome": [self.late_again if told else self.late], "n": [len(waiting)]})
        if self.drop:
            self.held.clear()
            n = skip = 0
        self.meta.update((False, n, skip, None, True))

    def close(self) -> None:
        pass


def held(rows: DataFrame, grace_ns: int, late: str, late_again: str, drop: bool, most: int = MOST) -> DataFrame:
    """(cid, seq, t_ns, outcome, n) of a stream rows (cid, seq, t_ns, what), what being `event` or `open`; the clock is the greatest time of any row that has come.

    Spark drops rows that are behind the watermark. So a row's time travels in a second row, a `tick`, that may be dropped, and the row itself has no event time and is never late.
    """
    at = F.timestamp_micros(F.floor(F.col("t_ns") / 1000).cast("long"))
    pair = F.array(F.struct("what", F.lit(None).cast("timestamp").alias("at")), F.struct(F.lit("tick").alias("what"), at.alias("at")))
    timed = rows.select("cid", "seq", "t_ns", F.explode(pair).alias("r")).select("cid", "seq", "t_ns", "r.what", "r.at").withWatermark("at", "0 seconds")
    return timed.groupBy("cid").transformWithStateInPandas(Hold(grace_ns, most, late, late_again, drop), OUT, "Append", "EventTime")


def until_bound(rows: DataFrame, grace_ns: int = 30_000_000_000, most: int = MOST) -> DataFrame:
    """Events of containers without a binding wait `grace_ns` for it; then they fail, once as `unknown_container`, after that as `unbound_events`."""
    return held(rows, grace_ns, "unknown_container", "unbound_events", True, most)


def until_envelope(rows: DataFrame, timeout_ns: int = 300_000_000_000, most: int = MOST) -> DataFrame:
    """Events of images without a specification wait for it; after `timeout_ns` that is told once as `no_envelope`, and they wait on."""
    return held(rows, timeout_ns, "no_envelope", "no_envelope", False, most)


def run(out_rows: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream of outcomes over all there is, in batches, to a table."""
    spark = out_rows.sparkSession
    with on_disk(spark):
        out_rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(out)


def still_held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(cid, seq, t_ns): what waits in the state of a stream that has ended, without what is lost."""
    with on_disk(spark):
        read = spark.read.format("statestore")
        meta = read.option("stateVarName", "meta").load(checkpoint).select("key.cid", "value.*")
        rows = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint).select("key.cid", "list_element.*")
    nth = F.row_number().over(Window.partitionBy("cid").orderBy("seq", "t_ns"))
    lost = meta.where("skip > 0").select("cid", "skip")
    some = rows.join(lost, "cid").withColumn("nth", nth).where("nth > skip").select("cid", "seq", "t_ns")
    return rows.join(lost, "cid", "left_anti").select("cid", "seq", "t_ns").unionByName(some)
