"""Folds and stalls as streams that keep state for each key and end with what the batch operators give.

An event waits in its key's state until the watermark has passed it, when no earlier one can come any more; then the
key's events are taken in order of (ts, seq). So a stream's result doesn't depend on how its events are cut into batches,
nor on their order within the watermark's delay; events that come later than that are dropped, as Spark does. A key's
state is its fold and the events that still wait. Timers wake a key when its time has come, without an event of its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: (state, event) -> the next state; both are dicts of JSON values, a new key's state is empty.
Step = Callable[[dict, dict], dict]


def _milliseconds(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[ms]").astype("int64")


def _put(held: object, values: list[tuple]) -> None:
    """A list state's new values; an empty list is no value."""
    if values:
        held.put(values)
    else:
        held.clear()


class OrderedFold(StatefulProcessor):
    """(key, state) each time that a key's events have moved it."""

    def __init__(self, step: Step) -> None:
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string")
        self.waiting = handle.getListState("waiting", "ts bigint, seq bigint, event string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for ts, seq, event in zip(_milliseconds(part["ts"]), part["seq"], part["event"], strict=True):
                self.waiting.appendValue((int(ts), int(seq), event))
                self.handle.registerTimer(int(ts) + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs()
        events = [tuple(e) for e in self.waiting.get()]
        ready = sorted(e for e in events if e[0] < until)
        if not ready:
            return
        _put(self.waiting, [e for e in events if e[0] >= until])
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        for _, _, event in ready:
            state = self.step(state, json.loads(event))
        self.state.update((json.dumps(state),))
        yield pd.DataFrame({"k": [str(key[0])], "seq": [ready[-1][1]], "state": [json.dumps(state, sort_keys=True)]})

    def close(self) -> None:
        pass


class Stalls(StatefulProcessor):
    """(key, since) of each silence: a beat that no other follows within the given milliseconds."""

    def __init__(self, after: int) -> None:
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beats = handle.getListState("beats", "ts bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for ts in _milliseconds(part["ts"]):
                self.beats.appendValue((int(ts),))
                self.handle.registerTimer(int(ts) + self.after + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since = expiredTimerInfo.getExpiryTimeInMs() - self.after - 1
        beats = sorted({b for (b,) in self.beats.get()})
        if since not in beats:
            return
        later = [b for b in beats if b > since]
        _put(self.beats, [(b,) for b in later])
        if not later or later[0] > since + self.after:
            yield pd.DataFrame({"k": [str(key[0])], "since": [since]})

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """Sets the store of states that timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def folded(events: DataFrame, key: str, step: Step, delay: str = "1 hour") -> DataFrame:
    """k, seq, state (JSON): a key's state after each lot of its events. events, a stream: the key, ts, seq and any other
    columns that JSON can hold. The last row of a key is its state."""
    with_state_store(events.sparkSession)
    d = events.select(F.col(key).alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("event"))
    return d.withWatermark("ts", delay).groupBy("k").transformWithStateInPandas(OrderedFold(step), "k string, seq long, state string", "Update", "EventTime")


def stalls(beats: DataFrame, key: str, seconds: int, delay: str = "1 hour") -> DataFrame:
    """k, since (milliseconds) of each silence of more than so many seconds after a beat. beats, a stream: the key and ts."""
    with_state_store(beats.sparkSession)
    d = beats.select(F.col(key).alias("k"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return d.groupBy("k").transformWithStateInPandas(Stalls(seconds * 1000), "k string, since long", "Append", "EventTime")


def naming_step(state: dict, event: dict) -> dict:
    """events.naming_fold(): confirm and new set a name and take back an exclusion; anything else removes and excludes."""
    named = event["action"] in ("confirm", "new")
    return {"name": event["name"] if named else None, "excluded": not named}


def memory_step(state: dict, event: dict) -> dict:
    """memory.memory_fold(): a mark holds while the face stays with its character; an absent mark keeps it."""
    on = event["character"] if event["action"] in ("confirm", "new") else None
    kept = state.get("mark") if state and state.get("character") == on else None
    return {"character": on, "mark": event["mark"] if event["mark"] is not None else kept}


def tray_step(state: dict, event: dict) -> dict:
    """memory.tray_fold() of an image, whose subjects and disposition every command carries."""
    moves = {"reopen": "pending", "defer": "deferred", "unknown-foreign": "unknown-foreign"}
    s = state or {"archived": False, "disposition": event["disposition"], "triggers": [], "refused": 0}
    action, to, whole = event["action"], moves.get(event["action"]), event["subjects"] == 0
    return {
        "archived": s["archived"] or action == "archive",
        "disposition": to if to and whole else s["disposition"],
        "triggers": sorted({*s["triggers"], event["trigger"]}) if action == "notify" and event["trigger"] is not None else s["triggers"],
        "refused": s["refused"] + (to is not None and not whole),
    }
