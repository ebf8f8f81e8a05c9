"""Streaming forms of the time-to-live replay and the interval gate.

State is two numbers per key in the RocksDB state store: the time of the current anchor
and the newest time already answered. Rows of one micro-batch are replayed in time order
per key; rows older than what was already answered are reported, not replayed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    LongType, StringType, StructField, StructType,
)

from ..operators.ttl import SECOND
from ..sizing import micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = StructType([StructField("anchor", LongType()), StructField("seen", LongType())])


class AnchorReplay(StatefulProcessor):
    """Marks rows that come more than ``span`` microseconds after the key's last anchor."""

    def __init__(self, columns: list[str], span: int, order: list[str]):
        self.columns, self.span, self.order = columns, span, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("anchor", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        known = self.state.get() if self.state.exists() else (None, None)
        anchor, seen = known[0], known[1]
        # Only the micro-batch's rows of this key: their order is not given by Spark.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(
            ["at_us", *self.order], kind="stable"
        )
        kinds = []
        for t in batch["at_us"].tolist():
            if t != t or t is None:
                kinds.append(None)
            elif seen is not None and t < seen:
                kinds.append("late")
            elif anchor is None:
                kinds.append("first")
                anchor = seen = t
            elif t > anchor + self.span:
                kinds.append("next")
                anchor = seen = t
            else:
                kinds.append("within")
                seen = t
        if anchor is not None:
            self.state.update((int(anchor), int(seen)))
        yield batch[self.columns].assign(at_kind=pd.Series(kinds, index=batch.index, dtype="object"))

    def close(self) -> None:
        pass


def _replay(stream: DataFrame, key, ts, span, order):
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB} in the session of the stream")
    timed = stream.withColumn("at_us", micros(stream, ts))
    schema = StructType(stream.schema.fields + [StructField("at_kind", StringType())])
    return timed.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=AnchorReplay(stream.columns, span, list(order)),
        outputStructType=schema, outputMode="append", timeMode="None",
    )


def ttl_replay_stream(stream: DataFrame, key, ts: str, max_age: float, order=()) -> DataFrame:
    """``ttl_replay`` on a stream: ``status`` Miss, Expired, Hit, or Late for reported rows."""
    words = F.create_map(*[F.lit(x) for p in
                           (("first", "Miss"), ("next", "Expired"), ("within", "Hit"), ("late", "Late"))
                           for x in p])
    marked = _replay(stream, key, ts, int(max_age * SECOND), order)
    return marked.withColumn("status", F.try_element_at(words, F.col("at_kind"))).drop("at_kind")


def interval_gate_stream(stream: DataFrame, key, ts: str, interval: float, order=()) -> DataFrame:
    """``interval_gate`` on a stream: ``passed``, null for late rows."""
    marked = _replay(stream, key, ts, int(interval * SECOND) - 1, order)
    passed = F.when(F.col("at_kind").isin("first", "next"), F.lit(True)).when(
        F.col("at_kind") == "within", F.lit(False)
    )
    return marked.withColumn("passed", passed).drop("at_kind")
