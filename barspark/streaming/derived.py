"""Derived rows kept up with a stream of bars.

Each symbol's smoothing state and its bars are keyed state. A bar behind the last adds a row from the state alone; one that
replaces or precedes bars, or a split, begins the symbol again from its kept bars. What comes out are the rows from the first
changed day on, which replace those of the table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import merge
from ..operators.indicators import RECURSIVE
from ..operators.running import Running
from . import ingest

ROW = "symbol string, date date, " + ", ".join(f"{c} double" for c in RECURSIVE) + ", whole boolean"
#: Keyed state of several parts needs this.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Smoothing(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.after = handle.getValueState("after", "last date, state string")
        self.bars = handle.getMapState("bars", "date date", "high double, low double, close double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["date", "place"]).drop_duplicates("date", keep="last")
        last, state = (self.after.get()) if self.after.exists() else (None, None)
        new = {d: (float(h), float(lo), float(c)) for d, h, lo, c in zip(batch["date"], batch["high"], batch["low"], batch["close"], strict=True)}
        split = last is not None and bool(((batch["splits"].fillna(0) != 0) & (batch["date"] > last)).any())
        if split:  # the batch is the whole history, in new prices
            self.bars.clear()
        first = min(new)
        for day, bar in new.items():
            self.bars.updateValue((day,), bar)
        if last is not None and first > last and not split:
            running, days = Running.of(json.loads(state)), list(new.items())
        else:
            running, days = Running(), sorted((k[0], tuple(v)) for k, v in self.bars.iterator())
        out = [{"date": day} | running.add(*bar) for day, bar in days]
        self.after.update((days[-1][0], json.dumps(running.kept())))
        made = pd.DataFrame(out, columns=["date", *RECURSIVE]).astype({c: "float64" for c in RECURSIVE})
        made.insert(0, "symbol", key[0])
        yield (made if split else made[made["date"] >= first]).assign(whole=split)

    def close(self) -> None:
        pass


def changed_rows(bars: DataFrame) -> DataFrame:
    """A stream of bars (``ingest.bar_stream``) -> the derived rows that each batch changes, ``whole`` if they are all that the symbol
    has from now on. Bars without a price don't count."""
    whole = bars.dropna(subset=["open", "high", "low", "close"]).select("symbol", "date", "high", "low", "close", "splits", "place")
    return whole.groupBy("symbol").transformWithStateInPandas(Smoothing(), ROW, outputMode="Update", timeMode="None")


def keep_derived(bars: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The table of derived rows at ``target`` after each batch: of a symbol in it, rows from its first changed day on are replaced;
    other symbols aren't written. The same batch again gives the same table."""

    def replace(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the state is not gone through twice
        try:
            rows = batch.drop("whole")
            old = ingest.stored_rows(rows, target).join(batch.where("whole").select("symbol").distinct(), "symbol", "left_anti")
            ingest.rewrite(merge.replace_suffix(old.select(*rows.columns), rows, "symbol", "date"), target, number)
        finally:
            batch.unpersist()

    return changed_rows(bars).writeStream.outputMode("update").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
