"""Requests and tokens of the last minute at each event of a stream, whatever the order in which events come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Microseconds, and bits that hold two minutes of them.
MINUTE, SPAN = 60_000_000, 27


def trailing_minute(events: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """``model, ts, tokens, is_request, event_id`` -> the same with ``requests_60s, tokens_60s``, as ``metering.trailing_minute`` has
    them, once for each event.

    Windows of two minutes, one beginning every minute, hold a model's events: those of the second minute are counted there, and
    what they look back to is in the first. A window is given out when the watermark, ``delay`` behind the latest event, passes
    its end; events that come later than that don't count, nor do events without a time. Missing tokens count as none. No
    task holds more of a model than two minutes.
    """
    event = F.struct(F.unix_micros("ts").alias("at"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("is_request", F.lit(False)).alias("is_request"), "event_id")
    spans = events.withWatermark("ts", delay).groupBy("model", F.window("ts", "2 minutes", "1 minute").alias("span")).agg(F.collect_list(event).alias("events"))
    held = spans.select("model", F.unix_micros("span.start").alias("start"), "events")
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("model", "event_id")}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            events = batch.column(2).flatten()
            span = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            at = events.field("at").to_numpy()
            key = span << SPAN | at - batch.column(1).to_numpy()[span]  # the span, and the time in it
            order = np.argsort(key, kind="stable")
            key, span = key[order], span[order]
            own = (key & (1 << SPAN) - 1) >= MINUTE
            upto, since = np.searchsorted(key, key[own], "right"), np.searchsorted(key, key[own] - MINUTE, "right")
            kept = pa.array(order[own])
            columns = [batch.column(0).take(pa.array(span[own])), *[events.field(c).take(kept) for c in ("at", "tokens", "is_request", "event_id")]]
            for c in ("is_request", "tokens"):
                sums = np.r_[0, np.cumsum(events.field(c).to_numpy(zero_copy_only=False).astype(np.int64)[order])]
                columns.append(pa.array(sums[upto] - sums[since]))
            yield pa.RecordBatch.from_arrays(columns, names=["model", "at", "tokens", "is_request", "event_id", "requests_60s", "tokens_60s"])

    schema = f"model {kinds['model']}, at long, tokens long, is_request boolean, event_id {kinds['event_id']}, requests_60s long, tokens_60s long"
    done = held.mapInArrow(count, schema)
    return done.select("model", F.timestamp_micros("at").alias("ts"), "tokens", "is_request", "event_id", "requests_60s", "tokens_60s")
