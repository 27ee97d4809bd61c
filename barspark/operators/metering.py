"""Usage by day and in trailing minutes, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"
MINUTE = 60_000_000


def pacific_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def daily(events: DataFrame) -> DataFrame:
    """``model, day, requests, tokens``."""
    return events.groupBy("model", pacific_day(F.col("ts")).alias("day")).agg(F.count_if("is_request").alias("requests"), F.sum("tokens").alias("tokens"))


def trailing_minute(events: DataFrame) -> DataFrame:
    """Requests and tokens of the last 60 seconds at each event; an event exactly 60 seconds old is out.

    A window reaches into the minute before and no further, so each event also goes to the minute after its own, and
    partitions are minutes of a model: a few models' whole streams never meet in a few tasks."""
    minute = F.floor(F.unix_micros("ts") / MINUTE)
    both = F.array(F.struct(minute.alias("minute"), F.lit(True).alias("own")), F.struct((minute + 1).alias("minute"), F.lit(False).alias("own")))
    event = events.select(F.struct(*events.columns).alias("event"), F.col("model").alias("m"), F.unix_micros("ts").alias("at"), F.explode_outer(both).alias("x"))
    w = Window.partitionBy("m", "x.minute").orderBy("at").rangeBetween(1 - MINUTE, 0)
    sums = event.withColumns({"requests_60s": F.count_if("event.is_request").over(w), "tokens_60s": F.sum("event.tokens").over(w)})
    return sums.where("x.own").select("event.*", "requests_60s", "tokens_60s")


def waits(events: DataFrame, now: Column, max_requests: int, max_tokens: int, need: int) -> DataFrame:
    """``model, wait_s``: until one more request of ``need`` tokens fits; a limit of 0 is none.

    Requests: the oldest so many must have gone that one fits. Tokens: the oldest go until what stays and ``need`` fit.
    """
    live = events.withColumn("now", now).where((F.col("ts") > F.col("now") - F.expr("INTERVAL 60 SECONDS")) & (F.col("ts") <= F.col("now")))
    left = ((F.unix_micros("ts") + MINUTE - F.unix_micros("now")) / 1e6).alias("left")
    order = Window.partitionBy("model").orderBy("ts", "event_id")
    whole = Window.partitionBy("model")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = live.select(
        "model", left, "is_request",
        F.sum("tokens").over(whole).alias("all_tokens"), F.sum("tokens").over(upto).alias("gone"),
        F.count_if("is_request").over(whole).alias("all_requests"), F.count_if("is_request").over(upto).alias("gone_requests"),
    )
    by_request = F.min(F.when(F.col("is_request") & (F.col("all_requests") - F.col("gone_requests") < max_requests), F.col("left")))
    by_tokens = F.min(F.when(F.col("all_tokens") - F.col("gone") + need <= max_tokens, F.col("left")))
    fits_requests = (F.max("all_requests") < max_requests) if max_requests > 0 else F.lit(True)
    fits_tokens = (F.max("all_tokens") + need <= max_tokens) if max_tokens > 0 else F.lit(True)
    none = F.lit(0.0)
    return rows.groupBy("model").agg(
        F.greatest(F.when(fits_requests, none).otherwise(F.coalesce(by_request, none)), F.when(fits_tokens, none).otherwise(F.coalesce(by_tokens, F.max("left")))).alias("wait_s")
    )


def decision(configured: Column, exhausted: Column, used: Column, per_day: Column, need: Column, per_minute: Column) -> Column:
    """Checked in this order."""
    return (
        F.when(~configured, "unconfigured").when(exhausted, "exhausted").when((per_day > 0) & (used >= per_day), "daily_limit")
        .when((per_minute > 0) & (need > per_minute), "too_large").otherwise("ok")
    )


def scope(quota_id: Column) -> Column:
    """What a limit message is about: day, minute or unknown."""
    return F.when(quota_id.ilike("%perday%"), "day").when(quota_id.ilike("%perminute%"), "minute").otherwise("unknown")


def seconds_of(delay: Column) -> Column:
    """``"1.5s"`` as seconds."""
    return F.nullif(F.regexp_extract(delay, r"^(\d+(?:\.\d+)?)s$", 1), F.lit("")).try_cast("double")
