"""Incremental ingest control, calendars and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Asia/Tokyo"


def last_weekday(day: Column) -> Column:
    """The weekday on or before."""
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def year_end_back(day: Column, years: Column | int) -> Column:
    """A fiscal year's end some years before; the end of a month stays one."""
    moved = F.add_months(day, F.lit(-12) * years)
    return F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved)


def deadline(day: Column) -> Column:
    """When a day's list is final: 00:30 of the next day in Tokyo, as a UTC timestamp."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp") + F.expr("INTERVAL 30 MINUTES"), ZONE)


def is_final(day: Column, result: Column, fetched_at: Column) -> Column:
    """A good or empty fetch after the deadline; a time that can't be read is not one."""
    return F.coalesce(result.isin("ok", "empty") & (fetched_at >= deadline(day)), F.lit(False))


def fetch_range(bars: DataFrame, today: Column, years: int = 10) -> DataFrame:
    """From the oldest bar of all, at most ``years`` back, to today; no row without bars or if that is empty."""
    end = today
    start = F.greatest(F.min("date"), F.add_months(end, -12 * years))
    return bars.agg(start.alias("start"), end.alias("end")).where("start is not null and start <= end")


def spine(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(start, end)).alias("day"))


def pending_dates(days: DataFrame, log: DataFrame, today: Column, now: Column, redo_days: int, most: int) -> DataFrame:
    """Days to fetch, newest first: not final, or of the last ``redo_days``; today not within a minute of its last fetch."""
    joined = days.join(log, "day", "left")
    final = is_final(F.col("day"), F.col("result"), F.col("fetched_at"))
    again = F.col("day") > F.date_sub(today, redo_days)
    just_now = (F.col("day") == today) & F.coalesce(F.col("fetched_at") > now - F.expr("INTERVAL 60 SECONDS"), F.lit(False))
    return joined.where((~final | again) & ~just_now).select("day").orderBy(F.desc("day")).limit(most)


def is_fresh(result: Column, fetched_at: Column, now: Column, hours: int) -> Column:
    """Fetched well within the last hours; 0 hours: never."""
    if hours <= 0:
        return F.lit(False)
    return F.coalesce((result == "ok") & (fetched_at > now - F.expr(f"INTERVAL {hours} HOURS")), F.lit(False))


def staleness(result: Column, fetched_at: Column, rows: Column, now: Column, days: int = 7) -> Column:
    """Why reference data has to be fetched: missing, stale, empty_table, or fresh."""
    old = F.coalesce(fetched_at < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(True))
    return F.when(~F.coalesce(result == "ok", F.lit(False)), "missing").when(old, "stale").when(F.coalesce(rows, F.lit(0)) == 0, "empty_table").otherwise("fresh")
