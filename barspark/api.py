"""What a caller asks for, as DataFrames: nothing is collected here."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import context, export, filings, indicators, signals, supply


@dataclass(frozen=True)
class Store:
    """Tables by their meaning; what is missing is None and what needs it can't be asked for."""

    stocks: DataFrame  # symbol, name, currency
    bars: DataFrame  # symbol, date, open, high, low, close, volume
    short_reports: DataFrame | None = None  # symbol, calc_date, holder_id, ratio, quantity, note
    filings: DataFrame | None = None  # doc_id, doc_type, submit_at, withdrawal, and the entities
    links: DataFrame | None = None  # doc_id, symbol, role


def list_stocks(store: Store) -> DataFrame:
    """Every stock with the number and range of its bars."""
    have = store.bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return store.stocks.join(have, "symbol", "left").withColumn("bars", F.coalesce("bars", F.lit(0))).orderBy("symbol")


def dashboard(store: Store, symbol: str) -> dict[str, DataFrame]:
    """All frames of one symbol's page. The filter on the symbol reaches the scans."""
    bars = store.bars.where(F.col("symbol") == symbol)
    panel = indicators.indicators(bars)
    out = {
        "quote": indicators.quote(bars), "panel": panel, "future_cloud": indicators.future_cloud(bars), "cards": signals.cards(panel),
        "signals": signals.last_signals(signals.signals(panel)),
        "table": panel.withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("nth <= 60"),
    }
    if store.short_reports is not None:
        totals = supply.short_totals(store.short_reports.where(F.col("symbol") == symbol))
        out["short_points"] = supply.points_with_carry(totals, bars)
    if store.filings is not None and store.links is not None:
        listed = get_filings(store, symbol)
        out["markers"] = filings.markers(supply.next_bar(listed, bars, F.to_date("submit_at")))
        out["filing_counts"] = filings.counts(listed)
    return out


def get_filings(store: Store, symbol: str) -> DataFrame:
    """Filings of a symbol with their roles, newest first."""
    links = store.links.where(F.col("symbol") == symbol)
    return filings.by_symbol(store.filings, links).orderBy(F.desc("submit_at"), "doc_id")


def export_rows(store: Store, symbols: Iterable[str], days: int) -> DataFrame:
    """The machine table of the last ``days`` bars of some symbols; symbols count once, in any order."""
    wanted = list(dict.fromkeys(symbols))
    if not wanted or not 1 <= days <= 10_000:
        raise ValueError("name a symbol, and from 1 to 10000 days")
    bars = store.bars.where(F.col("symbol").isin(wanted))
    return export.machine(context.split_recent(indicators.indicators(bars), days).drop("recent"), store.stocks)


def text_context(store: Store, symbol: str, days: int) -> dict[str, DataFrame]:
    """Recent bars whole and older ones summed up; supply reports never come into it."""
    panel = indicators.indicators(store.bars.where(F.col("symbol") == symbol))
    split = context.split_recent(panel, days)
    older = split.where("not recent")
    return {"recent": split.where("recent"), "summary": context.summary(older), "indicators": context.indicator_summary(older, indicators.COLUMNS)}
