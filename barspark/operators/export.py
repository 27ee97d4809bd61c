"""Tables for people and for machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import COLUMNS

PRICES = ("open", "high", "low", "close")
TWO_DECIMALS = ("macd", "macd_signal", "rsi", "rci_short", "rci_long", "plus_di", "minus_di", "adx", "stoch_k", "stoch_d", "deviation_short", "deviation_long", "psychological")


def price_decimals(currency: Column) -> Column:
    return F.when(currency == "JPY", 1).otherwise(2)


def _decimals(c: str, n: int) -> Column:
    """Half up; what looks like a tie at six decimals is one."""
    return F.floor(F.round(F.col(c), 6) * 10**n + 0.5) / 10**n + F.lit(0.0)


def _by_currency(c: str) -> Column:
    return F.when(F.col("currency") == "JPY", _decimals(c, 1)).otherwise(_decimals(c, 2))


def human_prices(bars: DataFrame) -> DataFrame:
    """Newest first, days as yyyy/MM/dd, prices with the currency's decimals."""
    made = bars.select("symbol", F.date_format("date", "yyyy/MM/dd").alias("day"), *[_by_currency(c).alias(c) for c in PRICES], "volume")
    return made.orderBy("symbol", F.desc("day"))


def human_indicators(panel: DataFrame) -> DataFrame:
    """The same for indicators beside the close, percents and MACD with two decimals."""
    each = [(_decimals(c, 2) if c in TWO_DECIMALS else _by_currency(c)).alias(c) for c in COLUMNS]
    return panel.select("symbol", F.date_format("date", "yyyy/MM/dd").alias("day"), _by_currency("close").alias("close"), *each).orderBy("symbol", F.desc("day"))


def machine(panel: DataFrame, names: DataFrame) -> DataFrame:
    """One long table of all symbols, oldest first, four decimals."""
    numbers = [(F.round(F.col(c), 4) + F.lit(0.0)).alias(c) for c in (*PRICES, *COLUMNS)]
    return panel.join(names, "symbol", "left").select("symbol", "name", "currency", "date", *numbers, "volume").orderBy("symbol", "date")


def write_human_csv(table: DataFrame, path: str) -> None:
    """CSV by symbol; the byte order mark that spreadsheets look for is part of the first column's name."""
    first, *rest = [c for c in table.columns if c != "symbol"]
    marked = table.select("symbol", F.col(first).alias("﻿" + first), *rest)
    marked.repartition("symbol").sortWithinPartitions("symbol", F.desc("﻿" + first)).write.partitionBy("symbol").mode("overwrite").csv(path, header=True, nullValue="")


def write_machine_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True, nullValue="")
