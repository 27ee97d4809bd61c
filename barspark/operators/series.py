"""Series side by side, work in turn, and what columns mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import COLUMNS


def aligned(index: DataFrame, series: DataFrame, key: list[str]) -> DataFrame:
    """``index`` (key, date) and ``series`` (key, item, date, value) -> key, item, date, value: each item on every date of its key's index,
    null where it has none there. Items without a value on the index are left out."""
    on = [*key, "date"]
    there = series.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).join(index.select(*on).distinct(), on, "left_semi")
    items = there.select(*key, "item").distinct()
    return index.select(*on).join(items, key).join(there.select(*on, "item", "value"), [*on, "item"], "left").select(*key, "item", "date", "value")


def in_turn(rows: DataFrame, key: str, newest: int, order: list[str]) -> DataFrame:
    """The newest so many rows of each key, with ``turn``: their place when they are worked off oldest first."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    chosen = rows.withColumn("_nth", nth).where(F.col("_nth") <= newest)
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_nth")))
    return chosen.withColumn("turn", turn).drop("_nth")


def distinct_in_order(rows: DataFrame, columns: list[str], place: str) -> DataFrame:
    """Each different value once, with the least place it has: the order of first appearance. Partial on the map side."""
    return rows.groupBy(*columns).agg(F.min(place).alias(place))


def short_date(day: Column) -> Column:
    """Month and day without leading zeros."""
    return F.date_format(day, "M/d")


def script_safe(json: Column) -> Column:
    """JSON that can stand in a script element: nothing in it ends the element or begins a comment, and it reads the same."""
    for char in ("<", ">", "&", "\u2028", "\u2029"):
        json = F.replace(json, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return json


#: Columns by group, and how each group is read.
MEANINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "simple mean": (("sma_short", "sma_mid", "sma_long"), "mean of the last 5, 25, 75 closes; short above mid above long is a rising trend"),
    "bands": (("bb_upper", "bb_mid", "bb_lower"), "mean of 20 closes and two population deviations beside it; outside is far"),
    "macd": (("macd", "macd_signal"), "exponential mean of 12 less that of 26, and its mean of 9; crossing upward is a sign to buy"),
    "rsi": (("rsi",), "share of rises in Wilder's means of 14 moves, 0 to 100; from 70 on overbought, to 30 oversold"),
    "cloud": (
        ("ichimoku_kijun", "ichimoku_tenkan", "ichimoku_senkou1", "ichimoku_senkou2", "ichimoku_chikou"),
        "middles of high and low over 26, 9, 52 bars, led by 25 bars, and the close of 25 bars ahead; above the cloud is strong",
    ),
    "exponential mean": (("ema_short", "ema_mid", "ema_long"), "exponential mean of closes, spans 5, 25, 75"),
    "rank correlation": (("rci_short", "rci_long"), "of price against time over 9 and 26 bars, -100 to 100; beyond 80 either way is extreme"),
    "direction": (("plus_di", "minus_di", "adx"), "shares of moves up and down in the range, and the strength of a trend; from 25 on there is one"),
    "mean groups": (tuple(c for c in COLUMNS if c.startswith("gmma_")), "exponential means of short and long spans; all short above all long is a strong rise"),
    "parabolic stop": (("parabolic",), "stop that follows the price by 0.02 to 0.2; a close above it is a rising trend"),
    "stochastic": (("stoch_k", "stoch_d"), "place of the close in the range of 9 bars, and smoothed over 3; from 80 on high, to 20 low"),
    "deviation": (("deviation_short", "deviation_long"), "percent of the close above the mean of 25 and 75 closes"),
    "psychological line": (("psychological",), "percent of rising days in 12; from 75 on overbought, to 25 oversold"),
    "spread": (("stddev",), "population deviation of 20 closes, in units of the price"),
    "momentum": (("momentum", "momentum_signal"), "close less that of 10 bars before, and its mean of 9; above 0 is a rise"),
}


def described(df: DataFrame) -> DataFrame:
    """The same rows; known columns carry their ``group`` and ``meaning`` as metadata, which goes along into Parquet."""
    of = {c: {"group": g, "meaning": text} for g, (columns, text) in MEANINGS.items() for c in columns}
    for c in df.columns:
        if c in of:
            df = df.withMetadata(c, {**df.schema[c].metadata, **of[c]})
    return df


def meanings(df: DataFrame) -> DataFrame:
    """``column_name, group_name, meaning, n_values``: the described columns of a table and how many values each has, in one pass."""
    known = [f for f in df.schema.fields if "meaning" in f.metadata]
    counted = df.agg(*[F.count(f.name).alias(f.name) for f in known])
    told = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.metadata["group"]).alias("group_name"), F.lit(f.metadata["meaning"]).alias("meaning"), F.col(f.name).alias("n_values")) for f in known])
    return counted.select(F.inline(told))
