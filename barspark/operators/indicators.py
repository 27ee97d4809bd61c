"""The 43 indicators of daily bars, for all symbols in one job.

Frames are window expressions; all of them and the recursive ones share one shuffle by symbol. Recursive ones (exponential
means, Wilder means, stop-and-reverse) are computed by one Arrow pass over each symbol's days in order. Missing is null,
never NaN; a mean over n bars is null until n values are there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

GMMA_SHORT, GMMA_LONG = (3, 5, 8, 10, 12, 15), (30, 35, 40, 45, 50, 60)
SHIFT = 25

#: The output columns in their order.
COLUMNS = (
    "sma_short", "sma_mid", "sma_long", "bb_upper", "bb_mid", "bb_lower", "macd", "macd_signal", "rsi",
    "ichimoku_kijun", "ichimoku_tenkan", "ichimoku_senkou1", "ichimoku_senkou2", "ichimoku_chikou",
    "ema_short", "ema_mid", "ema_long", "rci_short", "rci_long", "plus_di", "minus_di", "adx",
    *(f"gmma_short_{n}" for n in GMMA_SHORT), *(f"gmma_long_{n}" for n in GMMA_LONG), "parabolic",
    "stoch_k", "stoch_d", "deviation_short", "deviation_long", "psychological", "stddev", "momentum", "momentum_signal",
)


def by_date() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def last_rows(n: int) -> WindowSpec:
    return by_date().rowsBetween(1 - n, 0)


def rolling(agg: Column, x: Column, n: int) -> Column:
    """An aggregate of the last n rows, null unless all n have a value."""
    w = last_rows(n)
    return F.when(F.count(x).over(w) == n, agg.over(w))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def sma(x: Column, n: int) -> Column:
    return rolling(F.avg(x), x, n)


def middle(n: int) -> Column:
    high, low = F.col("high"), F.col("low")
    return (rolling(F.max(high), high, n) + rolling(F.min(low), low, n)) / 2


def rank_correlation(n: int) -> Column:
    """Spearman's, of price against time, in percent; ties share the mean rank."""
    prices = F.collect_list("close").over(last_rows(n))

    def squares(a: Column) -> Column:
        def apart(x: Column, i: Column) -> Column:
            above = F.size(F.filter(a, lambda y: y > x))
            equal = F.size(F.filter(a, lambda y: y == x))
            return F.pow((F.lit(n) - i) - (above + (equal + 1) / 2), F.lit(2))

        return F.aggregate(F.transform(a, apart), F.lit(0.0), lambda t, d: t + d)

    value = (1 - 6 * F.element_at(F.transform(F.array(prices), squares), 1) / (n * (n * n - 1))) * 100
    return F.when(F.count("close").over(last_rows(n)) == n, value)


def sma_columns() -> dict[str, Column]:
    close = F.col("close")
    return {"sma_short": sma(close, 5), "sma_mid": sma(close, 25), "sma_long": sma(close, 75)}


def band_columns() -> dict[str, Column]:
    close = F.col("close")
    mid, spread = sma(close, 20), rolling(F.stddev_pop(close), close, 20)
    return {"bb_upper": mid + 2 * spread, "bb_mid": mid, "bb_lower": mid - 2 * spread, "stddev": spread}


def deviation_columns() -> dict[str, Column]:
    close = F.col("close")
    return {k: ratio(close - sma(close, n), sma(close, n)) * 100 for k, n in (("deviation_short", 25), ("deviation_long", 75))}


def frame_stage_one() -> dict[str, Column]:
    """Frames over the bars, and what the second stage needs."""
    close = F.col("close")
    n = 9
    low, high = rolling(F.min("low"), F.col("low"), n), rolling(F.max("high"), F.col("high"), n)
    return sma_columns() | band_columns() | deviation_columns() | {
        "ichimoku_tenkan": middle(9),
        "ichimoku_kijun": middle(26),
        "_cloud2": middle(52),
        "ichimoku_chikou": F.lead("close", SHIFT).over(by_date()),
        "rci_short": rank_correlation(9),
        "rci_long": rank_correlation(26),
        "_k_up": close - low,
        "_k_range": high - low,
        "_rise": (close > F.lag("close").over(by_date())).cast("double"),
        "momentum": close - F.lag("close", 10).over(by_date()),
    }


def day_moves() -> dict[str, Column]:
    """What Wilder's means smooth, from the second bar on: rises, falls, true range, and the larger of the moves beyond
    yesterday's high and low."""
    before = F.lag("close").over(by_date())
    change = F.col("close") - before
    beyond_high = F.col("high") - F.lag("high").over(by_date())
    beyond_low = F.lag("low").over(by_date()) - F.col("low")
    none = F.lit(0.0)

    def larger(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.when((a > b) & (a > none), a).otherwise(none))

    return {
        "_rises": F.when(change.isNotNull(), F.greatest(change, none)),
        "_falls": F.when(change.isNotNull(), F.greatest(-change, none)),
        "_range": F.when(before.isNotNull(), F.greatest("high", before) - F.least("low", before)),
        "_plus": larger(beyond_high, beyond_low),
        "_minus": larger(beyond_low, beyond_high),
    }


def frame_stage_two() -> dict[str, Column]:
    up, width, rise = F.col("_k_up"), F.col("_k_range"), F.col("_rise")
    return {
        "ichimoku_senkou1": F.lag((F.col("ichimoku_tenkan") + F.col("ichimoku_kijun")) / 2, SHIFT).over(by_date()),
        "ichimoku_senkou2": F.lag("_cloud2", SHIFT).over(by_date()),
        "stoch_k": ratio(up, width) * 100,
        "stoch_d": ratio(rolling(F.sum(up), up, 3), rolling(F.sum(width), width, 3)) * 100,
        "psychological": rolling(F.sum(rise), rise, 12) / 12 * 100,
        "momentum_signal": sma(F.col("momentum"), 9),
    }


def frames(bars: DataFrame) -> DataFrame:
    """All indicators that look at a fixed number of bars."""
    one = bars.withColumns(frame_stage_one())
    return one.withColumns(frame_stage_two()).drop("_cloud2", "_k_up", "_k_range", "_rise")


def ema(x: pd.Series, n: int) -> pd.Series:
    """Weight 2 / (n + 1), begun with the first value, the first n - 1 values blank."""
    return x.ewm(span=n, adjust=False, min_periods=n).mean()


def wilder(x: pd.Series, n: int) -> pd.Series:
    """Begun with the mean of the first n values in a row; a missing value later keeps what there was."""
    there = x.notna().to_numpy()
    run = pd.Series(there).astype(int).rolling(n).sum().to_numpy() == n
    if not run.any():
        return pd.Series(np.nan, index=x.index)
    at = int(run.argmax())
    rest = x.iloc[at:].copy()
    rest.iloc[0] = x.iloc[at - n + 1 : at + 1].mean()
    return rest.ewm(alpha=1 / n, adjust=False, ignore_na=True).mean().reindex(x.index)


def stop_and_reverse(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """The parabolic stop of each bar; the first has none."""
    n = len(high)
    out = np.full(n, np.nan)
    if n < 2:
        return out
    rising = high[1] + low[1] >= high[0] + low[0]
    stop, extreme, pace = (low[0], high[0], step) if rising else (high[0], low[0], step)
    for i in range(1, n):
        behind = (low if rising else high)[max(0, i - 2) : i]
        stop += pace * (extreme - stop)
        stop = min(stop, *behind) if rising else max(stop, *behind)
        crossed = low[i] < stop if rising else high[i] > stop
        reached = high[i] if rising else low[i]
        if crossed:
            rising, stop, pace = not rising, extreme, step
            extreme = high[i] if rising else low[i]
        elif reached > extreme if rising else reached < extreme:
            extreme, pace = reached, min(pace + step, most)
        out[i] = stop
    return out


RECURSIVE = tuple(
    c for c in COLUMNS if c.startswith(("ema_", "gmma_", "macd")) or c in ("rsi", "plus_di", "minus_di", "adx", "parabolic")
)


def _recursive(days: pd.DataFrame) -> pd.DataFrame:
    close = days["close"]
    spans = {"ema_short": 5, "ema_mid": 25, "ema_long": 75} | {f"gmma_short_{n}": n for n in GMMA_SHORT} | {f"gmma_long_{n}": n for n in GMMA_LONG}
    out = {name: ema(close, n) for name, n in spans.items()}
    out["macd"] = ema(close, 12) - ema(close, 26)
    out["macd_signal"] = ema(out["macd"].dropna(), 9).reindex(close.index)
    gain, loss, width, plus, minus = (wilder(days[c], 14) for c in ("_rises", "_falls", "_range", "_plus", "_minus"))
    strength = 100 * gain / (gain + loss).replace(0, np.nan)  # the same as 100 - 100 / (1 + gain / loss)
    out["rsi"] = strength.mask((gain == 0) & (loss == 0), 50.0)
    width = width.replace(0, np.nan)
    out["plus_di"], out["minus_di"] = 100 * plus / width, 100 * minus / width
    apart, both = (plus - minus).abs() / width, ((plus + minus) / width).replace(0, np.nan)
    out["adx"] = wilder(100 * apart / both, 14)
    out["parabolic"] = pd.Series(stop_and_reverse(days["high"].to_numpy(), days["low"].to_numpy()), index=close.index)
    return pd.DataFrame(out)


def indicators(bars: DataFrame, with_frames: bool = True) -> DataFrame:
    """Bars with the indicators: the recursive ones, and the others before them on the same partitioning."""
    wide = frames(bars) if with_frames else bars
    given, moves = wide.columns, day_moves()
    smoothed = list(moves)
    schema = T.StructType(list(wide.schema) + [T.StructField(c, T.DoubleType()) for c in RECURSIVE])

    def symbol(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("date", ignore_index=True)
        days[smoothed] = days[smoothed].astype("float64")
        found = pd.concat([days[given], _recursive(days)], axis=1)
        return found.astype({c: "float64" for c in RECURSIVE})[[*given, *RECURSIVE]]

    out = wide.withColumns(moves).groupBy("symbol").applyInPandas(symbol, schema)
    blank = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in RECURSIVE]
    return out.select(*given, *blank)


def panel(bars: DataFrame) -> DataFrame:
    """``symbol, date`` and the 43 columns in their order."""
    return indicators(bars).select("symbol", "date", *COLUMNS)


def future_cloud(bars: DataFrame) -> DataFrame:
    """The leading spans beyond the last bar, by offset, with the weekdays they fall on."""
    one = bars.withColumns({"t": middle(9), "k": middle(26), "senkou2": middle(52)})
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    last = one.select(
        "symbol", "date", ((F.col("t") + F.col("k")) / 2).alias("senkou1"), "senkou2",
        F.row_number().over(back).alias("n"), F.max("date").over(Window.partitionBy("symbol")).alias("end"),
    ).where(F.col("n") <= SHIFT)
    offset = (F.least(F.lit(SHIFT), F.count("*").over(Window.partitionBy("symbol"))) + 1 - F.col("n")).cast("int")
    ahead = F.filter(F.sequence(F.date_add("end", 1), F.date_add("end", 2 * SHIFT)), lambda d: F.weekday(d) < 5)
    return last.withColumn("offset", offset).select(
        "symbol", "offset", F.element_at(ahead, F.col("offset")).alias("date"), "senkou1", "senkou2"
    )


def quote(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol, with the change against the close before."""
    before = F.lag("close").over(by_date())
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    base = F.nullif(F.col("before"), F.lit(0.0))
    return (
        bars.withColumn("before", before)
        .withColumn("n", F.row_number().over(back))
        .where("n = 1")
        .select("symbol", "date", "open", "high", "low", "close", "volume", (F.col("close") - base).alias("change"), ((F.col("close") - base) / base * 100).alias("change_pct"))
    )
