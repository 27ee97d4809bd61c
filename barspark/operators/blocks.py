"""The indicators of long series: a symbol's bars are dealt to blocks, so that no task holds a whole symbol.

A bar gets its place in its symbol from counts of calendar spans. Each block of places also holds the bars before and behind it
that frames reach to. Exponential and Wilder means are affine maps ``y -> r^d (y + s)`` within a block, ``d`` the steps and ``s`` a
running sum; a pass over the blocks' maps, a row a block, carries each symbol's value into its next block. Means of
means (the MACD's signal, ADX) take a second such pass. Only the parabolic stop, which is no such map, is one pass over a symbol,
of four columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from . import indicators as ind

#: Bars of a block (powers of the steepest mean's rate to that number stay finite), and bars that frames reach back and ahead.
BLOCK, BACK, AHEAD = 512, 80, ind.SHIFT
#: Days of a calendar span.
SPAN = 512


def numbered(bars: DataFrame) -> DataFrame:
    """``place``: how many bars of its symbol are before each. Symbols and dates are there, a date once a symbol."""
    spans = bars.withColumn("_span", F.floor(F.unix_date("date") / SPAN))
    counts = spans.groupBy("symbol", "_span").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("symbol").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("symbol", "_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("symbol", "_span").orderBy("date")) - 1
    return spans.withColumn("_nth", nth).join(before, ["symbol", "_span"]).withColumn("place", F.col("_before") + F.col("_nth")).drop("_span", "_nth", "_before")


def dealt(placed: DataFrame, block: int) -> DataFrame:
    """Each bar in its block and where frames reach it from the blocks beside; ``symbol`` is the pair of symbol and block."""
    own, at = F.floor(F.col("place") / block), F.col("place") % block
    to = F.array(
        F.struct(own.alias("block"), F.lit(True).alias("own")),
        F.when(at >= block - BACK, F.struct((own + 1).alias("block"), F.lit(False).alias("own"))),
        F.when((at < AHEAD) & (own > 0), F.struct((own - 1).alias("block"), F.lit(False).alias("own"))),
    )
    each = placed.withColumn("_to", F.explode(F.array_compact(to)))
    return each.withColumns({"symbol": F.struct("symbol", F.col("_to.block").alias("block")), "_own": F.col("_to.own")}).drop("_to")


@dataclass(frozen=True)
class Mean:
    """``x``: what is smoothed, null where there is nothing; ``steps``: whether a value lets what was before fade; ``first``: the
    weight of values that don't; ``shown``: where the mean is there."""

    x: Column
    steps: Column
    weight: float
    first: float
    shown: Column


def ema(x: Column, n: int, begin: int = 0) -> Mean:
    """Begun with the value at place ``begin``; blank for its first n - 1 values."""
    place = F.col("place")
    return Mean(F.when(place >= begin, x), place > begin, 2 / (n + 1), 1.0, place >= begin + n - 1)


def wilder(x: Column, n: int, at: Column | int) -> Mean:
    """Begun at the place ``at`` with the mean of the n values up to it; a missing value later changes nothing."""
    place = F.col("place")
    return Mean(F.when(place > at - n, x), (place > at) & x.isNotNull(), 1 / n, 1 / n, place >= at)


def carried(ends: DataFrame, schema: str, fold: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A pass over each symbol's blocks in order; a row a block, or one a symbol."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        return fold(blocks.sort_values("block", ignore_index=True))

    return ends.select("symbol.symbol", "symbol.block", *[c for c in ends.columns if c != "symbol"]).groupBy("symbol").applyInPandas(run, schema)


def smoothed(rows: DataFrame, means: dict[str, Mean]) -> DataFrame:
    """``rows`` of blocks (``symbol`` and block, ``date``, ``place``) with the means."""
    upto = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    steps = rows.withColumns({f"_d_{k}": F.sum(m.steps.cast("int")).over(upto) for k, m in means.items()})
    rate = {k: F.lit(1 - m.weight) for k, m in means.items()}
    term = {k: F.coalesce(m.x * F.when(m.steps, m.weight).otherwise(m.first) * F.pow(rate[k], -F.col(f"_d_{k}")), F.lit(0.0)) for k, m in means.items()}
    sums = stored(steps.withColumns({f"_s_{k}": F.sum(term[k]).over(upto) for k in means}), "sums")  # the maps and what they are for both read it
    fade = {k: F.pow(rate[k], F.col(f"_d_{k}")) for k in means}
    last = F.max_by(F.struct(*[c for k in means for c in (fade[k].alias(f"a_{k}"), (fade[k] * F.col(f"_s_{k}")).alias(f"b_{k}"))]), "date")
    ends = sums.groupBy("symbol").agg(last.alias("map")).select("symbol", "map.*")

    names = list(means)

    def fold(blocks: pd.DataFrame) -> pd.DataFrame:
        out = blocks[["symbol", "block"]].copy()
        for k in names:
            y, begin = 0.0, []
            for a, b in zip(blocks[f"a_{k}"], blocks[f"b_{k}"], strict=True):
                begin.append(y)
                y = a * y + b
            out[f"y_{k}"] = begin
        return out

    kind = rows.schema["symbol"].dataType["symbol"].dataType.simpleString()
    begins = carried(ends, f"symbol {kind}, block long, " + ", ".join(f"y_{k} double" for k in means), fold)
    begins = begins.select(F.struct("symbol", "block").alias("symbol"), *[f"y_{k}" for k in means])
    both = sums.join(begins, "symbol")
    made = {k: F.when(m.shown, fade[k] * (F.col(f"y_{k}") + F.col(f"_s_{k}"))) for k, m in means.items()}
    return both.withColumns(made).drop(*[f"{p}_{k}" for p in ("_d", "_s", "y") for k in means])


def first_runs(rows: DataFrame, x: str, n: int) -> DataFrame:
    """``of, at``: the place where each symbol first has n values in a row; symbols that never do aren't there."""
    upto = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.when(F.col(x).isNull(), F.col("place"))
    begin = F.min("place").over(upto)
    run = rows.select("symbol", "place", gap.alias("gap"), (F.col("place") - F.coalesce(F.max(gap).over(upto), begin - 1)).alias("run"))
    ends = run.groupBy("symbol").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.min("gap").alias("gap"), F.max("gap").alias("last_gap"), F.min(F.when(F.col("run") >= n, F.col("place"))).alias("inside"))

    def fold(blocks: pd.DataFrame) -> pd.DataFrame:
        held = 0
        for b in blocks.itertuples():
            whole = pd.isna(b.gap)
            ahead = b.last - b.first + 1 if whole else b.gap - b.first
            found = [b.first + n - held - 1] if ahead and held + ahead >= n else []
            found += [] if pd.isna(b.inside) else [b.inside]
            if found:
                return pd.DataFrame({"of": [b.symbol], "at": [int(min(found))]})
            held = held + ahead if whole else b.last - b.last_gap
        return pd.DataFrame({"of": blocks["symbol"][:0], "at": blocks["first"][:0]})

    kind = rows.schema["symbol"].dataType["symbol"].dataType.simpleString()
    return carried(ends, f"of {kind}, at long", fold)


def _with_stop(bars: DataFrame) -> DataFrame:
    def symbol(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("date", ignore_index=True)
        stop = ind.stop_and_reverse(days["high"].to_numpy(), days["low"].to_numpy())
        return pd.DataFrame({"symbol": days["symbol"], "date": days["date"], "parabolic": stop})

    kind = bars.schema["symbol"].dataType.simpleString()
    stops = bars.select("symbol", "date", "high", "low").groupBy("symbol").applyInPandas(symbol, f"symbol {kind}, date date, parabolic double")
    return stops.withColumn("parabolic", F.nanvl("parabolic", F.lit(None).cast("double")))


def indicators(bars: DataFrame, block: int = BLOCK, stop: bool = True) -> DataFrame:
    """The bars with the columns of ``indicators.indicators``, ``parabolic`` only if ``stop``. Frames reach back 80 bars, so a block
    has that many at least. A symbol of few bars is one block; an empty table gives none."""
    if block < BACK:
        raise ValueError(f"a block holds {BACK} bars at least")
    n = 14
    moves = ind.day_moves()
    wide = ind.frames(dealt(numbered(bars), block)).withColumns(moves).where("_own").drop("_own")
    close = F.col("close")
    spans = {"ema_short": 5, "ema_mid": 25, "ema_long": 75} | {f"gmma_short_{k}": k for k in ind.GMMA_SHORT} | {f"gmma_long_{k}": k for k in ind.GMMA_LONG}
    means = {k: ema(close, s) for k, s in (spans | {"_fast": 12, "_slow": 26}).items()}
    means |= {f"_mean{c}": wilder(F.col(c), n, n) for c in moves}
    one = smoothed(wide, means)
    gain, loss, width, plus, minus = (F.col(f"_mean{c}") for c in moves)
    width = F.nullif(width, F.lit(0.0))
    one = one.withColumns({
        "macd": F.col("_fast") - F.col("_slow"),
        "rsi": F.when((gain == 0) & (loss == 0), 50.0).otherwise(100 * gain / F.nullif(gain + loss, F.lit(0.0))),
        "plus_di": 100 * plus / width,
        "minus_di": 100 * minus / width,
        "_dx": 100 * (F.abs(plus - minus) / width) / F.nullif((plus + minus) / width, F.lit(0.0)),
    })
    runs = first_runs(one, "_dx", n)
    two = one.join(runs, F.col("symbol.symbol") == F.col("of"), "left")
    two = smoothed(two, {"macd_signal": ema(F.col("macd"), 9, 25), "adx": wilder(F.col("_dx"), n, F.col("at"))})
    out = two.withColumn("symbol", F.col("symbol.symbol"))
    if stop:
        out = out.join(_with_stop(bars), ["symbol", "date"])
    return out.select(*bars.columns, *[c for c in ind.COLUMNS if stop or c != "parabolic"])
