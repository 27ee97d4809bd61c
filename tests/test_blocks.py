import numpy as np
import pandas as pd
import pytest
from barspark.operators import blocks
from barspark.operators import indicators as ind
from pyspark.sql import functions as F

from tests.test_indicators import SCHEMA, frame, naive_ema


def long_bars(spark):
    rng = np.random.default_rng(3)
    close = 1000 + np.cumsum(rng.normal(0, 9, 700))
    high, low = close + rng.uniform(0, 10, 700), close - rng.uniform(0, 10, 700)
    for flat in (slice(40, 75), slice(150, 200), slice(330, 331)):  # no move for weeks: a range of 0, then values again
        close[flat] = close[flat.start]
        high[flat] = low[flat] = close[flat]
    still = np.full(200, 7.0)
    parts = [frame(close, high, low, "long"), frame(close[:300:2], high[:300:2], low[:300:2], "some"), frame(still, still, still, "still")]
    parts += [frame(close[:n], high[:n], low[:n], f"short{n}") for n in (1, 2, 14, 15, 28, 33)]
    sparse = frame(close[:120], high[:120], low[:120], "sparse").assign(date=[d.date() for d in pd.date_range("1990-01-01", periods=120, freq="47D")])
    return spark.createDataFrame(pd.concat([*parts, sparse]), SCHEMA)


@pytest.mark.parametrize("block", [80, 101, 512])
def test_blocks_equal_the_pass_over_a_symbol(spark, block):
    bars = long_bars(spark)
    order = lambda df: df.orderBy("symbol", "date").toPandas()
    want, got = order(ind.indicators(bars)), order(blocks.indicators(bars.repartition(5), block))
    assert list(got[["symbol", "date"]].itertuples(index=False)) == list(want[["symbol", "date"]].itertuples(index=False))
    for c in ind.COLUMNS:
        a, b = got[c].to_numpy(float), want[c].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), c
        assert np.nanmax(np.abs(a - b), initial=0) < 1e-6, c


def test_no_task_holds_more_than_a_block_and_what_is_beside(spark):
    days = spark.range(0, 20_000, 1, 8).select(F.lit("X").alias("symbol"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (100 + F.sin(F.col("id") / 50)).alias("close"))
    bars = days.select("symbol", "date", F.col("close").alias("open"), (F.col("close") + 1).alias("high"), (F.col("close") - 1).alias("low"), "close", F.lit(1).cast("long").alias("volume"))
    held = blocks.dealt(blocks.numbered(bars), 512).groupBy("symbol").count()
    assert held.agg(F.max("count")).first()[0] <= 512 + blocks.BACK + blocks.AHEAD and held.count() == 40
    got = blocks.indicators(bars, stop=False).select("date", "ema_long", "gmma_short_3", "rsi").orderBy("date").toPandas()
    close = 100 + np.sin(np.arange(20_000) / 50)
    assert np.nanmax(np.abs(got["ema_long"] - naive_ema(close, 75))) < 1e-6 and np.nanmax(np.abs(got["gmma_short_3"] - naive_ema(close, 3))) < 1e-6
    assert blocks.indicators(bars.limit(0)).count() == 0
