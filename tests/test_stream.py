import datetime as dt

import numpy as np
import pandas as pd
import pytest
from barspark.operators import indicators as ind
from barspark.operators.running import Running
from barspark.streaming import derived, ingest

from tests.test_indicators import SCHEMA, frame


def test_bar_by_bar_equals_the_pass_over_a_symbol(spark):
    rng = np.random.default_rng(5)
    close = 500 + np.cumsum(rng.normal(0, 6, 260))
    high, low = close + rng.uniform(0, 4, 260), close - rng.uniform(0, 4, 260)
    for flat in (slice(0, 40), slice(90, 130)):
        close[flat] = high[flat] = low[flat] = close[flat.start]
    bars = frame(close, high, low)
    want = ind.indicators(spark.createDataFrame(bars, SCHEMA), with_frames=False).orderBy("date").toPandas()
    running, got = Running(), []
    for h, lo, c in zip(high, low, close, strict=True):
        got.append(running.add(h, lo, c))
        running = Running.of(running.kept())
    got = pd.DataFrame(got).astype(float)
    for c in ind.RECURSIVE:
        a, b = got[c].to_numpy(), want[c].to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), c
        assert np.nanmax(np.abs(a - b), initial=0) < 1e-6, c


@pytest.fixture
def rocks(spark):
    for k, v in derived.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in derived.STORE:
        spark.conf.unset(k)


def test_tables_follow_the_stream(spark, rocks, tmp_path):
    rng = np.random.default_rng(2)
    folder, bars_at, derived_at = (str(tmp_path / n) for n in ("in", "bars", "derived"))

    def put(*frames):
        made = pd.concat([f if "splits" in f else f.assign(splits=np.nan) for f in frames])
        spark.createDataFrame(made, SCHEMA + ", splits double").coalesce(1).write.mode("append").parquet(folder)

    def run(checkpoint="c"):
        stream = lambda: ingest.bar_stream(spark, folder)
        ingest.keep_merged(stream(), bars_at, str(tmp_path / checkpoint / "b")).awaitTermination()
        derived.keep_derived(stream(), derived_at, str(tmp_path / checkpoint / "d")).awaitTermination()

    def tables():
        read = lambda at: spark.read.parquet(at).toPandas().sort_values(["symbol", "date"], ignore_index=True)
        return read(bars_at), read(derived_at)

    def check(n):
        bars, rows = tables()
        assert len(bars) == len(rows) == n
        fresh = ind.indicators(spark.createDataFrame(bars[["symbol", "date", "open", "high", "low", "close", "volume"]], SCHEMA), with_frames=False).toPandas().sort_values(["symbol", "date"], ignore_index=True)
        for c in ind.RECURSIVE:
            a, b = rows[c].to_numpy(float), fresh[c].to_numpy(float)
            assert (np.isnan(a) == np.isnan(b)).all() and np.nanmax(np.abs(a - b), initial=0) < 1e-6, c
        return bars

    def walk(symbol, n):
        close = 100 + np.cumsum(rng.normal(0, 2, n))
        return frame(close, close + rng.uniform(0, 2, n), close - rng.uniform(0, 2, n), symbol)

    a, b = walk("A", 90), walk("B", 60)
    put(a[:50], b)
    run()
    check(110)
    kept_b = sorted((tmp_path / "derived" / "symbol=B").iterdir())
    put(a[50:80])  # in order: from the state
    run()
    check(140)
    assert sorted((tmp_path / "derived" / "symbol=B").iterdir()) == kept_b
    late = a[20:21].assign(close=a["close"][20] + 5, high=a["high"][20] + 9)
    put(pd.concat([late.assign(close=1.0), late]), a[80:90])  # a correction, twice in one batch, and new bars
    run()
    bars = check(150)
    assert bars.loc[20, "close"] == late["close"].iloc[0]
    before = tables()
    run()  # nothing new
    for x, y in zip(before, tables(), strict=True):
        pd.testing.assert_frame_equal(x, y)
    halved = pd.concat([b, frame([50.0], [51.0], [49.0], "B", b["date"].iloc[-1] + dt.timedelta(days=3))]).assign(splits=0.0)[5:]
    halved["splits"] = np.where(np.arange(len(halved)) == len(halved) - 1, 2.0, 0.0)
    put(halved.assign(open=halved["open"] / 2, high=halved["high"] / 2, low=halved["low"] / 2, close=halved["close"] / 2))
    run()
    bars = check(90 + 56)  # the split's batch is the whole history
    assert bars[bars["symbol"] == "B"]["close"].iloc[0] == pytest.approx(b["close"].iloc[5] / 2)
    put(b[5:6].assign(close=77.0, high=78.0))  # under a new checkpoint all files come again, in their order
    run("c2")
    assert check(90 + 61).query("symbol == 'B'")["close"].iloc[5] == 77.0
