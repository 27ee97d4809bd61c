import math

import numpy as np
import pandas as pd
import pytest
from barspark.operators import indicators as ind
from barspark.operators import signals as sig


def frame(close, high=None, low=None, symbol="X", start="2020-01-01"):
    close = np.asarray(close, dtype=float)
    high = close + 1 if high is None else np.asarray(high, float)
    low = close - 1 if low is None else np.asarray(low, float)
    days = pd.bdate_range(start, periods=len(close)).date
    return pd.DataFrame({"symbol": symbol, "date": days, "open": close, "high": high, "low": low, "close": close, "volume": 1000})


SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume long"


def made(spark, *frames):
    return ind.indicators(spark.createDataFrame(pd.concat(frames), SCHEMA)).orderBy("symbol", "date").toPandas()


def naive_ema(x, n):
    out, y = [], None
    for i, v in enumerate(x):
        y = v if y is None else y + (v - y) * 2 / (n + 1)
        out.append(y if i >= n - 1 else math.nan)
    return out


def naive_wilder(x, n):
    out, run, y = [], [], math.nan
    for v in x:
        if math.isnan(y):
            run = run + [v] if not math.isnan(v) else []
            if len(run) == n:
                y = sum(run) / n
        elif not math.isnan(v):
            y = (y * (n - 1) + v) / n
        out.append(y)
    return out


@pytest.fixture(scope="module")
def random_panel(spark):
    rng = np.random.default_rng(42)
    close = 1000 + np.cumsum(rng.normal(0, 12, 300))
    high, low = close + rng.uniform(0, 10, 300), close - rng.uniform(0, 10, 300)
    high[150] = low[150] = close[150]
    return made(spark, frame(close, high, low))


def same(got, want):
    got, want = np.asarray(got, float), np.asarray(want, float)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.nanmax(np.abs(got - want)) < 1e-6


def test_against_loops(random_panel):
    p = random_panel
    close = p["close"].to_numpy()
    for name, n in (("ema_short", 5), ("ema_long", 75), ("gmma_short_3", 3), ("gmma_long_60", 60)):
        same(p[name], naive_ema(close, n))
    same(p["sma_mid"], [close[i - 24 : i + 1].mean() if i >= 24 else math.nan for i in range(300)])
    same(p["stddev"], [close[i - 19 : i + 1].std() if i >= 19 else math.nan for i in range(300)])
    change = np.diff(close, prepend=math.nan)
    gain, loss = naive_wilder(np.maximum(change, 0), 14), naive_wilder(np.maximum(-change, 0), 14)
    same(p["rsi"], [100 - 100 / (1 + g / x) if not math.isnan(g) else g for g, x in zip(gain, loss, strict=True)])
    h, lo = p["high"].to_numpy(), p["low"].to_numpy()
    span = [math.nan] + [max(h[i] - lo[i], abs(h[i] - close[i - 1]), abs(lo[i] - close[i - 1])) for i in range(1, 300)]
    up, down = np.diff(h, prepend=math.nan), -np.diff(lo, prepend=math.nan)
    plus = [math.nan] + [up[i] if up[i] > max(down[i], 0) else 0.0 for i in range(1, 300)]
    minus = [math.nan] + [down[i] if down[i] > max(up[i], 0) else 0.0 for i in range(1, 300)]
    t, a, b = naive_wilder(span, 14), naive_wilder(plus, 14), naive_wilder(minus, 14)
    pdi, mdi = [x / y * 100 for x, y in zip(a, t, strict=True)], [x / y * 100 for x, y in zip(b, t, strict=True)]
    same(p["plus_di"], pdi)
    same(p["adx"], naive_wilder([abs(x - y) / (x + y) * 100 for x, y in zip(pdi, mdi, strict=True)], 14))


def test_first_rows(random_panel):
    first = {"sma_short": 4, "macd": 25, "macd_signal": 33, "rsi": 14, "ichimoku_tenkan": 8, "ichimoku_kijun": 25, "ichimoku_senkou1": 50, "ichimoku_senkou2": 76,
             "rci_short": 8, "rci_long": 25, "plus_di": 14, "adx": 27, "parabolic": 1, "stoch_k": 8, "stoch_d": 10, "psychological": 12, "momentum": 10, "momentum_signal": 18}
    for name, at in first.items():
        assert random_panel[name].first_valid_index() == at, name
    assert random_panel["ichimoku_chikou"].isna().sum() == 25 and len(ind.COLUMNS) == 43


def test_published_rsi_series():
    close = pd.Series([44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00, 46.03, 46.41, 46.22, 45.64])
    change = close.diff()
    gain, loss = ind.wilder(change.clip(lower=0), 14), ind.wilder((-change).clip(lower=0), 14)
    rsi = 100 * gain / (gain + loss)
    assert rsi.isna().sum() == 14
    assert np.allclose(rsi.iloc[14:], [70.53, 66.32, 66.55, 69.41, 66.36, 57.97], atol=0.1)


def test_wilder_seed_and_carry():
    got = ind.wilder(pd.Series([math.nan, 1, 2, 3, 4, math.nan, 5]), 3)
    same(got, naive_wilder([math.nan, 1, 2, 3, 4, math.nan, 5], 3))
    assert got.iloc[5] == got.iloc[4] == (2 * 2 + 4) / 3


def test_flat_rising_and_short_series(spark):
    p = made(spark, frame([100] * 120, symbol="F"), frame(np.arange(1, 121), symbol="U"), frame([5], symbol="S"), frame([5, 6], symbol="T"))
    flat, up = p[p.symbol == "F"], p[p.symbol == "U"]
    assert (flat["rsi"].dropna() == 50).all() and (up["rsi"].dropna() == 100).all()
    assert (flat["rci_short"].dropna() == 50).all() and np.allclose(up["rci_short"].dropna(), 100)
    assert not np.isinf(p[list(ind.COLUMNS)].to_numpy(float)).any()
    assert p[p.symbol == "S"]["parabolic"].isna().all() and p[p.symbol == "T"]["parabolic"].notna().sum() == 1


def test_rank_correlation_example(spark):
    p = spark.createDataFrame(frame([10, 12, 11, 14, 13]), SCHEMA).withColumn("r", ind.rank_correlation(5)).orderBy("date").toPandas()
    assert p["r"].iloc[-1] == pytest.approx(80)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ind.panel(empty).count() == 0 and sig.cards(ind.indicators(empty)).count() == 0


def test_future_cloud_dates_and_cards_of_a_rise(spark):
    bars = spark.createDataFrame(frame(np.linspace(100, 200, 150)), SCHEMA)
    cloud = ind.future_cloud(bars).orderBy("offset").toPandas()
    assert list(cloud["offset"]) == list(range(1, 26)) and all(d.weekday() < 5 for d in cloud["date"])
    status = {r.card: r.status for r in sig.cards(ind.indicators(bars)).collect()}
    for card in ("sma", "ema", "gmma", "parabolic", "ichimoku"):
        assert status[card] == "bull", card
    assert status["rsi"] == status["rci"] == "bear"


def test_golden_cross_before_dead_cross(spark):
    bars = spark.createDataFrame(frame([100] * 40 + [110] * 20 + [90] * 20), SCHEMA)
    found = [r.signal for r in sig.signals(ind.panel(bars)).orderBy("date", "rule_no").collect() if r.signal in ("GC", "DC")]
    assert found[0] == "GC" and "DC" in found[1:]


def test_one_shuffle_by_symbol(spark, sf):
    from barspark.fixtures import bars

    plan = ind.panel(bars(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= 2 and "CartesianProduct" not in plan
