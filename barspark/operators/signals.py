"""Cross signals and verdicts on the last bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import GMMA_LONG, GMMA_SHORT, by_date


def _cross(a: str, b: str | float) -> tuple[Column, Column]:
    diff = F.col(a) - (F.col(b) if isinstance(b, str) else F.lit(b))
    before = F.lag(diff).over(by_date())
    return (before <= 0) & (diff > 0), (before >= 0) & (diff < 0)


def signals(panel: DataFrame) -> DataFrame:
    """``symbol, date, rule_no, signal``: moving-average and MACD crosses, RSI leaving 30 and 70."""
    golden, dead = _cross("sma_short", "sma_mid")
    up, down = _cross("macd", "macd_signal")
    before = F.lag("rsi").over(by_date())
    rules = (
        ("GC", golden), ("DC", dead), ("M+", up), ("M-", down),
        ("R30", (before < 30) & (F.col("rsi") >= 30)), ("R70", (before > 70) & (F.col("rsi") <= 70)),
    )
    marks = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("rule_no"), F.lit(k).alias("signal"))) for i, (k, c) in enumerate(rules, 1)])
    found = panel.select("symbol", "date", F.array_compact(marks).alias("m"))
    return found.select("symbol", "date", F.explode("m").alias("m")).select("symbol", "date", "m.rule_no", "m.signal")


def last_signals(found: DataFrame, n: int = 12) -> DataFrame:
    """The last n of each symbol, newest first; of one day the later rule first."""
    order = Window.partitionBy("symbol").orderBy(F.desc("date"), F.desc("rule_no"))
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def within_last(found: DataFrame, rows: DataFrame, days: int) -> DataFrame:
    """The signals from the first to the last of each symbol's last ``days`` rows."""
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    shown = rows.select("symbol", "date").withColumn("n", F.row_number().over(back)).where(F.col("n") <= days)
    spans = shown.groupBy("symbol").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return found.join(spans, "symbol").where("date between start and end").drop("start", "end")


def _status(bull: Column, bear: Column) -> Column:
    return F.when(bull, "bull").when(bear, "bear").otherwise("neutral")


#: The texts of the notes; numbers go where %s stands.
NOTES = {
    "short_of_data": "データ不足（75日分必要）", "rising": "短期 > 中期 > 長期（5/25/75）上昇トレンド", "falling": "短期 < 中期 < 長期（5/25/75）下降トレンド", "crossed": "短期・中期・長期が交錯（5/25/75）",
    "macd_up": "MACD がシグナル（%s）より上", "macd_down": "MACD がシグナル（%s）より下",
    "over_cloud": "株価が雲の上", "under_cloud": "株価が雲の下", "in_cloud": "株価が雲の中", "turn_up": "・転換線 > 基準線", "turn_down": "・転換線 ≦ 基準線",
    "strong": "強いトレンド", "weak": "トレンド弱い", "adx_up": "%s・上昇優勢（+DI %s / -DI %s）", "adx_down": "%s・下降優勢（+DI %s / -DI %s）",
    "gmma_up": "最短群がすべて最長群の上", "gmma_down": "最短群がすべて最長群の下", "gmma_mixed": "最短群と最長群が交錯",
    "sar_up": "株価が SAR より上（上昇トレンド）", "sar_down": "株価が SAR より下（下降トレンド）",
    "far_up_10": "上方乖離が大きい（+10%以上）", "far_down_10": "下方乖離が大きい（-10%以下）", "far_up_20": "上方乖離が大きい（+20%以上）", "far_down_20": "下方乖離が大きい（-20%以下）", "normal": "通常範囲",
    "bought_70": "買われすぎ（70以上）", "sold_30": "売られすぎ（30以下）", "bought_75": "買われすぎ（75%以上）", "sold_25": "売られすぎ（25%以下）", "middle": "中立圏",
    "rci_high": "高値圏（+80以上）（長期 %s）", "rci_low": "底値圏（-80以下）（長期 %s）", "rci_middle": "中立圏（長期 %s）",
    "stoch_high": "高値圏（80以上）（%%D %s）", "stoch_low": "安値圏（20以下）（%%D %s）", "stoch_middle": "中立圏（%%D %s）",
    "momentum_up": "0より上でシグナルを上回る", "momentum_down": "0より下でシグナルを下回る", "momentum_signal": "シグナル %s",
    "sigma_up": "+2σ 以上", "sigma_down": "-2σ 以下", "sigma_in": "±2σ の範囲内（%s 〜 %s）", "of_close": "終値比 %s%%",
}
#: The order of categories, and the cards that are shown first in theirs.
CATEGORIES, PRIMARY = ("trend", "oscillator", "volatility"), ("sma", "macd", "ichimoku", "rsi", "bb")


def _number(x: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", x)


def _note(name: str, *values: Column) -> Column:
    return F.format_string(NOTES[name], *values) if values else F.lit(NOTES[name])


def _noted(status: Column, bull: Column, bear: Column, neutral: Column) -> Column:
    return F.when(status == "bull", bull).when(status == "bear", bear).when(status == "neutral", neutral)


def cards(bars_with_panel: DataFrame) -> DataFrame:
    """``symbol, card_no, card, card_group, value, status, note``: verdicts on the last bar in their fixed order; only the two
    moving-average cards are given, as ``na``, when their values are missing."""
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    last = bars_with_panel.withColumn("n", F.row_number().over(back)).where("n = 1")
    c, none = F.col, F.lit(None).cast("double")

    def means(p: str) -> tuple[Column, Column, Column]:
        s, m, lo = c(f"{p}_short"), c(f"{p}_mid"), c(f"{p}_long")
        status = F.when(s.isNull() | m.isNull() | lo.isNull(), "na").otherwise(_status((s > m) & (m > lo), (s < m) & (m < lo)))
        return m, status, F.coalesce(_noted(status, _note("rising"), _note("falling"), _note("crossed")), _note("short_of_data"))

    def bounded(name: str, high: float, low: float, texts: tuple[str, str, str], needs: str | None = None) -> tuple[Column, Column, Column]:
        there = c(name).isNotNull() & c(needs or name).isNotNull()
        more = [_number(c(needs), 1)] if needs else []
        status = F.when(there, _status(c(name) <= low, c(name) >= high))
        over, under, between = (_note(t, *more) for t in texts)
        return c(name), status, _noted(status, under, over, between)

    macd = F.when(c("macd").isNotNull() & c("macd_signal").isNotNull(), F.when(c("macd") > c("macd_signal"), "bull").otherwise("bear"))
    signal = _number(c("macd_signal"), 2)
    top, bottom = F.greatest("ichimoku_senkou1", "ichimoku_senkou2"), F.least("ichimoku_senkou1", "ichimoku_senkou2")
    cloud = F.when(c("ichimoku_senkou1").isNotNull() & c("ichimoku_senkou2").isNotNull(), _status(c("close") > top, c("close") < bottom))
    turn = F.when(c("ichimoku_tenkan") > c("ichimoku_kijun"), NOTES["turn_up"]).when(c("ichimoku_tenkan") <= c("ichimoku_kijun"), NOTES["turn_down"]).otherwise("")
    over_cloud = F.concat(_noted(cloud, _note("over_cloud"), _note("under_cloud"), _note("in_cloud")), turn)
    directed = c("plus_di").isNotNull() & c("minus_di").isNotNull() & c("adx").isNotNull()
    strong, up = c("adx") >= 25, c("plus_di") > c("minus_di")
    force = [F.when(strong, NOTES["strong"]).otherwise(NOTES["weak"]), _number(c("plus_di"), 1), _number(c("minus_di"), 1)]
    adx = F.when(directed, F.when(~strong, "neutral").when(up, "bull").otherwise("bear"))
    short, long_ = F.array(*[c(f"gmma_short_{n}") for n in GMMA_SHORT]), F.array(*[c(f"gmma_long_{n}") for n in GMMA_LONG])
    whole = ~(F.exists(short, lambda x: x.isNull()) | F.exists(long_, lambda x: x.isNull()))
    gmma = F.when(whole, _status(F.array_min(short) > F.array_max(long_), F.array_max(short) < F.array_min(long_)))
    sar = F.when(c("parabolic").isNotNull(), F.when(c("close") > c("parabolic"), "bull").otherwise("bear"))
    moving = c("momentum").isNotNull() & c("momentum_signal").isNotNull()
    momentum = F.when(moving, _status((c("momentum") > 0) & (c("momentum") > c("momentum_signal")), (c("momentum") < 0) & (c("momentum") < c("momentum_signal"))))
    band = F.when(c("bb_upper").isNotNull() & c("bb_lower").isNotNull(), F.when(c("close") >= c("bb_upper"), "bear").when(c("close") <= c("bb_lower"), "bull").otherwise("neutral"))
    inside = _note("sigma_in", _number(c("bb_lower"), 1), _number(c("bb_upper"), 1))
    spread = _note("of_close", _number(c("stddev") / F.nullif(c("close"), F.lit(0.0)) * 100, 2))
    verdicts = (
        ("sma", "trend", *means("sma")), ("ema", "trend", *means("ema")),
        ("macd", "trend", c("macd"), macd, _noted(macd, _note("macd_up", signal), _note("macd_down", signal), F.lit(None))),
        ("ichimoku", "trend", c("ichimoku_kijun"), cloud, over_cloud),
        ("adx", "trend", c("adx"), adx, F.when(up, _note("adx_up", *force)).otherwise(_note("adx_down", *force))),
        ("gmma", "trend", none, gmma, _noted(gmma, _note("gmma_up"), _note("gmma_down"), _note("gmma_mixed"))),
        ("parabolic", "trend", c("parabolic"), sar, _noted(sar, _note("sar_up"), _note("sar_down"), F.lit(None))),
        ("deviation_short", "trend", *bounded("deviation_short", 10, -10, ("far_up_10", "far_down_10", "normal"))),
        ("deviation_long", "trend", *bounded("deviation_long", 20, -20, ("far_up_20", "far_down_20", "normal"))),
        ("rsi", "oscillator", *bounded("rsi", 70, 30, ("bought_70", "sold_30", "middle"))),
        ("rci", "oscillator", *bounded("rci_short", 80, -80, ("rci_high", "rci_low", "rci_middle"), "rci_long")),
        ("stoch", "oscillator", *bounded("stoch_k", 80, 20, ("stoch_high", "stoch_low", "stoch_middle"), "stoch_d")),
        ("psychological", "oscillator", *bounded("psychological", 75, 25, ("bought_75", "sold_25", "middle"))),
        ("momentum", "oscillator", c("momentum"), momentum, _noted(momentum, _note("momentum_up"), _note("momentum_down"), _note("momentum_signal", _number(c("momentum_signal"), 2)))),
        ("bb", "volatility", c("bb_mid"), band, _noted(band, _note("sigma_down"), _note("sigma_up"), inside)),
        ("stddev", "volatility", c("stddev"), F.when(c("stddev").isNotNull(), "neutral"), spread),
    )
    rows = F.array(*[
        F.struct(F.lit(i).alias("card_no"), F.lit(k).alias("card"), F.lit(g).alias("card_group"), v.cast("double").alias("value"), s.alias("status"), n.alias("note"))
        for i, (k, g, v, s, n) in enumerate(verdicts, 1)
    ])
    flat = last.select("symbol", F.explode(rows).alias("x")).select("symbol", "x.*")
    return flat.where(F.col("status").isNotNull())


def by_category(found: DataFrame) -> DataFrame:
    """Cards with the place of their category and ``is_primary``: the named ones, or the first of a category that has none of them."""
    whole = Window.partitionBy("symbol", "card_group")
    named = F.col("card").isin(*PRIMARY)
    promoted = ~F.bool_or(named).over(whole) & (F.col("card_no") == F.min("card_no").over(whole))
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("card_group")).cast("int")
    return found.withColumns({"category_no": place, "is_primary": named | promoted})


def badge(found: DataFrame) -> DataFrame:
    """The majority of a symbol's cards."""
    n = F.count_if(F.col("status") == "bull") - F.count_if(F.col("status") == "bear")
    return found.groupBy("symbol").agg(n.cast("long").alias("balance")).withColumn(
        "verdict", F.when(F.col("balance") > 0, "bull").when(F.col("balance") < 0, "bear").otherwise("neutral")
    )
