"""Queries over daily bars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import BARS, bars
from ..operators import blocks
from ..operators import indicators as ind
from ..operators import signals as sig

KEYS = ("symbol", "date")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Keys and columns, doubles at four decimals (no negative zero)."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(F.col(c), 4) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def r4(*names: str) -> str:
    return ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)


# ---- SQL building blocks -------------------------------------------------------------------------------------------
SERIES = BARS + """,
s AS (SELECT *, row_number() OVER w AS rn, lag("close") OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY "date"))"""


def _avg(x: str, n: int, agg: str = "avg") -> str:
    w = f'(PARTITION BY symbol ORDER BY "date" ROWS {n - 1} PRECEDING)'
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END"


def _mid(n: int) -> str:
    w = f'(PARTITION BY symbol ORDER BY "date" ROWS {n - 1} PRECEDING)'
    return f"CASE WHEN rn >= {n} THEN (max(high) OVER {w} + min(low) OVER {w}) / 2 END"


def _rci(n: int) -> str:
    return f"""rci{n} AS (
  SELECT symbol, rn, (1 - 6 * sum(d * d) / ({n} * ({n} * {n} - 1.0))) * 100 AS v FROM (
    SELECT a.symbol, a.rn, (a.rn - b.rn + 1) - (count(*) FILTER (c."close" > b."close") + (count(*) FILTER (c."close" = b."close") + 1) / 2.0) AS d
    FROM s a JOIN s b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - {n - 1} AND a.rn
      JOIN s c ON a.symbol = c.symbol AND c.rn BETWEEN a.rn - {n - 1} AND a.rn
    WHERE a.rn >= {n} GROUP BY a.symbol, a.rn, b.rn) GROUP BY 1, 2)"""


FRAMES = SERIES + f""",
f1 AS (SELECT *, {_avg('"close"', 5)} AS sma_short, {_avg('"close"', 25)} AS sma_mid, {_avg('"close"', 75)} AS sma_long,
    {_avg('"close"', 20)} AS bb_mid, {_avg('"close"', 20, "stddev_pop")} AS stddev, {_mid(9)} AS ichimoku_tenkan, {_mid(26)} AS ichimoku_kijun,
    {_mid(52)} AS cloud2, lead("close", 25) OVER (PARTITION BY symbol ORDER BY "date") AS ichimoku_chikou,
    "close" - {_avg("low", 9, "min")} AS k_up, {_avg("high", 9, "max")} - {_avg("low", 9, "min")} AS k_range,
    CASE WHEN pc IS NOT NULL THEN CAST("close" > pc AS INT) END AS rise, "close" - lag("close", 10) OVER (PARTITION BY symbol ORDER BY "date") AS momentum
  FROM s),
{_rci(9)},
{_rci(26)},
f2 AS (SELECT f1.*, bb_mid + 2 * stddev AS bb_upper, bb_mid - 2 * stddev AS bb_lower,
    lag((ichimoku_tenkan + ichimoku_kijun) / 2, 25) OVER w AS ichimoku_senkou1, lag(cloud2, 25) OVER w AS ichimoku_senkou2,
    k_up / nullif(k_range, 0) * 100 AS stoch_k, {_avg("k_up", 3, "sum")} / nullif({_avg("k_range", 3, "sum")}, 0) * 100 AS stoch_d,
    ("close" - sma_mid) / nullif(sma_mid, 0) * 100 AS deviation_short, ("close" - sma_long) / nullif(sma_long, 0) * 100 AS deviation_long,
    {_avg("rise", 12, "sum")} / 12.0 * 100 AS psychological, {_avg("momentum", 9)} AS momentum_signal
  FROM f1 WINDOW w AS (PARTITION BY symbol ORDER BY "date")),
frames AS (SELECT f2.*, rci9.v AS rci_short, rci26.v AS rci_long FROM f2 LEFT JOIN rci9 USING (symbol, rn) LEFT JOIN rci26 USING (symbol, rn))"""

_SPANS = {"ema_short": 5, "ema_mid": 25, "ema_long": 75, "e12": 12, "e26": 26} | {f"gmma_short_{n}": n for n in ind.GMMA_SHORT} | {f"gmma_long_{n}": n for n in ind.GMMA_LONG}

EMAS = f"""e AS (
  SELECT symbol, rn, {", ".join(f'"close" AS {k}' for k in _SPANS)} FROM s WHERE rn = 1
  UNION ALL SELECT s.symbol, s.rn, {", ".join(f'e.{k} + (s."close" - e.{k}) * 2.0 / {n + 1}' for k, n in _SPANS.items())}
  FROM e JOIN s ON s.symbol = e.symbol AND s.rn = e.rn + 1),
ema AS (SELECT symbol, rn, {", ".join(f"CASE WHEN rn >= {n} THEN {k} END AS {k}" for k, n in _SPANS.items())} FROM e),
md AS (SELECT symbol, rn, e12 - e26 AS macd FROM ema),
ms AS (SELECT symbol, rn, macd AS v FROM md WHERE rn = 26
  UNION ALL SELECT md.symbol, md.rn, ms.v + (md.macd - ms.v) * 0.2 FROM ms JOIN md ON md.symbol = ms.symbol AND md.rn = ms.rn + 1),
macd AS (SELECT md.symbol, md.rn, macd, CASE WHEN md.rn >= 34 THEN ms.v END AS macd_signal FROM md LEFT JOIN ms USING (symbol, rn))"""

WILDER = """mv AS (SELECT symbol, rn, greatest("close" - pc, 0) AS up, greatest(pc - "close", 0) AS dn, greatest(high, pc) - least(low, pc) AS tr,
    CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS mdm
  FROM s WHERE rn >= 2),
wl AS (
  SELECT symbol, CAST(15 AS BIGINT) AS rn, avg(up) AS up, avg(dn) AS dn, avg(tr) AS tr, avg(pdm) AS pdm, avg(mdm) AS mdm FROM mv WHERE rn <= 15 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT mv.symbol, mv.rn, (wl.up * 13 + mv.up) / 14, (wl.dn * 13 + mv.dn) / 14, (wl.tr * 13 + mv.tr) / 14, (wl.pdm * 13 + mv.pdm) / 14, (wl.mdm * 13 + mv.mdm) / 14
  FROM wl JOIN mv ON mv.symbol = wl.symbol AND mv.rn = wl.rn + 1),
di AS (SELECT symbol, rn, CASE WHEN up + dn = 0 THEN 50 ELSE 100 * up / (up + dn) END AS rsi, pdm / nullif(tr, 0) * 100 AS plus_di, mdm / nullif(tr, 0) * 100 AS minus_di,
    abs(pdm - mdm) / nullif(pdm + mdm, 0) * 100 AS dx FROM wl),
ax AS (
  SELECT symbol, CAST(28 AS BIGINT) AS rn, avg(dx) AS v FROM di WHERE rn <= 28 GROUP BY symbol HAVING count(dx) = 14
  UNION ALL SELECT di.symbol, di.rn, CASE WHEN dx IS NULL THEN v ELSE (v * 13 + dx) / 14 END FROM ax JOIN di ON di.symbol = ax.symbol AND di.rn = ax.rn + 1),
dmi AS (SELECT di.*, ax.v AS adx FROM di LEFT JOIN ax USING (symbol, rn))"""

SAR = """b2 AS (SELECT symbol, rn, high AS h, low AS l, ph AS h1, pl AS l1, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2
  FROM s WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
sr AS (
  SELECT a.symbol, a.rn, (b.h + b.l >= a.h + a.l) AS up, CASE WHEN b.h + b.l >= a.h + a.l THEN a.l ELSE a.h END AS sar,
    CASE WHEN b.h + b.l >= a.h + a.l THEN a.h ELSE a.l END AS ep, CAST(0.02 AS DOUBLE) AS af FROM b2 a JOIN b2 b ON b.symbol = a.symbol AND b.rn = 2 WHERE a.rn = 1
  UNION ALL
  SELECT symbol, rn, CASE WHEN turn THEN NOT up ELSE up END, CASE WHEN turn THEN ep ELSE t END,
    CASE WHEN turn THEN CASE WHEN up THEN l ELSE h END WHEN up AND h > ep THEN h WHEN NOT up AND l < ep THEN l ELSE ep END,
    CASE WHEN turn THEN 0.02 WHEN (up AND h > ep) OR (NOT up AND l < ep) THEN least(af + 0.02, 0.2) ELSE af END
  FROM (SELECT *, CASE WHEN up THEN l < t ELSE h > t END AS turn FROM (
    SELECT b2.symbol, b2.rn, h, l, up, ep, af, CASE WHEN up THEN least(sar + af * (ep - sar), l1, coalesce(l2, l1)) ELSE greatest(sar + af * (ep - sar), h1, coalesce(h2, h1)) END AS t
    FROM sr JOIN b2 ON b2.symbol = sr.symbol AND b2.rn = sr.rn + 1))),
psar AS (SELECT symbol, rn, CASE WHEN rn >= 2 THEN sar END AS parabolic FROM sr)"""

PANEL = f"""{FRAMES},
{EMAS},
{WILDER},
{SAR},
panel AS (SELECT frames.*, {", ".join(k for k in _SPANS if k not in ("e12", "e26"))}, macd, macd_signal, rsi, plus_di, minus_di, adx, parabolic
  FROM frames LEFT JOIN ema USING (symbol, rn) LEFT JOIN macd USING (symbol, rn) LEFT JOIN dmi USING (symbol, rn) LEFT JOIN psar USING (symbol, rn))"""

SIGNALS = f"""{PANEL},
lagged AS (SELECT symbol, "date", sma_short - sma_mid AS d1, lag(sma_short - sma_mid) OVER w AS p1, macd - macd_signal AS d2, lag(macd - macd_signal) OVER w AS p2,
    rsi, lag(rsi) OVER w AS pr FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY "date")),
signals AS (
  SELECT symbol, "date", 1 AS rule_no, 'GC' AS signal FROM lagged WHERE p1 <= 0 AND d1 > 0
  UNION ALL SELECT symbol, "date", 2, 'DC' FROM lagged WHERE p1 >= 0 AND d1 < 0
  UNION ALL SELECT symbol, "date", 3, 'M+' FROM lagged WHERE p2 <= 0 AND d2 > 0
  UNION ALL SELECT symbol, "date", 4, 'M-' FROM lagged WHERE p2 >= 0 AND d2 < 0
  UNION ALL SELECT symbol, "date", 5, 'R30' FROM lagged WHERE pr < 30 AND rsi >= 30
  UNION ALL SELECT symbol, "date", 6, 'R70' FROM lagged WHERE pr > 70 AND rsi <= 70)"""


def _three(p: str) -> str:
    return f"CASE WHEN {p}_short IS NULL OR {p}_mid IS NULL OR {p}_long IS NULL THEN 'na' WHEN {p}_short > {p}_mid AND {p}_mid > {p}_long THEN 'bull' WHEN {p}_short < {p}_mid AND {p}_mid < {p}_long THEN 'bear' ELSE 'neutral' END"


def _limits(name: str, high: float, low: float) -> str:
    return f"CASE WHEN {name} >= {high} THEN 'bear' WHEN {name} <= {low} THEN 'bull' WHEN {name} IS NOT NULL THEN 'neutral' END"


_GS, _GL = (", ".join(f"gmma_{k}_{n}" for n in ns) for k, ns in (("short", ind.GMMA_SHORT), ("long", ind.GMMA_LONG)))
def _limit_notes(name: str, high: float, low: float, over: str, under: str, between: str) -> str:
    return f"CASE WHEN {name} >= {high} THEN '{over}' WHEN {name} <= {low} THEN '{under}' ELSE '{between}' END"


def _mean_notes(p: str) -> str:
    return f"""CASE {_three(p)} WHEN 'na' THEN 'データ不足（75日分必要）' WHEN 'bull' THEN '短期 > 中期 > 長期（5/25/75）上昇トレンド' WHEN 'bear' THEN '短期 < 中期 < 長期（5/25/75）下降トレンド'
      ELSE '短期・中期・長期が交錯（5/25/75）' END"""


_GMMA = f"CASE WHEN gmma_long_60 IS NULL THEN NULL WHEN least({_GS}) > greatest({_GL}) THEN 'bull' WHEN greatest({_GS}) < least({_GL}) THEN 'bear' ELSE 'neutral' END"
_MOMENTUM = "CASE WHEN momentum_signal IS NULL THEN NULL WHEN momentum > 0 AND momentum > momentum_signal THEN 'bull' WHEN momentum < 0 AND momentum < momentum_signal THEN 'bear' ELSE 'neutral' END"
#: Card, group, value, status, note.
_CARDS = (
    ("sma", "trend", "sma_mid", _three("sma"), _mean_notes("sma")), ("ema", "trend", "ema_mid", _three("ema"), _mean_notes("ema")),
    ("macd", "trend", "macd", "CASE WHEN macd IS NULL OR macd_signal IS NULL THEN NULL WHEN macd > macd_signal THEN 'bull' ELSE 'bear' END",
     "'MACD がシグナル（' || printf('%.2f', macd_signal) || '）より' || CASE WHEN macd > macd_signal THEN '上' ELSE '下' END"),
    ("ichimoku", "trend", "ichimoku_kijun", """CASE WHEN ichimoku_senkou1 IS NULL OR ichimoku_senkou2 IS NULL THEN NULL WHEN "close" > greatest(ichimoku_senkou1, ichimoku_senkou2) THEN 'bull'
      WHEN "close" < least(ichimoku_senkou1, ichimoku_senkou2) THEN 'bear' ELSE 'neutral' END""",
     """CASE WHEN "close" > greatest(ichimoku_senkou1, ichimoku_senkou2) THEN '株価が雲の上' WHEN "close" < least(ichimoku_senkou1, ichimoku_senkou2) THEN '株価が雲の下' ELSE '株価が雲の中' END
      || CASE WHEN ichimoku_tenkan > ichimoku_kijun THEN '・転換線 > 基準線' WHEN ichimoku_tenkan <= ichimoku_kijun THEN '・転換線 ≦ 基準線' ELSE '' END"""),
    ("adx", "trend", "adx", "CASE WHEN adx IS NULL OR plus_di IS NULL OR minus_di IS NULL THEN NULL WHEN adx < 25 THEN 'neutral' WHEN plus_di > minus_di THEN 'bull' ELSE 'bear' END",
     """CASE WHEN adx >= 25 THEN '強いトレンド' ELSE 'トレンド弱い' END || '・' || CASE WHEN plus_di > minus_di THEN '上昇' ELSE '下降' END
      || '優勢（+DI ' || printf('%.1f', plus_di) || ' / -DI ' || printf('%.1f', minus_di) || '）'"""),
    ("gmma", "trend", "NULL", _GMMA, f"CASE {_GMMA} WHEN 'bull' THEN '最短群がすべて最長群の上' WHEN 'bear' THEN '最短群がすべて最長群の下' ELSE '最短群と最長群が交錯' END"),
    ("parabolic", "trend", "parabolic", """CASE WHEN parabolic IS NULL THEN NULL WHEN "close" > parabolic THEN 'bull' ELSE 'bear' END""",
     """CASE WHEN "close" > parabolic THEN '株価が SAR より上（上昇トレンド）' ELSE '株価が SAR より下（下降トレンド）' END"""),
    ("deviation_short", "trend", "deviation_short", _limits("deviation_short", 10, -10), _limit_notes("deviation_short", 10, -10, "上方乖離が大きい（+10%以上）", "下方乖離が大きい（-10%以下）", "通常範囲")),
    ("deviation_long", "trend", "deviation_long", _limits("deviation_long", 20, -20), _limit_notes("deviation_long", 20, -20, "上方乖離が大きい（+20%以上）", "下方乖離が大きい（-20%以下）", "通常範囲")),
    ("rsi", "oscillator", "rsi", _limits("rsi", 70, 30), _limit_notes("rsi", 70, 30, "買われすぎ（70以上）", "売られすぎ（30以下）", "中立圏")),
    ("rci", "oscillator", "rci_short", "CASE WHEN rci_long IS NOT NULL THEN " + _limits("rci_short", 80, -80) + " END",
     _limit_notes("rci_short", 80, -80, "高値圏（+80以上）", "底値圏（-80以下）", "中立圏") + " || '（長期 ' || printf('%.1f', rci_long) || '）'"),
    ("stoch", "oscillator", "stoch_k", "CASE WHEN stoch_d IS NOT NULL THEN " + _limits("stoch_k", 80, 20) + " END",
     _limit_notes("stoch_k", 80, 20, "高値圏（80以上）", "安値圏（20以下）", "中立圏") + " || '（%D ' || printf('%.1f', stoch_d) || '）'"),
    ("psychological", "oscillator", "psychological", _limits("psychological", 75, 25), _limit_notes("psychological", 75, 25, "買われすぎ（75%以上）", "売られすぎ（25%以下）", "中立圏")),
    ("momentum", "oscillator", "momentum", _MOMENTUM,
     f"CASE {_MOMENTUM} WHEN 'bull' THEN '0より上でシグナルを上回る' WHEN 'bear' THEN '0より下でシグナルを下回る' ELSE 'シグナル ' || printf('%.2f', momentum_signal) END"),
    ("bb", "volatility", "bb_mid", """CASE WHEN bb_upper IS NULL THEN NULL WHEN "close" >= bb_upper THEN 'bear' WHEN "close" <= bb_lower THEN 'bull' ELSE 'neutral' END""",
     """CASE WHEN "close" >= bb_upper THEN '+2σ 以上' WHEN "close" <= bb_lower THEN '-2σ 以下' ELSE '±2σ の範囲内（' || printf('%.1f', bb_lower) || ' 〜 ' || printf('%.1f', bb_upper) || '）' END"""),
    ("stddev", "volatility", "stddev", "CASE WHEN stddev IS NOT NULL THEN 'neutral' END", """'終値比 ' || printf('%.2f', stddev / nullif("close", 0) * 100) || '%'"""),
)
_CARD_ROWS = " UNION ALL ".join(
    f"""SELECT symbol, {i} AS card_no, '{k}' AS card, '{g}' AS card_group, round(CAST({v} AS DOUBLE), 4) + 0.0 AS "value", {s} AS status, {n} AS note FROM final""" for i, (k, g, v, s, n) in enumerate(_CARDS, 1)
)
CARDS = f"""{PANEL},
final AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "date" DESC) = 1),
cards AS (SELECT * FROM ({_CARD_ROWS}) WHERE status IS NOT NULL)"""

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _register(key: str, build, columns: tuple[str, ...], cte: str, source: str, extra: str = "", recursive: bool = False) -> None:
    """A query that returns keys and rounded columns of ``build(bars)``."""
    numbers = [c for c in columns if c not in KEYS]
    QUERIES[key] = lambda spark, sf_dir: rounded(build(bars(spark, sf_dir)), *KEYS, *numbers)
    ORACLE_SQL[key] = f'WITH {"RECURSIVE " * recursive}{cte} SELECT symbol, "date", {r4(*numbers)} FROM {source} {extra}'


_register("ind_sma", lambda b: b.withColumns(ind.sma_columns()), ("sma_short", "sma_mid", "sma_long"), FRAMES, "frames")
_register("ind_bb", lambda b: b.withColumns(ind.band_columns()), ("bb_upper", "bb_mid", "bb_lower", "stddev"), FRAMES, "frames")
_register("ind_deviation", lambda b: b.withColumns(ind.deviation_columns()), ("deviation_short", "deviation_long"), FRAMES, "frames")
_ICHIMOKU = ("ichimoku_tenkan", "ichimoku_kijun", "ichimoku_senkou1", "ichimoku_senkou2", "ichimoku_chikou")
for _key, _columns in (
    ("ind_ichimoku", _ICHIMOKU), ("ind_rci", ("rci_short", "rci_long")), ("ind_stoch", ("stoch_k", "stoch_d")), ("ind_psych", ("psychological",)),
    ("ind_momentum", ("momentum", "momentum_signal")),
):
    _register(_key, ind.frames, _columns, FRAMES, "frames")
for _key, _columns in (
    ("ind_ema", ("ema_short", "ema_mid", "ema_long")), ("ind_gmma", tuple(c for c in ind.COLUMNS if c.startswith("gmma"))), ("ind_macd", ("macd", "macd_signal")),
    ("ind_rsi", ("rsi",)), ("ind_dmi", ("plus_di", "minus_di", "adx")), ("ind_psar", ("parabolic",)),
):
    _register(_key, lambda b: ind.indicators(b, with_frames=False), _columns, PANEL, "panel", recursive=True)
_register("ind_all", ind.panel, ind.COLUMNS, PANEL, "panel", recursive=True)
_register("ind_blocks", lambda b: blocks.indicators(b), ind.COLUMNS, PANEL, "panel", recursive=True)


def _query(key: str, sql: str):
    def add(f):
        QUERIES[key], ORACLE_SQL[key] = f, sql
        return f

    return add


@_query("future_cloud", f"""WITH {FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "date" DESC) AS k, max("date") OVER (PARTITION BY symbol) AS fin FROM frames),
days AS (SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d) AS o FROM (
  SELECT DISTINCT symbol, CAST(unnest(generate_series(fin + 1, fin + 50, INTERVAL 1 DAY)) AS DATE) AS d FROM n) WHERE isodow(d) < 6)
SELECT n.symbol, CAST(26 - k AS INT) AS "offset", d AS "date", round((ichimoku_tenkan + ichimoku_kijun) / 2, 4) + 0.0 AS senkou1, round(cloud2, 4) + 0.0 AS senkou2
FROM n JOIN days ON days.symbol = n.symbol AND o = 26 - k WHERE k <= 25""")  # fmt: skip
def _future_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.future_cloud(bars(spark, sf_dir)), "symbol", "offset", "date", "senkou1", "senkou2")


@_query("quote", f"""WITH {SERIES} SELECT symbol, "date", "open", high, low, "close", volume, round("close" - nullif(pc, 0), 4) + 0.0 AS change,
  round(("close" - nullif(pc, 0)) / nullif(pc, 0) * 100, 4) + 0.0 AS change_pct FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "date" DESC) = 1""")
def _quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.quote(bars(spark, sf_dir)), *KEYS, "open", "high", "low", "close", "volume", "change", "change_pct")


@_query("signals", f"WITH RECURSIVE {SIGNALS} SELECT * FROM signals")
def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.signals(ind.panel(bars(spark, sf_dir)))


@_query("signals_range", f"""WITH RECURSIVE {SIGNALS}, t AS (SELECT symbol, "date", row_number() OVER (PARTITION BY symbol ORDER BY "date" DESC) AS n FROM bars),
r AS (SELECT symbol, min("date") AS "start", max("date") AS "end" FROM t WHERE n <= 60 GROUP BY 1)
SELECT s.symbol, s."date", rule_no, signal FROM signals s JOIN r ON r.symbol = s.symbol AND s."date" BETWEEN r."start" AND r."end" """)
def _signals_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = ind.panel(bars(spark, sf_dir))
    return sig.within_last(sig.signals(panel), panel, 60)


@_query("signals_last12", f'WITH RECURSIVE {SIGNALS} SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY "date" DESC, rule_no DESC) AS INT) AS position FROM signals QUALIFY position <= 12')
def _signals_last12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.last_signals(sig.signals(ind.panel(bars(spark, sf_dir))))


@_query("cards", f"WITH RECURSIVE {CARDS} SELECT * FROM cards")
def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sig.cards(ind.indicators(bars(spark, sf_dir))), "symbol", "card_no", "card", "card_group", "value", "status", "note")


@_query("cards_by_category", f"""WITH RECURSIVE {CARDS}, m AS (SELECT *, card IN ('sma', 'macd', 'ichimoku', 'rsi', 'bb') AS named FROM cards)
SELECT symbol, card_group, CAST(CASE card_group WHEN 'trend' THEN 1 WHEN 'oscillator' THEN 2 ELSE 3 END AS INT) AS category_no, card_no, card,
  named OR (NOT bool_or(named) OVER w AND card_no = min(card_no) OVER w) AS is_primary FROM m WINDOW w AS (PARTITION BY symbol, card_group)""")
def _by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.by_category(_cards(spark, sf_dir)).select("symbol", "card_group", "category_no", "card_no", "card", "is_primary")


@_query("verdict_badge", f"""WITH RECURSIVE {CARDS} SELECT symbol, balance, CASE WHEN balance > 0 THEN 'bull' WHEN balance < 0 THEN 'bear' ELSE 'neutral' END AS verdict
FROM (SELECT symbol, count(*) FILTER (status = 'bull') - count(*) FILTER (status = 'bear') AS balance FROM cards GROUP BY symbol)""")
def _badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.badge(_cards(spark, sf_dir))


def newest(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each symbol, numbered from the newest."""
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return df.withColumn("nth", F.row_number().over(back)).where(F.col("nth") <= n)


@_query("table_last60", f"""WITH RECURSIVE {PANEL} SELECT symbol, "date", CAST(row_number() OVER (PARTITION BY symbol ORDER BY "date" DESC) AS INT) AS nth,
  "open", high, low, "close", volume, {r4(*ind.COLUMNS)} FROM panel QUALIFY nth <= 60""")
def _table_last60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(newest(ind.indicators(bars(spark, sf_dir)), 60), *KEYS, "nth", "open", "high", "low", "close", "volume", *ind.COLUMNS)


@_query("join_prices_indicators", f"""WITH {FRAMES} SELECT b.symbol, b."date", b."close", round(f.sma_short, 4) + 0.0 AS sma_short
FROM bars b LEFT JOIN (SELECT * FROM frames WHERE sma_long IS NOT NULL) f ON f.symbol = b.symbol AND f."date" = b."date" """)
def _join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = bars(spark, sf_dir)
    made = prices.withColumns(ind.sma_columns()).where("sma_long is not null").select(*KEYS, "sma_short")
    return rounded(prices.join(made, list(KEYS), "left"), *KEYS, "close", "sma_short")


@_query("chart_series", f"""WITH RECURSIVE {PANEL} SELECT symbol, "date", "open", high, low, "close", coalesce("close" >= "open", true) AS up, volume,
  round(macd - macd_signal, 4) + 0.0 AS hist FROM panel WHERE "open" IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND "close" IS NOT NULL""")
def _chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ind.indicators(bars(spark, sf_dir), with_frames=False).dropna(subset=["open", "high", "low", "close"])
    made = made.withColumn("up", F.coalesce(F.col("close") >= F.col("open"), F.lit(True))).withColumn("hist", F.col("macd") - F.col("macd_signal"))
    return rounded(made, *KEYS, "open", "high", "low", "close", "up", "volume", "hist")


@_query("scan_filter_sort", f"""WITH {BARS} SELECT symbol, "date", "open", high, low, "close", volume FROM bars WHERE symbol = 'A' ORDER BY "date" """)
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).where("symbol = 'A'").orderBy("date")


@_query("price_range", f'WITH {BARS} SELECT symbol, min("date") AS first_date, max("date") AS last_date, min(low) AS low, max(high) AS high, count(*) AS n FROM bars GROUP BY symbol')
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")
    )
