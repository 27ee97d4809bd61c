"""Queries over facts, series, context and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import BARS, bars, table
from ..functions import scalars as sc
from ..operators import context, export
from ..operators import fundamentals as fin
from ..operators import indicators as ind
from .bars import PANEL, r4, rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(key: str, sql: str | None):
    def add(f):
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


# ---- facts ---------------------------------------------------------------------------------------------------------
_ELEMENTS = [f"jpcrp_cor:{x}SummaryOfBusinessResults" for x in ("NetSales", "OperatingRevenue1", "NetIncomeLoss", "EquityToAssetRatioIFRS", "RateOfReturnOnEquity", "PayoutRatio", "SomethingElse")] + ["jpdei_cor:Type"]
_CONTEXTS = ["CurrentYearDuration", "Prior1YearDuration", "Prior2YearInstant_NonConsolidatedMember", "CurrentYearDuration_SegmentMember", "InterimDuration", "Prior1InterimInstant", "CurrentYearInstant_NonConsolidatedMember"]
_UNITS = ["JPY", "JPY", "JPY", "JPYPerShares", "pure", "pure", "shares", ""]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RAW = f"""raw AS (SELECT o_custkey % 200 AS file, o_orderkey AS pos, {_sql_list(_ELEMENTS)}[(o_orderkey % 8) + 1] AS element, {_sql_list(_CONTEXTS)}[(o_custkey % 7) + 1] AS context,
    {_sql_list(_UNITS)}[(o_orderkey % 8) + 1] AS unit_id, CASE WHEN o_orderkey % 11 = 0 THEN '－' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS "value",
    CASE WHEN o_custkey % 200 % 3 = 0 THEN 'HY' ELSE 'FY' END AS doc_period, DATE '2024-02-29' AS fy_end, DATE '2024-08-31' AS interim_end, DATE '2023-08-31' AS prior_interim_end FROM orders)"""


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    day = lambda x: F.lit(x).cast("date")
    return table(spark, sf_dir, "orders").select(
        (cust % 200).alias("file"), key.alias("pos"), pick(_ELEMENTS, key % 8).alias("element"), pick(_CONTEXTS, cust % 7).alias("context"), pick(_UNITS, key % 8).alias("unit_id"),
        F.when(key % 11 == 0, "－").otherwise(F.format_number(F.floor("o_totalprice"), 0)).alias("value"), F.when(cust % 200 % 3 == 0, "HY").otherwise("FY").alias("doc_period"),
        day("2024-02-29").alias("fy_end"), day("2024-08-31").alias("interim_end"), day("2023-08-31").alias("prior_interim_end"),
    )


_ITEM = "CASE o_el WHEN 0 THEN 'revenue' WHEN 1 THEN 'revenue' WHEN 2 THEN 'net_income' WHEN 3 THEN 'bps' WHEN 4 THEN 'roe' WHEN 5 THEN 'payout_ratio' END"
MAPPED = f"""{RAW}, mapped AS (SELECT *, {_ITEM.replace("o_el", "pos % 8")} AS item, pos % 8 IN (1, 2) AS fallback FROM raw WHERE pos % 8 < 6)"""
PLACED = f"""{MAPPED}, placed AS (SELECT *, CASE context WHEN 'CurrentYearDuration' THEN DATE '2024-02-29' WHEN 'CurrentYearInstant_NonConsolidatedMember' THEN DATE '2024-02-29'
    WHEN 'Prior1YearDuration' THEN CASE WHEN doc_period = 'FY' THEN DATE '2023-02-28' ELSE DATE '2024-02-29' END
    WHEN 'Prior2YearInstant_NonConsolidatedMember' THEN CASE WHEN doc_period = 'FY' THEN DATE '2022-02-28' ELSE DATE '2023-02-28' END
    WHEN 'InterimDuration' THEN interim_end WHEN 'Prior1InterimInstant' THEN prior_interim_end END AS period_end,
  CASE WHEN context LIKE '%Interim%' THEN 'HY' ELSE 'FY' END AS period_type, context LIKE '%NonConsolidatedMember' AS alone FROM mapped WHERE context <> 'CurrentYearDuration_SegmentMember')"""
VALUED = f"""{PLACED}, valued AS (SELECT *, CAST("value" AS DOUBLE) * CASE WHEN item IN ('roe', 'payout_ratio') THEN 100 ELSE 1 END AS number,
  CASE unit_id WHEN 'JPYPerShares' THEN 'JPY/share' WHEN 'pure' THEN '%' ELSE unit_id END AS unit FROM placed WHERE "value" <> '－')"""
DEDUP = f"""{VALUED}, dedup AS (SELECT file, period_end, period_type, item, alone, number, unit FROM valued
  QUALIFY row_number() OVER (PARTITION BY file, period_end, period_type, item, alone ORDER BY fallback, pos) = 1)"""
BASED = f"""{DEDUP}, g AS (SELECT *, bool_or(NOT alone) OVER (PARTITION BY file) AS grp, bool_or(NOT alone) OVER (PARTITION BY file, period_end, period_type, item) AS bth FROM dedup)
SELECT file, period_end, period_type, item, number, unit, CASE WHEN grp THEN 'consolidated' ELSE 'nonconsolidated' END AS basis FROM g
WHERE alone <> grp OR (grp AND alone AND item IN ('dps', 'payout_ratio', 'shares_outstanding', 'capital_stock') AND NOT bth)"""


@_query("facts_header", f"WITH {RAW} SELECT file, arg_min(\"value\", pos) AS type FROM raw WHERE element = 'jpdei_cor:Type' AND \"value\" <> '－' GROUP BY 1")
def _header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_facts(spark, sf_dir).where("value <> '－'").withColumn("value", F.replace("value", F.lit(","), F.lit("")))
    return fin.header(rows).select("file", F.col("items")["Type"].alias("type"))


@_query("facts_map", f"WITH {MAPPED} SELECT file, pos, element, item, fallback FROM mapped")
def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.mapped(raw_facts(spark, sf_dir)).select("file", "pos", "element", "item", "fallback")


@_query("facts_context", f"WITH {PLACED} SELECT file, pos, period_end, period_type, alone FROM placed")
def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.placed(fin.mapped(raw_facts(spark, sf_dir))).select("file", "pos", "period_end", "period_type", "alone")


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.valued(fin.placed(fin.mapped(raw_facts(spark, sf_dir))))


@_query("facts_units", f"WITH {VALUED} SELECT file, pos, number, unit FROM valued")
def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valued(spark, sf_dir).select("file", "pos", "number", "unit")


@_query("facts_dedup", f"WITH {DEDUP} SELECT * FROM dedup")
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.one_each(_valued(spark, sf_dir))


@_query("facts_basis", f"WITH {BASED}")
def _basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.based(_dedup(spark, sf_dir))


# ---- series --------------------------------------------------------------------------------------------------------
def fin_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, period_end, item, value``: yearly sums by nation; the last year is cut short."""
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("symbol"))
    sold = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    price, year = F.col("o_totalprice"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31))
    cents = F.sum(F.round(price * 100).cast("long"))
    wide = sold.groupBy("symbol", year.alias("period_end")).agg(
        cents.cast("double").alias("revenue"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.round(price * 100)).otherwise(-F.round(price * 100)).cast("long")).cast("double").alias("net_income"),
        F.max(price).alias("total_assets"),
        F.when(F.count("*") % 3 != 0, F.sum((F.col("o_orderkey") % 100 - 40))).cast("double").alias("operating_cf"),
        (-F.min(price)).alias("investing_cf"),
        (F.count("*") % 17).cast("double").alias("roe"),
    )
    return wide.unpivot(["symbol", "period_end"], ["revenue", "net_income", "total_assets", "operating_cf", "investing_cf", "roe"], "item", "value")


FACTS = """w AS (SELECT CAST(c_nationkey AS VARCHAR) AS symbol, make_date(year(o_orderdate), 12, 31) AS period_end, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS revenue,
    CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS net_income, max(o_totalprice) AS total_assets,
    CASE WHEN count(*) % 3 <> 0 THEN CAST(sum(o_orderkey % 100 - 40) AS DOUBLE) END AS operating_cf, -min(o_totalprice) AS investing_cf, CAST(count(*) % 17 AS DOUBLE) AS roe
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM (
  SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) <= 5))"""


def _pct(b: str, a: str) -> str:
    return f"CASE WHEN {b} <> 0 AND ({b} > 0) = ({a} > 0) THEN ({a} - {b}) / abs({b}) * 100 END"


DERIVED = f"""{FACTS}, d AS (SELECT *, {_pct("lag(revenue) OVER o", "revenue")} AS revenue_growth, {_pct("lag(net_income) OVER o", "net_income")} AS net_income_growth,
    operating_cf / nullif(revenue, 0) * 100 AS operating_cf_margin, operating_cf + investing_cf AS free_cash_flow, (net_income - operating_cf) / nullif(total_assets, 0) * 100 AS accruals
  FROM p WINDOW o AS (PARTITION BY symbol ORDER BY period_end)),
h AS ({" UNION ALL ".join(f"SELECT symbol, i, n, '{k}' AS metric, {'true' if m == 'pct' else 'false'} AS pct, {'NULL' if m is None else f"'{m}'"} AS mode, {s} AS sgn, '{u}' AS unit, {k} AS v FROM d" for k, u, m, s in fin.METRICS if k in ("revenue", "revenue_growth", "net_income", "net_income_growth", "total_assets", "roe", "operating_cf", "operating_cf_margin", "free_cash_flow", "accruals"))}),
v AS (SELECT *, row_number() OVER (PARTITION BY symbol, metric ORDER BY i DESC) AS k, count(*) OVER (PARTITION BY symbol, metric) AS c FROM h WHERE v IS NOT NULL),
m AS (SELECT symbol, metric, any_value(mode) AS mode, any_value(sgn) AS sgn, any_value(unit) AS unit, count(*) AS c, min(v) AS lo, max(v) AS hi, max(CASE WHEN k = 1 THEN v END) AS a, max(CASE WHEN k = 2 THEN v END) AS b,
    max(CASE WHEN k = 3 THEN v END) AS e, max(CASE WHEN k = c THEN v END) AS f FROM v GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN mode = 'pct' THEN {_pct("b", "a")} ELSE a - b END AS s1, CASE WHEN mode = 'pct' THEN {_pct("e", "b")} ELSE b - e END AS s2 FROM m),
x AS (SELECT *, sgn * CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN (s1 + s2) / 2 ELSE coalesce(s1, s2) END AS rate, CASE WHEN mode = 'pt' THEN 0.5 ELSE 5.0 END AS lim FROM t),
metrics AS (SELECT symbol, metric, CASE WHEN unit IN ('JPY', 'JPY/share') AND c >= 2 AND f <> 0 AND (f < 0) = (a < 0) THEN (pow(a / f, 1.0 / (c - 1)) - 1) * 100 END AS cagr,
    CASE WHEN mode IS NOT NULL AND c >= 2 AND rate IS NOT NULL THEN CASE WHEN rate > lim THEN 'better' WHEN rate < -lim THEN 'worse' ELSE 'flat' END END AS trend,
    CASE WHEN c >= 2 THEN CASE WHEN hi = lo THEN 50.0 ELSE (a - lo) / (hi - lo) * 100 END END AS position, unit FROM x),
ends AS (SELECT symbol, metric, max(CASE WHEN i = n THEN v END) AS "value", max(CASE WHEN i = n - 1 THEN v END) AS prev FROM h GROUP BY 1, 2)"""
_KNOWN = ("revenue", "revenue_growth", "net_income", "net_income_growth", "total_assets", "roe", "operating_cf", "operating_cf_margin", "free_cash_flow", "accruals")


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.with_derived(fin.histories(fin_facts(spark, sf_dir)))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.metrics(_derived(spark, sf_dir)).where(F.col("metric").isin(*_KNOWN) & (F.col("n_values") > 0))


@_query("fin_series", f"WITH {FACTS} SELECT symbol, period_end, round(revenue, 2) AS revenue, round(net_income, 2) AS net_income, roe FROM p")
def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = fin.histories(fin_facts(spark, sf_dir)).select("symbol", F.explode("p").alias("p"))
    item = lambda k: F.try_element_at(F.col("p.items"), F.lit(k))
    return flat.select("symbol", "p.period_end", F.round(item("revenue"), 2).alias("revenue"), F.round(item("net_income"), 2).alias("net_income"), item("roe").alias("roe"))


@_query("fin_derived", f"WITH {DERIVED} SELECT symbol, period_end, {r4('revenue_growth', 'net_income_growth', 'operating_cf_margin', 'free_cash_flow', 'accruals')} FROM d")
def _fin_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("revenue_growth", "net_income_growth", "operating_cf_margin", "free_cash_flow", "accruals")
    rows = _derived(spark, sf_dir).select("symbol", F.explode(F.arrays_zip("ends", *names)).alias("x"))
    return rounded(rows.select("symbol", F.col("x.ends").alias("period_end"), *[F.col(f"x.{n}").alias(n) for n in names]), "symbol", "period_end", *names)


@_query("fin_growth", f"""WITH {FACTS}, q AS (SELECT symbol, period_end, net_income AS a, lag(net_income) OVER (PARTITION BY symbol ORDER BY period_end) AS b FROM p)
SELECT symbol, period_end, round({_pct("b", "a")}, 4) + 0.0 AS growth, round(a - b, 2) + 0.0 AS difference,
  CASE WHEN b = 0 THEN 'zero before' WHEN b < 0 AND a > 0 THEN 'loss to profit' WHEN b > 0 AND a < 0 THEN 'profit to loss' END AS reason FROM q""")
def _growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("net_income")
    rows = _derived(spark, sf_dir).select("symbol", F.posexplode("ends").alias("i", "period_end"), "net_income")
    b, a = F.get(h, F.col("i") - 1), F.get(h, F.col("i"))
    made = rows.select("symbol", "period_end", fin.pct_change(b, a).alias("growth"), (F.round(a - b, 2) + 0.0).alias("difference"), fin.blocked(b, a).alias("reason"))
    return made.withColumn("growth", F.round("growth", 4) + 0.0)


@_query("fin_cagr", f"WITH {DERIVED} SELECT symbol, metric, round(cagr, 4) + 0.0 AS cagr FROM metrics")
def _cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_metrics(spark, sf_dir), "symbol", "metric", "cagr")


@_query("fin_percentile", f"WITH {DERIVED} SELECT symbol, metric, round(position, 4) + 0.0 AS position FROM metrics")
def _position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_metrics(spark, sf_dir), "symbol", "metric", "position")


@_query("fin_trend", f"WITH {DERIVED} SELECT symbol, metric, trend FROM metrics")
def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("symbol", "metric", "trend")


@_query("fin_metrics", f"""WITH {DERIVED} SELECT m.symbol, m.metric, m.unit, round("value", 4) + 0.0 AS "value", round(CASE WHEN m.unit = '%' THEN "value" - prev ELSE {_pct("prev", '"value"')} END, 4) + 0.0 AS change,
  round(cagr, 4) + 0.0 AS cagr, trend, round(position, 4) + 0.0 AS position FROM metrics m JOIN ends e ON e.symbol = m.symbol AND e.metric = m.metric""")
def _fin_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_metrics(spark, sf_dir), "symbol", "metric", "unit", "value", "change", "cagr", "trend", "position")


@_query("fin_interim", f"""WITH {FACTS}, q AS (SELECT symbol, revenue AS a, lag(revenue) OVER (PARTITION BY symbol ORDER BY period_end) AS b, roe AS ra, lag(roe) OVER (PARTITION BY symbol ORDER BY period_end) AS rb, i, n FROM p)
SELECT symbol, round({_pct("b", "a")}, 4) + 0.0 AS revenue_change, ra - rb AS roe_change FROM q WHERE i = n""")
def _interim(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda c, k: F.get(F.col(c), F.size(c) - k)
    made = _derived(spark, sf_dir).select(
        "symbol", (F.round(fin.pct_change(last("revenue", 2), last("revenue", 1)), 4) + 0.0).alias("revenue_change"), (last("roe", 1) - last("roe", 2)).alias("roe_change")
    )
    return made


# ---- context and exports -------------------------------------------------------------------------------------------
_OLDER = 'older AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "date" DESC) AS nth FROM {0}) WHERE nth BETWEEN 21 AND 120)'


@_query("compress_summary", f"""WITH {BARS}, {_OLDER.format("bars")} SELECT symbol, min("date") AS "start", max("date") AS "end", count(*) AS bars, arg_min("open", "date") AS "open", max(high) AS high, min(low) AS low,
  arg_max("close", "date") AS "close", round(avg(volume), 4) + 0.0 AS volume_avg, max(volume) AS volume_max FROM older GROUP BY 1""")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    older = context.split_recent(bars(spark, sf_dir), 120).where("not recent")
    return context.summary(older).withColumn("volume_avg", F.round("volume_avg", 4) + 0.0)


_SHOWN = ("sma_mid", "rsi", "macd", "stoch_k", "adx", "bb_upper", "parabolic")
_DIRECTION = """CASE WHEN indicator IN ('rsi', 'stoch_k', 'adx') THEN CASE WHEN en - st > 5 THEN 'up' WHEN en - st < -5 THEN 'down' ELSE 'flat' END
  WHEN (en - st) / abs(st) * 100 > 3 THEN 'up' WHEN (en - st) / abs(st) * 100 < -3 THEN 'down' ELSE 'flat' END"""


@_query("compress_indicators", f"""WITH RECURSIVE {PANEL}, {_OLDER.format("panel")}, l AS ({" UNION ALL ".join(f"SELECT symbol, " + '"date"' + f", '{c}' AS indicator, {c} AS v FROM older WHERE {c} IS NOT NULL" for c in _SHOWN)}),
g AS (SELECT symbol, indicator, arg_min(v, "date") AS st, arg_max(v, "date") AS en, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1, 2)
SELECT symbol, indicator, round(st, 4) + 0.0 AS start_value, round(en, 4) + 0.0 AS end_value, round(lo, 4) + 0.0 AS low, round(hi, 4) + 0.0 AS high, {_DIRECTION} AS direction FROM g""")
def _indicator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    older = context.split_recent(ind.indicators(bars(spark, sf_dir)), 120).where("not recent")
    return rounded(context.indicator_summary(older, _SHOWN), "symbol", "indicator", "start_value", "end_value", "low", "high", "direction")


_JUDGED = r"""t AS (SELECT doc_id, doc_id % 50 AS grp, unnest(tok) AS token, unnest(range(len(tok))) AS place FROM (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(\d{4}-\d{2}-\d{2}|-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)') AS tok FROM documents)),
k AS (SELECT *, regexp_matches(token, '^\d{4}-\d{2}-\d{2}$') AS dated, CASE WHEN NOT regexp_matches(token, '^\d{4}-\d{2}-\d{2}$') THEN CAST(replace(token, ',', '') AS DOUBLE) END AS v,
  length(regexp_extract(token, '\.(\d+)$', 1)) AS d FROM t),
c AS (SELECT * FROM k WHERE doc_id % 2 = 0 AND NOT (NOT regexp_matches(token, '[,.]') AND coalesce(TRY_CAST(token AS INT) BETWEEN 1 AND 10, false))),
c1 AS (SELECT DISTINCT grp, token, dated, v, d FROM c), s1 AS (SELECT DISTINCT grp, token, dated, v, d FROM k WHERE doc_id % 2 = 1),
hit AS (SELECT DISTINCT c1.grp, c1.token, true AS ok FROM c1 JOIN s1 ON c1.grp = s1.grp AND c1.dated = s1.dated AND CASE WHEN c1.dated THEN c1.token = s1.token
  ELSE format('{:.' || c1.d || 'f}', c1.v) = format('{:.' || c1.d || 'f}', s1.v) OR format('{:.' || s1.d || 'f}', c1.v) = format('{:.' || s1.d || 'f}', s1.v) END),
judged AS (SELECT c.*, coalesce(ok, false) AS found FROM c LEFT JOIN hit ON hit.grp = c.grp AND hit.token = c.token)"""


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("grp"), "text")
    found = context.tokens(docs).drop("text")
    return found.where("doc_id % 2 = 0"), found.where("doc_id % 2 = 1").select("grp", "token")


@_query("verify_numbers", f"WITH {_JUDGED} SELECT grp, count(*) AS checked, count_if(found)::BIGINT AS found, count_if(found) / count(*) AS rate FROM judged GROUP BY 1")
def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.verify(*_claims(spark, sf_dir), ["grp"])


@_query("verify_missing", f"""WITH {_JUDGED} SELECT grp, doc_id, CAST(place AS INT) AS place, token, v AS number_value, CASE WHEN dated THEN token END AS day FROM judged WHERE NOT found""")
def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = context.missing(*_claims(spark, sf_dir), ["grp"])
    dated = F.col("token").rlike(r"^\d{4}-\d{2}-\d{2}$")
    return gone.select("grp", "doc_id", "place", "token", F.when(~dated, F.col("number")).cast("double").alias("number_value"), F.when(dated, F.col("number")).alias("day"))


_CURRENCY = "CASE WHEN symbol = 'A' THEN 'JPY' ELSE 'USD' END"


def _currency(df: DataFrame) -> DataFrame:
    return df.withColumn("currency", F.when(F.col("symbol") == "A", "JPY").otherwise("USD"))


def _decimals(c: str, n: int) -> str:
    return f"floor(round({c}, 6) * {10**n} + 0.5) / {10**n} + 0.0"


def _human(c: str) -> str:
    return f"CASE WHEN symbol = 'A' THEN {_decimals(c, 1)} ELSE {_decimals(c, 2)} END AS {c}"


@_query("export_human_prices", f"""WITH {BARS} SELECT symbol, strftime("date", '%Y/%m/%d') AS day, {", ".join(_human(f'"{c}"') for c in export.PRICES)}, volume FROM bars""")
def _human_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.human_prices(_currency(bars(spark, sf_dir)))


@_query("export_human_indicators", f"""WITH RECURSIVE {PANEL} SELECT symbol, strftime("date", '%Y/%m/%d') AS day, {_human('"close"')},
  {", ".join(f"{_decimals(c, 2)} AS {c}" if c in export.TWO_DECIMALS else _human(c) for c in ind.COLUMNS)} FROM panel""")
def _human_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.human_indicators(_currency(ind.indicators(bars(spark, sf_dir))))


@_query("export_machine", f"""WITH RECURSIVE {PANEL} SELECT symbol, 'Name ' || symbol AS name, {_CURRENCY} AS currency, "date", {r4('"open"', "high", "low", '"close"', *ind.COLUMNS)}, volume
FROM panel QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "date" DESC) <= 250""")
def _machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _currency(spark.createDataFrame([("A",), ("N",), ("R",)], "symbol string")).withColumn("name", F.concat(F.lit("Name "), "symbol"))
    recent = context.split_recent(ind.indicators(bars(spark, sf_dir)), 250).drop("recent")
    return export.machine(recent, names)
