"""Accounting facts: from tagged rows to series, growth, trends and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .control import year_end_back

#: Element names (without the prefix) and the item each gives; a name marked True only stands in for another.
ELEMENTS = {
    "NetSalesSummaryOfBusinessResults": ("revenue", False),
    "OperatingRevenue1SummaryOfBusinessResults": ("revenue", True),
    "OrdinaryIncomeLossSummaryOfBusinessResults": ("ordinary_income", False),
    "ProfitLossAttributableToOwnersOfParentSummaryOfBusinessResults": ("net_income", False),
    "NetIncomeLossSummaryOfBusinessResults": ("net_income", True),
    "ComprehensiveIncomeSummaryOfBusinessResults": ("comprehensive_income", False),
    "NetAssetsSummaryOfBusinessResults": ("net_assets", False),
    "TotalAssetsSummaryOfBusinessResults": ("total_assets", False),
    "NetAssetsPerShareSummaryOfBusinessResults": ("bps", False),
    "BasicEarningsLossPerShareSummaryOfBusinessResults": ("eps", False),
    "DilutedEarningsPerShareSummaryOfBusinessResults": ("diluted_eps", False),
    "EquityToAssetRatioSummaryOfBusinessResults": ("equity_ratio", False),
    "RateOfReturnOnEquitySummaryOfBusinessResults": ("roe", False),
    "PriceEarningsRatioSummaryOfBusinessResults": ("per", False),
    "PayoutRatioSummaryOfBusinessResults": ("payout_ratio", False),
    "NetCashProvidedByUsedInOperatingActivitiesSummaryOfBusinessResults": ("operating_cf", False),
    "NetCashProvidedByUsedInInvestingActivitiesSummaryOfBusinessResults": ("investing_cf", False),
    "NetCashProvidedByUsedInFinancingActivitiesSummaryOfBusinessResults": ("financing_cf", False),
    "CashAndCashEquivalentsSummaryOfBusinessResults": ("cash_and_equivalents", False),
    "CapitalStockSummaryOfBusinessResults": ("capital_stock", False),
    "TotalNumberOfIssuedSharesSummaryOfBusinessResults": ("shares_outstanding", False),
    "DividendPaidPerShareSummaryOfBusinessResults": ("dps", False),
    "RevenueIFRSSummaryOfBusinessResults": ("revenue", False),
    "ProfitLossBeforeTaxIFRSSummaryOfBusinessResults": ("pretax_income", False),
    "ProfitLossAttributableToOwnersOfParentIFRSSummaryOfBusinessResults": ("net_income", False),
    "ComprehensiveIncomeAttributableToOwnersOfParentIFRSSummaryOfBusinessResults": ("comprehensive_income", False),
    "EquityAttributableToOwnersOfParentIFRSSummaryOfBusinessResults": ("equity", False),
    "TotalAssetsIFRSSummaryOfBusinessResults": ("total_assets", False),
    "EquityToAssetRatioIFRSSummaryOfBusinessResults": ("bps", False),  # named like a ratio, a value per share
    "RatioOfOwnersEquityToGrossAssetsIFRSSummaryOfBusinessResults": ("equity_ratio", False),
    "RateOfReturnOnEquityIFRSSummaryOfBusinessResults": ("roe", False),
    "PriceEarningsRatioIFRSSummaryOfBusinessResults": ("per", False),
    "BasicEarningsLossPerShareIFRSSummaryOfBusinessResults": ("eps", False),
    "DilutedEarningsLossPerShareIFRSSummaryOfBusinessResults": ("diluted_eps", False),
    "CashFlowsFromUsedInOperatingActivitiesIFRSSummaryOfBusinessResults": ("operating_cf", False),
    "CashFlowsFromUsedInInvestingActivitiesIFRSSummaryOfBusinessResults": ("investing_cf", False),
    "CashFlowsFromUsedInFinancingActivitiesIFRSSummaryOfBusinessResults": ("financing_cf", False),
    "CashAndCashEquivalentsIFRSSummaryOfBusinessResults": ("cash_and_equivalents", False),
    "RevenuesUSGAAPSummaryOfBusinessResults": ("revenue", False),
    "NetIncomeLossAttributableToOwnersOfParentUSGAAPSummaryOfBusinessResults": ("net_income", False),
    "TotalAssetsUSGAAPSummaryOfBusinessResults": ("total_assets", False),
}
HEADER, FACT = "jpdei_cor:", "jpcrp_cor:"
ALONE = "_NonConsolidatedMember"
PERCENT = ("roe", "equity_ratio", "payout_ratio")
COMPANY_LEVEL = ("dps", "payout_ratio", "shares_outstanding", "capital_stock")

#: The metrics in order: key, unit, trend mode, sign of good.
METRICS = (
    ("revenue", "JPY", "pct", 1), ("revenue_growth", "%", "pt", 1), ("net_income", "JPY", "pct", 1), ("net_income_growth", "%", "pt", 1),
    ("eps", "JPY/share", "pct", 1), ("eps_growth", "%", "pt", 1), ("total_assets", "JPY", None, 1), ("net_assets", "JPY", None, 1),
    ("equity", "JPY", None, 1), ("roe", "%", "pt", 1), ("equity_ratio", "%", "pt", 1), ("operating_cf", "JPY", "pct", 1),
    ("operating_cf_margin", "%", "pt", 1), ("free_cash_flow", "JPY", "pct", 1), ("accruals", "%", "pt", -1), ("per", "times", None, 1),
    ("payout_ratio", "%", None, 1),
)
PERIODS = 5


# ---- facts ---------------------------------------------------------------------------------------------------------
def header(rows: DataFrame) -> DataFrame:
    """``file, items``: the first value of each header element."""
    first = rows.where(F.col("element").startswith(HEADER)).groupBy("file", "element").agg(F.min_by("value", "pos").alias("value"))
    return first.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(F.substr("element", F.lit(len(HEADER) + 1)), "value"))).alias("items"))


def mapped(rows: DataFrame) -> DataFrame:
    """Rows of known elements, with item and whether the element only stands in."""
    spark: SparkSession = rows.sparkSession
    known = spark.createDataFrame([(FACT + k, *v) for k, v in ELEMENTS.items()], "element string, item string, fallback boolean")
    return rows.join(F.broadcast(known), "element")


def placed(rows: DataFrame) -> DataFrame:
    """Rows of contexts that name a year or a half-year of the whole company, with period_end, period_type and alone."""
    context = F.regexp_replace("context", f"{ALONE}$", "")
    back = F.regexp_extract(context, "^Prior([1-4])Year(?:Duration|Instant)$", 1).try_cast("int")
    year = context.rlike("^(?:Current|Prior[1-4])Year(?:Duration|Instant)$")
    half = context.rlike("^(?:Prior1)?Interim(?:Duration|Instant)$")
    n = F.coalesce(back, F.lit(0))
    offset = F.when(F.col("doc_period") == "FY", n).otherwise(F.greatest(n - 1, F.lit(0)))
    end = F.when(year, year_end_back(F.col("fy_end"), offset)).when(half, F.when(context.startswith("Prior1"), F.col("prior_interim_end")).otherwise(F.col("interim_end")))
    made = rows.withColumns({"period_end": end, "period_type": F.when(year, "FY").when(half, "HY"), "alone": F.col("context").endswith(ALONE)})
    return made.where("period_type is not null and period_end is not null")


def valued(rows: DataFrame) -> DataFrame:
    """Numbers in their unit; rows without one or in a unit that doesn't fit go."""
    bare = F.trim("value")
    number = F.when(~bare.isin("－", "-", ""), F.regexp_replace(bare, ",", "")).try_cast("double")
    u = F.trim("unit_id")
    unit = (
        F.when(u == "JPY", "JPY").when(u == "JPYPerShares", "JPY/share").when(u == "shares", "shares")
        .when((u == "pure") & F.col("item").isin(*PERCENT), "%").when((u == "pure") & (F.col("item") == "per"), "times")
    )
    scaled = F.bround(number * F.when(unit == "%", 100.0).otherwise(1.0), 10)
    return rows.withColumns({"number": scaled, "unit": unit}).where("number is not null and unit is not null")


def one_each(rows: DataFrame) -> DataFrame:
    """Of several rows of an item and period the one whose element doesn't stand in, then the first."""
    key = ["file", "period_end", "period_type", "item", "alone"]
    best = rows.groupBy(*key).agg(F.min_by(F.struct("number", "unit"), F.struct("fallback", "pos")).alias("v"))
    return best.select(*key, "v.number", "v.unit")


def based(rows: DataFrame) -> DataFrame:
    """Consolidated facts where a file has any, else the company's own; four items are taken from the latter if missing."""
    file = Window.partitionBy("file")
    cell = Window.partitionBy("file", "period_end", "period_type", "item")
    marked = rows.withColumns({"group": F.bool_or(~F.col("alone")).over(file), "both": F.bool_or(~F.col("alone")).over(cell)})
    extra = F.col("group") & F.col("alone") & F.col("item").isin(*COMPANY_LEVEL) & ~F.col("both")
    basis = F.when(F.col("group"), "consolidated").otherwise("nonconsolidated")
    return marked.where((F.col("alone") != F.col("group")) | extra).select("file", "period_end", "period_type", "item", "number", "unit", basis.alias("basis"))


def latest_period(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``file, period_end``: the latest of a file's rows, else the one its document tells."""
    ends = rows.groupBy("file").agg(F.max("period_end").alias("latest"))
    return docs.join(ends, "file", "left").select("file", F.coalesce("latest", "period_end").alias("period_end"))


def availability(years: Column, interims: Column) -> Column:
    """full with any yearly period, interim with half-years only, else none."""
    return F.when(years > 0, "full").when(interims > 0, "interim").otherwise("none")


# ---- series --------------------------------------------------------------------------------------------------------
def pct_change(before: Column, now: Column) -> Column:
    """Against the size of what was before; null over a zero or a change of sign."""
    return F.when((before != 0) & ((before > 0) == (now > 0)), (now - before) / F.abs(before) * 100)


def blocked(before: Column, now: Column) -> Column:
    """Why there is no growth."""
    return F.when(before == 0, "zero before").when((before < 0) & (now > 0), "loss to profit").when((before > 0) & (now < 0), "profit to loss")


def present(history: Column) -> Column:
    return F.array_compact(history)


def steps(history: Column) -> Column:
    """Growth of each entry; the first has none."""
    return F.transform(history, lambda x, i: F.when(i > 0, pct_change(F.get(history, i - 1), x)))


def cagr(history: Column) -> Column:
    """Over the entries there are; null from zero or over a change of sign."""
    v = present(history)
    n = F.size(v) - 1
    first, last = F.get(v, F.lit(0)), F.get(v, n)
    return F.when((n >= 1) & (first != 0) & ((first < 0) == (last < 0)) & (last / first >= 0), (F.pow(last / first, 1.0 / n) - 1) * 100)


def position(history: Column) -> Column:
    """Of the last value between the least and the largest, 0 to 100; 50 if they are one."""
    v = present(history)
    lo, hi = F.array_min(v), F.array_max(v)
    last = F.get(v, F.size(v) - 1)
    return F.when(F.size(v) >= 2, F.when(hi == lo, 50.0).otherwise((last - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100))


def trend(history: Column, mode: Column, sign: Column) -> Column:
    """better, worse or flat by the mean of the last two steps between values there are."""
    v = present(history)
    n = F.size(v)

    def step(a: Column, b: Column) -> Column:
        return F.when(mode == "pct", pct_change(a, b)).otherwise(b - a)

    last = step(F.get(v, n - 2), F.get(v, n - 1))
    earlier = F.when(n >= 3, step(F.get(v, n - 3), F.get(v, n - 2)))
    rate = sign * F.when(last.isNotNull() & earlier.isNotNull(), (last + earlier) / 2).otherwise(F.coalesce(last, earlier))
    limit = F.when(mode == "pt", 0.5).otherwise(5.0)
    return F.when(mode.isNotNull() & (n >= 2) & rate.isNotNull(), F.when(rate > limit, "better").when(rate < -limit, "worse").otherwise("flat"))


def histories(facts: DataFrame) -> DataFrame:
    """``symbol, period_end, item, value`` -> ``symbol, ends, h``: of the last periods, a map of item to values in order."""
    wide = facts.where("value is not null").groupBy("symbol", "period_end").agg(F.collect_list(F.struct("item", "value")).alias("items"))
    all_ = wide.groupBy("symbol").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("period_end", "items")))), 1, PERIODS).alias("p"))
    as_map = lambda x: F.struct(x["period_end"].alias("period_end"), F.map_from_entries(x["items"]).alias("items"))
    return all_.select("symbol", F.transform(F.reverse("p"), as_map).alias("p"))


def with_derived(series: DataFrame) -> DataFrame:
    """A column of values in order of period for every metric, growth and ratios included."""
    def of(item: str) -> Column:
        return F.transform("p", lambda x: F.try_element_at(x["items"], F.lit(item))).alias(item)

    raw = ("revenue", "net_income", "eps", "total_assets", "net_assets", "equity", "operating_cf", "roe", "equity_ratio", "per", "payout_ratio", "investing_cf")
    base = series.select("symbol", F.transform("p", lambda x: x["period_end"]).alias("ends"), *map(of, raw))

    def pairs(a: str, b: str, f) -> Column:
        return F.zip_with(F.col(a), F.col(b), f)

    cash = F.arrays_zip("net_income", "operating_cf", "total_assets")
    derived = {f"{k}_growth": steps(F.col(k)) for k in ("revenue", "net_income", "eps")} | {
        "operating_cf_margin": pairs("operating_cf", "revenue", lambda c, r: c / F.nullif(r, F.lit(0.0)) * 100),
        "free_cash_flow": pairs("operating_cf", "investing_cf", lambda c, i: c + i),
        "accruals": F.transform(cash, lambda x: (x["net_income"] - x["operating_cf"]) / F.nullif(x["total_assets"], F.lit(0.0)) * 100),
    }
    return base.withColumns(derived)


def metrics(derived: DataFrame) -> DataFrame:
    """A row a symbol and metric: value, change, CAGR, trend, position, in the fixed order; ``n_values`` counts the values there are."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("metric_no"), F.lit(k).alias("metric"), F.lit(u).alias("unit"), F.lit(m).cast("string").alias("mode"), F.lit(float(s)).alias("sign"), F.col(k).alias("h"))
        for i, (k, u, m, s) in enumerate(METRICS, 1)
    ])
    flat = derived.select("symbol", F.explode(rows).alias("x")).select("symbol", "x.*")
    h = F.col("h")
    last, before = F.get(h, F.size(h) - 1), F.get(h, F.size(h) - 2)
    change = F.when(F.col("unit") == "%", last - before).otherwise(pct_change(before, last))
    return flat.select(
        "symbol", "metric_no", "metric", "unit", last.alias("value"), change.alias("change"),
        F.when(F.col("unit").isin("JPY", "JPY/share"), cagr(h)).alias("cagr"), trend(h, F.col("mode"), F.col("sign")).alias("trend"), position(h).alias("position"),
        F.size(present(h)).alias("n_values"),
    )
