"""Queries of ingest control, metering and scalar functions, with their SQL."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import BARS, USAGE, bars, table, usage_events
from ..functions import html
from ..functions import scalars as sc
from ..operators import control, metering, supply
from ..operators import fundamentals as fin
from ..sources import files
from ..streaming import rates
from .bars import rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(key: str, sql: str | None):
    def add(f):
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


TODAY, NOW = "2024-01-31", "2024-01-31 12:00:00"
_LOG = """log AS (SELECT CAST(ts AS DATE) AS day, CASE dayofmonth(min(ts)) % 7 WHEN 0 THEN 'error: x' WHEN 1 THEN 'empty' ELSE 'ok' END AS result,
  CAST(max(ts) AS TIMESTAMP) + to_hours(CAST(dayofmonth(min(ts)) % 30 AS BIGINT)) AS fetched_at FROM events GROUP BY 1)"""
_FINAL = "coalesce(result IN ('ok', 'empty') AND fetched_at >= CAST(day AS TIMESTAMP) + INTERVAL '15 hours 30 minutes', false)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    by = table(spark, sf_dir, "events").groupBy(F.to_date(ts).alias("day")).agg(F.max(ts).alias("last"))
    d = F.day("day")
    result = F.when(d % 7 == 0, "error: x").when(d % 7 == 1, "empty").otherwise("ok")
    return by.select("day", result.alias("result"), (F.col("last") + F.make_interval(hours=d % 30)).alias("fetched_at"))


def _date(text: str):
    return F.lit(text).cast("date")


@_query("is_finalized", f"WITH {_LOG} SELECT day, result, {_FINAL} AS final FROM log")
def _finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("day", "result", control.is_final(F.col("day"), F.col("result"), F.col("fetched_at")).alias("final"))


@_query("pending_dates", f"""WITH {_LOG}, d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-20', DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT d.day FROM d LEFT JOIN log ON log.day = d.day WHERE (NOT {_FINAL.replace("day AS", "d.day AS")} OR d.day > DATE '{TODAY}' - 3)
  AND NOT (d.day = DATE '{TODAY}' AND coalesce(fetched_at > TIMESTAMP '{NOW}' - INTERVAL 60 SECONDS, false)) ORDER BY 1 DESC LIMIT 20""")
def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = control.spine(spark, _date("2023-12-20"), _date(TODAY))
    return control.pending_dates(days, _log(spark, sf_dir), _date(TODAY), F.lit(NOW).cast("timestamp"), 3, 20)


@_query("fetch_range", f"""WITH {BARS} SELECT greatest(min("date"), CAST(DATE '2008-02-29' - INTERVAL 120 MONTHS AS DATE)) AS "start", DATE '2008-02-29' AS "end" FROM bars""")
def _fetch_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.fetch_range(bars(spark, sf_dir), _date("2008-02-29"))


@_query("fy_shift", """SELECT d AS day, k AS years, CASE WHEN d = last_day(d) THEN last_day(CAST(d - to_months(12 * k) AS DATE)) ELSE CAST(d - to_months(12 * k) AS DATE) END AS shifted
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), (SELECT CAST(unnest(range(1, 5)) AS INT) AS k)""")
def _fy_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    each = days.withColumn("years", F.explode(F.array(*[F.lit(k) for k in range(1, 5)])))
    return each.withColumn("shifted", control.year_end_back(F.col("day"), F.col("years")))


@_query("last_weekday", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderdate AS DATE) - CAST(greatest(isodow(o_orderdate) - 5, 0) AS INT) AS DATE) AS weekday FROM orders")
def _weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.withColumn("weekday", control.last_weekday(F.col("day")))


@_query("freshness", f"WITH {_LOG} SELECT day, coalesce(result = 'ok' AND fetched_at > TIMESTAMP '{NOW}' - INTERVAL 240 HOURS, false) AS fresh FROM log")
def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("day", control.is_fresh(F.col("result"), F.col("fetched_at"), F.lit(NOW).cast("timestamp"), 240).alias("fresh"))


@_query("freshness_reason", f"""WITH {_LOG} SELECT day, CASE WHEN result <> 'ok' THEN 'missing' WHEN fetched_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAYS THEN 'stale'
  WHEN dayofmonth(day) % 2 = 0 THEN 'empty_table' ELSE 'fresh' END AS reason FROM log""")
def _reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("day", control.staleness(F.col("result"), F.col("fetched_at"), F.day("day") % 2, F.lit(NOW).cast("timestamp")).alias("reason"))


@_query("fail_runs", f"""WITH {_LOG}, m AS (SELECT *, row_number() OVER (ORDER BY day) - row_number() OVER (PARTITION BY result = 'ok' ORDER BY day) AS run FROM log)
SELECT min(day) AS "start", max(day) AS "end", count(*) AS n FROM m WHERE result <> 'ok' GROUP BY run""")
def _fails(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).select(F.lit("edge").alias("symbol"), F.col("day").alias("date"), "result")
    return supply.runs(log, F.col("result") != "ok").drop("symbol")


@_query("estimate_fetch", f"""WITH {_LOG} SELECT count(*) FILTER (NOT f) AS targets, count(*) FILTER (f) AS skipped, count(*) FILTER (NOT f) * 10 AS seconds
FROM (SELECT coalesce(result = 'ok' AND fetched_at > TIMESTAMP '{NOW}' - INTERVAL 240 HOURS, false) AS f FROM log)""")
def _estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if(~F.col("fresh"))
    return _fresh(spark, sf_dir).agg(n.alias("targets"), F.count_if("fresh").alias("skipped"), (n * 10).alias("seconds"))


@_query("stale_symbols", f"""WITH {BARS} SELECT symbol, count(*) AS bars, count(*) FILTER (symbol <> 'N' OR volume % 50 <> 0) AS rows_stored FROM bars GROUP BY 1 HAVING bars <> rows_stored""")
def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = bars(spark, sf_dir)
    stored = all_.where("symbol <> 'N' or volume % 50 <> 0").groupBy("symbol").agg(F.count("*").alias("rows_stored"))
    have = all_.groupBy("symbol").agg(F.count("*").alias("bars"))
    return have.join(stored, "symbol", "left").withColumn("rows_stored", F.coalesce("rows_stored", F.lit(0))).where("bars <> rows_stored")


# ---- metering ------------------------------------------------------------------------------------------------------
@_query("usage_daily", f"""WITH {USAGE} SELECT model, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS day, count(*) FILTER (is_request) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens
FROM usage GROUP BY 1, 2""")
def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.daily(usage_events(spark, sf_dir))


@_query("rate_window_60s", f"""WITH {USAGE} SELECT event_id, count(*) FILTER (is_request) OVER w AS requests_60s, CAST(sum(tokens) OVER w AS BIGINT) AS tokens_60s FROM usage
WINDOW w AS (PARTITION BY model ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""")
def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.trailing_minute(usage_events(spark, sf_dir)).select("event_id", "requests_60s", "tokens_60s")


@_query("rate_stream_60s", ORACLE_SQL["rate_window_60s"])
def _rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.trailing_minute(usage_events(spark, sf_dir)).select("event_id", "requests_60s", "tokens_60s")


_AT = "CAST('2024-01-15 12:00:00' AS TIMESTAMP)"


@_query("rate_wait", f"""WITH {USAGE}, u AS (SELECT model, {_AT} - (({_AT} - ts) / 1000) AS ts, tokens, is_request, event_id FROM usage WHERE ts <= {_AT}),
l AS (SELECT model, is_request, (epoch_us(ts) + 60000000 - epoch_us({_AT})) / 1e6 AS lft, sum(tokens) OVER (PARTITION BY model) AS t, sum(tokens) OVER w AS g,
    count(*) FILTER (is_request) OVER (PARTITION BY model) AS r, count(*) FILTER (is_request) OVER w AS gr
  FROM u WHERE ts > {_AT} - INTERVAL 60 SECONDS WINDOW w AS (PARTITION BY model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT model, round(greatest(CASE WHEN max(r) < 10 THEN 0 ELSE coalesce(min(CASE WHEN is_request AND r - gr < 10 THEN lft END), 0) END,
  CASE WHEN max(t) + 50 <= 900 THEN 0 ELSE coalesce(min(CASE WHEN t - g + 50 <= 900 THEN lft END), max(lft)) END), 2) + 0.0 AS wait_s FROM l GROUP BY 1""")
def _waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-15 12:00:00").cast("timestamp")
    # a thousand times as dense, so that the last minute has many events
    dense = F.timestamp_micros(F.unix_micros(at) - F.floor((F.unix_micros(at) - F.unix_micros("ts")) / 1000))
    events = usage_events(spark, sf_dir).where(F.col("ts") <= at).withColumn("ts", dense)
    return metering.waits(events, at, 10, 900, 50).withColumn("wait_s", F.round("wait_s", 2) + 0.0)


_LIMITS = "limits AS (SELECT * FROM (VALUES ('click', 40, 3000, true), ('view', 100000, 200, true), ('purchase', 0, 0, true), ('nothing', 10, 10, false)) t(model, per_day, per_minute, configured))"


def _limits(spark: SparkSession) -> DataFrame:
    rows = [("click", 40, 3000, True), ("view", 100000, 200, True), ("purchase", 0, 0, True), ("nothing", 10, 10, False)]
    return spark.createDataFrame(rows, "model string, per_day int, per_minute int, configured boolean")


_SNAP = f"""{USAGE}, {_LIMITS}, today AS (SELECT model, count(*) FILTER (is_request) AS used, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage
    WHERE CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) = DATE '2024-01-20' GROUP BY 1),
snap AS (SELECT l.*, coalesce(used, 0) AS used, coalesce(tokens, 0) AS tokens, CASE WHEN per_day > 0 THEN greatest(per_day - coalesce(used, 0), 0) END AS remaining FROM limits l LEFT JOIN today t ON t.model = l.model)"""


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = metering.daily(usage_events(spark, sf_dir)).where("day = date '2024-01-20'").select("model", F.col("requests").alias("used"), "tokens")
    both = _limits(spark).join(used, "model", "left").fillna(0, ["used", "tokens"])
    return both.withColumn("remaining", F.when(F.col("per_day") > 0, F.greatest(F.col("per_day") - F.col("used"), F.lit(0))))


@_query("quota_snapshot", f"WITH {_SNAP} SELECT model, per_day, used, tokens, remaining FROM snap")
def _snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).select("model", "per_day", "used", "tokens", "remaining")


@_query("quota_decision", f"""WITH {_SNAP} SELECT model, CASE WHEN NOT configured THEN 'unconfigured' WHEN per_day > 0 AND used >= per_day THEN 'daily_limit'
  WHEN per_minute > 0 AND 500 > per_minute THEN 'too_large' ELSE 'ok' END AS decision FROM snap""")
def _decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metering.decision(F.col("configured"), F.lit(False), F.col("used"), F.col("per_day"), F.lit(500), F.col("per_minute"))
    return _snapshot(spark, sf_dir).select("model", made.alias("decision"))


_QUOTA = "('Generate' || CASE event_id % 3 WHEN 0 THEN 'RequestsPerDay' WHEN 1 THEN 'TokensPerMinute' ELSE 'Other' END || '-FreeTier')"


@_query("quota_scope", f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'minute' ELSE 'unknown' END AS scope, event_id % 3 <> 1 AS exhausts,
  CASE WHEN event_id % 4 <> 0 THEN (event_id % 50) + 0.5 END AS wait_s FROM events""")
def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    quota = F.concat(F.lit("Generate"), F.when(e % 3 == 0, "RequestsPerDay").when(e % 3 == 1, "TokensPerMinute").otherwise("Other"), F.lit("-FreeTier"))
    delay = F.when(e % 4 != 0, F.concat((e % 50).cast("string"), F.lit(".5s"))).otherwise("soon")
    scope = metering.scope(quota)
    return table(spark, sf_dir, "events").select("event_id", scope.alias("scope"), (scope != "minute").alias("exhausts"), metering.seconds_of(delay).alias("wait_s"))


# ---- scalars -------------------------------------------------------------------------------------------------------
@_query("src_bars_clean", """SELECT symbol, "date", price FROM (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS "date", CASE WHEN l_quantity >= 2 THEN l_extendedprice END AS price,
  row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem WHERE l_quantity >= 2) WHERE n = 1""")
def _clean_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import merge

    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_quantity") >= 2, F.col("l_extendedprice")).alias("price"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
    )
    return merge.latest(raw.dropna(subset=["price"]), ["symbol", "date"], [F.col("seq")]).select("symbol", "date", "price")


@_query("search_rank", """SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY CASE WHEN p_partkey = 7 THEN 0 ELSE 1 END, p_partkey) AS INT) AS position FROM part
WHERE p_name ILIKE '%' || (SELECT split_part(p_name, ' ', 1) FROM part WHERE p_partkey = 7) || '%' OR p_partkey = 7 QUALIFY position <= 20""")
def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    word = parts.where("p_partkey = 7").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).limit(1)
    hits = parts.join(F.broadcast(word), F.expr("p_name ilike concat('%', word, '%') or p_partkey = 7"))
    top = hits.orderBy(F.when(F.col("p_partkey") == 7, 0).otherwise(1), "p_partkey").limit(20)
    order = Window.orderBy(F.when(F.col("p_partkey") == 7, 0).otherwise(1), "p_partkey")
    return top.select("p_partkey", "p_name", F.row_number().over(order).alias("position"))


@_query("scrub_number", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN floor(o_totalprice) WHEN 2 THEN -12.5 ELSE floor(o_totalprice) END AS value FROM orders""")
def _scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.format_number(F.floor("o_totalprice"), 0)
    cell = F.when(k % 4 == 0, "-").when(k % 4 == 1, price).when(k % 4 == 2, " -12.5% ").otherwise(F.concat(price, F.lit("株")))
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.scrub_number(cell, "株").alias("value"))


@_query("fmt_trim", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN s = '-0' THEN '0' ELSE s END AS text FROM (
  SELECT *, regexp_replace(printf('%.4f', l_discount - l_tax), '\\.?0+$', '') AS s FROM lineitem)""")
def _trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", sc.trimmed_number(F.col("l_discount") - F.col("l_tax")).alias("text"))


@_query("clean_str", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer")
def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", sc.clean(raw).alias("name"))


@_query("viewer_url", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'https://viewer.example/doc?id=S' || o_orderkey END AS url FROM orders")
def _url(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "S/").otherwise("S"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.viewer_url(doc).alias("url"))


@_query("url_param", "SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&](?:page|utm_source)=([^&#]*)', 1), ''), 'none') AS value FROM pages")
def _param(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    value = F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("page")), F.try_parse_url(url, F.lit("QUERY"), F.lit("utm_source")), F.lit("none"))
    return table(spark, sf_dir, "pages").select("page_id", value.alias("value"))


@_query("mask_secret", "SELECT c_custkey, 'https://x.example/?Api_Key=***&b=' || c_custkey AS text FROM customer")
def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("https://x.example/?Api_Key="), "c_name", F.lit("&b="), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", sc.mask_secrets(F.regexp_replace(text, "[# ]", "_")).alias("text"))


@_query("num_tokens", r"""SELECT doc_id, len(t) AS n, array_to_string(t, ';') AS tokens FROM (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(\d{4}-\d{2}-\d{2}|-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)') AS t FROM documents)""")
def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", sc.number_tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", ";").alias("tokens"))


_EDGE = "[ \\t\\r\\n\\f\\x0B\\xA0　]+"


@_query("html_to_text", rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', chr(1), 'g'), '(?is)<style\b.*?</style\s*>', chr(1), 'g'),
  '(?is)<head\b.*?</head\s*>', chr(1), 'g') AS t FROM pages),
b AS (SELECT page_id, string_split(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', chr(1), 'g'), '(?s)<[^>]*>', chr(1), 'g'), chr(1)) AS l FROM a),
c AS (SELECT page_id, list_transform(l, lambda x: regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'),
  '^{_EDGE}|{_EDGE}$', '', 'g')) AS l FROM b)
SELECT page_id, regexp_replace(array_to_string(list_filter(l, lambda x: x <> ''), chr(10)), '\n\s*\n+', chr(10) || chr(10), 'g') AS text FROM c""")
def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.text_of(F.col("html")).alias("text"))


@_query("fmt_units", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN format('{:,}', CAST(floor(o_totalprice) * 7 AS BIGINT)) || ' M' WHEN 1 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '.25'
  ELSE format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '.5%' END AS text FROM orders""")
def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, base = F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    unit = F.when(k % 3 == 0, "JPY").when(k % 3 == 1, "JPY/share").otherwise("%")
    value = F.when(k % 3 == 0, base * 7e6).when(k % 3 == 1, base + 0.25).otherwise(base + 0.5)
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.with_unit(value, unit).alias("text"))


@_query("scale_unit", f"""WITH {BARS} SELECT symbol, CASE WHEN m >= 1e12 THEN 1e12 WHEN m >= 1e8 THEN 1e8 WHEN m >= 1e6 THEN 1e6 ELSE 1.0 END AS scale FROM (
  SELECT symbol, max(abs("close" * volume)) AS m FROM bars GROUP BY 1)""")
def _scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("symbol").agg(sc.scale(F.max(F.abs(F.col("close") * F.col("volume")))).alias("scale"))


@_query("thin_axis", f"""WITH {BARS}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) SELECT DISTINCT symbol, CAST(round_even(i * (n - 1) / 6.0, 0) AS INT) AS i FROM n, (SELECT unnest(range(0, 7)) AS i)""")
def _thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").cast("int").alias("n"))
    return n.select("symbol", F.explode(sc.thin(F.col("n"), 7)).alias("i"))


@_query("axis_domain", f"""WITH {BARS}, m AS (SELECT symbol, min(low) AS a, max(high) AS b FROM bars GROUP BY 1) SELECT symbol, round(a - (b - a) * 0.08, 4) + 0.0 AS lo, round(b + (b - a) * 0.08, 4) + 0.0 AS hi FROM m""")
def _axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bars(spark, sf_dir).groupBy("symbol").agg(F.min("low").alias("a"), F.max("high").alias("b"))
    return rounded(made.select("symbol", sc.axis(F.col("a"), F.col("b")).alias("x")).select("symbol", "x.*"), "symbol", "lo", "hi")


@_query("reports_topn", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def _topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    return rows.orderBy(F.desc("created_at"), F.desc("o_orderkey")).limit(30)


@_query("html_table_extract", """WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS calc_date, CAST(o_orderkey % 3 AS VARCHAR) AS holder_id, o_orderkey, o_totalprice, o_orderstatus FROM orders)
SELECT o_custkey, calc_date, holder_id, 'Holder ' || o_orderkey AS holder, (o_orderkey % 500) / 100.0 AS ratio, CAST(floor(o_totalprice) AS BIGINT) AS quantity, CASE WHEN o_orderstatus = 'F' THEN '消失' END AS note FROM d
QUALIFY row_number() OVER (PARTITION BY o_custkey, calc_date, holder_id ORDER BY o_orderkey DESC) = 1""")
def _html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = F.col("o_orderkey"), lambda c: c.cast("string")
    cells = (
        F.date_format("o_orderdate", "yyyy/MM/dd"), F.concat(F.lit("<a href='/x/?f="), text(key % 3), F.lit("'>Holder "), text(key), F.lit("</a>")),
        F.concat(F.format_string("%.2f", key % 500 / 100.0), F.lit("%")), F.lit(""), F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit("株")), F.lit("-"),
        F.when(F.col("o_orderstatus") == "F", "消失").otherwise(""),
    )
    row = F.concat(F.lit("<tr class='obb'>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), row.alias("row")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["row"]), "")
    html = F.concat(F.lit("<table><tr class='obb'><td>other</td></tr></table><table id='sort'>"), body, F.lit("</table>"))
    found = files.short_positions(files.html_rows(pages.select(text(F.col("o_custkey")).alias("path"), F.encode(html, "UTF-8").alias("content"))))
    return found.select(F.col("path").cast("long").alias("o_custkey"), "calc_date", "holder_id", "holder", "ratio", "quantity", "note")


# ---- files whose bytes are derived from tables ---------------------------------------------------------------------
def _lines(rows: DataFrame, key: Column, order: str, line: Column) -> DataFrame:
    """``path, body``: the lines of each file, in order."""
    by = rows.groupBy(key.cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("line")))).alias("rows"))
    return by.select("path", F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("body"))


def _cp932(text: str) -> str:
    """The bytes of a fixed text in cp932, as characters: a whole file of such characters is encoded by Spark as ISO-8859-1."""
    return text.encode("cp932").decode("latin-1")


def _stored(members: list) -> bytes:
    """A ZIP of names and texts, not compressed. Most of zipfile's time for members of a line goes to what is the same in all."""
    if len(members) >= 0xFFFF:  # what the short form of the directory can't count
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for name, text in members:
                archive.writestr(name, text)
        return out.getvalue()
    body, directory = bytearray(), bytearray()
    for name, text in members:
        name, data = name.encode(), text.encode()
        head = struct.pack("<5H3L2H", 20, 0, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(name), 0)
        directory += b"PK\1\2\24\0" + head + struct.pack("<3H2L", 0, 0, 0, 0, len(body)) + name
        body += b"PK\3\4" + head + name + data
    return bytes(body + directory + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(members), len(members), len(directory), len(body), 0))


def _zipped(member: str, encoding: str):
    @F.pandas_udf(T.BinaryType())
    def pack(text: pd.Series) -> pd.Series:
        def one(t: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as archive:
                archive.writestr(member, t.encode(encoding))
            return out.getvalue()

        return text.map(one)

    return pack


@_query("margin_parse", """SELECT CAST(o_custkey % 100 AS VARCHAR) AS path, CAST(1000 + o_orderkey % 9000 AS VARCHAR) AS code, CAST(o_orderdate AS DATE) AS "date",
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + 2 END AS settle_date, CASE WHEN o_orderkey % 3 = 0 THEN 'final' ELSE 'prelim' END AS kind, o_orderkey % 3 <> 2 AS kind_known,
  o_orderkey AS yushi_new, CAST(NULL AS BIGINT) AS yushi_repay, CAST(floor(o_totalprice) AS BIGINT) AS yushi_balance, CAST(NULL AS BIGINT) AS kashi_new, -o_orderkey AS kashi_repay,
  CAST(0 AS BIGINT) AS kashi_balance, CAST(1234567 AS BIGINT) AS net_balance FROM orders WHERE o_orderstatus <> 'O'""")
def _margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day, quoted = F.col("o_orderkey"), lambda c: F.date_format(c, "yyyy/MM/dd"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    settled = F.when(key % 8 == 0, "soon").when(key % 4 == 0, "").otherwise(day(F.date_add(F.to_date("o_orderdate"), 2)))
    jp = lambda t: F.lit(_cp932(t))
    cells = (
        day(F.to_date("o_orderdate")), settled, (1000 + key % 9000).cast("string"), F.when(F.col("o_orderstatus") == "O", jp("名証")).otherwise(jp("東証およびPTS")),
        F.when(key % 3 == 0, jp(" 確報 ")).when(key % 3 == 1, jp("速報")).otherwise(jp("暫定")), key.cast("string"), F.lit("-"), quoted(F.format_number(F.floor("o_totalprice"), 0)),
        F.lit(""), (-key).cast("string"), F.lit("0"), quoted(F.lit("1,234,567")),
    )
    made = _lines(table(spark, sf_dir, "orders"), F.col("o_custkey") % 100, "o_orderkey", F.concat_ws(",", *cells))
    content = F.encode(F.concat(jp(",".join(files.MARGIN) + "\n"), "body", F.lit("\n")), "ISO-8859-1")
    return files.margin_rows(made.select("path", content.alias("content")))


_CODE_COLUMNS = {"ＥＤＩＮＥＴコード": "edinet_code", "証券コード": "sec_code", "提出者名": "name"}


@_query("codelist_parse", """SELECT 'E' || c_custkey AS edinet_code, CASE WHEN c_custkey % 3 <> 0 THEN CAST(10000 + c_custkey AS VARCHAR) END AS sec_code, c_name || ', ' || c_mktsegment AS name FROM customer""")
def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.concat(F.lit('"'), "c_name", F.lit(", "), "c_mktsegment", F.lit('"'))
    line = F.concat_ws(",", F.lit("x"), F.concat(F.lit(" E"), key.cast("string")), name, F.when(key % 3 == 0, " ").otherwise((10000 + key).cast("string")))
    made = _lines(table(spark, sf_dir, "customer"), key % 20, "c_custkey", line)
    head = "ダウンロード実行日,1件\n種別,ＥＤＩＮＥＴコード,提出者名,証券コード\n"
    content = _zipped("EdinetcodeDlInfo.csv", "cp932")(F.concat(F.lit(head), "body", F.lit("\n,,,\n")))
    return files.code_list(made.select("path", content.alias("content")), "EdinetcodeDlInfo.csv", _CODE_COLUMNS)


@_query("filings_parse", """SELECT 'S' || o_orderkey AS doc_id, CAST(o_custkey AS VARCHAR) AS filer, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'Co ' || o_custkey END AS filer_name, '120' AS doc_type,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-01-01') END AS period_start, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-12-31') END AS period_end,
  strftime(o_orderdate, '%Y-%m-%d') || ' 10:00' AS submitted, CAST(o_orderkey % 3 AS INT) AS withdrawal, CASE WHEN o_orderkey % 7 <> 0 THEN 1 END AS disclosure,
  CASE WHEN o_orderkey % 4 = 0 THEN '{"n":' || o_orderkey || '}' END AS extra, o_orderpriority AS priority
FROM orders WHERE o_orderstatus <> 'P'""")
def _filing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = F.col("o_orderkey"), lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    day = F.col("o_orderdate")
    fields = {
        "docID": text(F.concat(F.lit("S"), key.cast("string"))), "edinetCode": text(F.col("o_custkey")), "docTypeCode": F.when(F.col("o_orderstatus") != "P", text(F.lit("120"))),
        "filerName": F.when(key % 5 == 0, key.cast("string")).otherwise(text(F.concat(F.lit("Co "), F.col("o_custkey").cast("string")))),  # a number now and then
        "periodStart": F.when(key % 2 == 0, text(F.date_format(day, "yyyy-01-01"))).otherwise(text(F.lit(" "))), "periodEnd": F.when(key % 2 == 0, text(F.date_format(day, "yyyy-12-31"))),
        "submitDateTime": text(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:00"))), "withdrawalStatus": F.when(key % 2 == 0, text(key % 3)).otherwise((key % 3).cast("string")),
        "disclosureStatus": F.when(key % 7 == 0, text(F.lit("?"))).otherwise(text(F.lit("1"))), "extra": F.when(key % 4 == 0, F.concat(F.lit('{"n":'), key.cast("string"), F.lit("}"))),
        "priority": text(F.col("o_orderpriority")),
    }
    item = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), v) for n, v in fields.items()]), F.lit("}"))
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.concat_ws(",", F.collect_list(item)).alias("results"))
    list_ = F.concat(F.lit('{"metadata":{"status":"200"},"results":['), "results", F.lit("]}"))
    docs, _ = files.split_stubs(files.filing_rows(days.select(list_.alias("text")).unionAll(spark.createDataFrame([("{ not json",)], "text string"))))
    return docs.select(
        F.col("docID").alias("doc_id"), F.col("edinetCode").alias("filer"), F.col("filerName").alias("filer_name"), F.col("docTypeCode").alias("doc_type"),
        F.col("periodStart").alias("period_start"), F.col("periodEnd").alias("period_end"), F.col("submitDateTime").alias("submitted"), F.col("withdrawalStatus").alias("withdrawal"),
        F.col("disclosureStatus").alias("disclosure"), F.try_element_at("other", F.lit("extra")).alias("extra"), F.try_element_at("other", F.lit("priority")).alias("priority"),
    )


@_query("filing_text", """SELECT CAST(o_custkey AS VARCHAR) AS path, 'Of ' || o_custkey AS title, string_agg('Order ' || o_orderkey || chr(10) || o_orderstatus, chr(10) || chr(10) ORDER BY o_orderkey) AS text, false AS truncated
FROM orders GROUP BY o_custkey""")
def _filing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    page = F.concat(F.lit("<html><head><title>Of "), F.col("o_custkey").cast("string"), F.lit("</title></head><body><p>Order "), key.cast("string"), F.lit("</p><td> "), "o_orderstatus", F.lit("</td></body></html>"))
    named = F.concat(F.format_string("XBRL/PublicDoc/%012d.htm\n", key), page)
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.collect_list(named).alias("pages"))

    @F.pandas_udf(T.BinaryType())
    def pack(pages: pd.Series) -> pd.Series:
        def one(found) -> bytes:
            return _stored([("XBRL/AuditDoc/a.htm", "<p>left out</p>"), *[p.split("\n", 1) for p in found]])

        return pages.map(one)

    return files.filing_texts(by.select("path", pack("pages").alias("content")))


# ---- more scalars --------------------------------------------------------------------------------------------------
@_query("exchange_name", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '東証' WHEN 1 THEN 'NASDAQ' WHEN 2 THEN 'NYSE Arca' WHEN 3 THEN 'Somewhere' ELSE 'XXX' END AS name FROM customer""")
def _exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    code = F.when(k == 0, "TYO").when(k == 1, "NGM").when(k == 2, "PCX").otherwise("XXX")
    return table(spark, sf_dir, "customer").select("c_custkey", sc.exchange_name(code, F.when(k == 3, "Somewhere")).alias("name"))


@_query("domestic_symbols", """SELECT o_orderkey, regexp_matches(code, '^[0-9]{3}[0-9A-Z]$') AS is_code FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(1000 + o_orderkey % 9000 AS VARCHAR)
  WHEN 1 THEN CAST(100 + o_orderkey % 900 AS VARCHAR) || 'A' ELSE 'AB' || (o_orderkey % 90) END AS code FROM orders) WHERE o_orderkey % 3 <> 2 OR o_orderkey % 2 = 0""")
def _domestic(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    code = F.when(k % 3 == 0, (1000 + k % 9000).cast("string")).when(k % 3 == 1, F.concat((100 + k % 900).cast("string"), F.lit("A"))).otherwise(F.concat(F.lit("AB"), (k % 90).cast("string")))
    symbol = F.when((k % 3 == 2) & (k % 2 == 1), code).otherwise(F.concat(code, F.lit(".T")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", symbol.alias("symbol")).where(sc.is_domestic(F.col("symbol")))
    return rows.select("o_orderkey", sc.is_domestic_code(sc.split_code(F.col("symbol"))).alias("is_code"))


@_query("note_check", """SELECT CAST(o_orderkey % 5 AS INT) AS kind, count(*) AS n, count(*) FILTER (o_orderkey % 5 IN (3, 4)) AS unknown FROM orders GROUP BY 1""")
def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    note = F.when(k == 0, "報告義務消失").when(k == 1, "").when(k == 2, F.concat(F.lit("再IN（前回"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("）"))).when(k == 3, "再IN（前回）").otherwise("?")
    return table(spark, sf_dir, "orders").groupBy(k.cast("int").alias("kind")).agg(F.count("*").alias("n"), F.count_if(sc.unknown_note(note)).alias("unknown"))


@_query("compact_volume", f"""WITH {BARS} SELECT symbol, "date", CASE WHEN volume * 25000 >= 1e8 THEN format('{{:,.2f}}', volume * 25000 / 1e8) || '億' WHEN volume * 25000 >= 1e4 THEN format('{{:,.1f}}', volume * 25000 / 1e4) || '万'
  ELSE format('{{:,}}', volume * 25000) END AS text FROM bars""")
def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "date", sc.compact_volume(F.col("volume") * 25000).alias("text"))


@_query("delta_mark", f"""WITH {BARS}, p AS (SELECT symbol, "date", CASE WHEN volume % 7 = 0 THEN 0 ELSE "close" END AS now, lag(CASE WHEN volume % 7 = 0 THEN 0 ELSE "close" END) OVER (PARTITION BY symbol ORDER BY "date") AS before FROM bars)
SELECT symbol, "date", CASE WHEN before IS NULL THEN 'na' WHEN now > before THEN 'up' WHEN now < before THEN 'down' ELSE 'flat' END AS direction,
  CASE WHEN before IS NULL THEN '—' WHEN now = before THEN '→0.0%' WHEN now > before THEN '↑' || CASE WHEN before = 0 THEN '—' ELSE '+' || format('{{:,.1f}}%', abs(now - before) / abs(before) * 100) END
  ELSE '↓' || CASE WHEN before = 0 THEN '—' ELSE '-' || format('{{:,.1f}}%', abs(now - before) / abs(before) * 100) END END AS text FROM p""")
def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.when(F.col("volume") % 7 == 0, 0.0).otherwise(F.col("close"))
    before = F.lag(now).over(Window.partitionBy("symbol").orderBy("date"))
    return bars(spark, sf_dir).select("symbol", "date", sc.delta_mark(now, before).alias("d")).select("symbol", "date", "d.direction", "d.text")


@_query("range_place", f"""WITH {BARS}, d AS (SELECT *, least(low, "open") - 0.08 * (greatest(high, "open") - least(low, "open") + w * 2) - w AS lo, greatest(high, "open") + 0.08 * (greatest(high, "open") - least(low, "open") + w * 2) + w AS hi
  FROM (SELECT symbol, "date", high, low, "open", CASE WHEN low = high AND "open" = low THEN 1.0 ELSE 0.0 END AS w FROM bars))
SELECT symbol, "date", round((low - lo) / (hi - lo), 4) + 0.0 AS "start", round((high - lo) / (hi - lo), 4) + 0.0 AS "end", round(("open" - lo) / (hi - lo), 4) + 0.0 AS "at" FROM d""")
def _place(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bars(spark, sf_dir).select("symbol", "date", sc.range_place(F.col("high"), F.col("low"), F.col("open")).alias("x"))  # ends in either order
    return rounded(made.select("symbol", "date", "x.*"), "symbol", "date", "start", "end", "at")


@_query("series_millions", """SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_totalprice AS DOUBLE) / 1e6 END, 9) AS millions FROM orders""")
def _millions(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("amount"))
    series = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(point)).alias("s"))
    pairs = series.select(F.explode(F.arrays_zip(F.col("s.o_orderkey").alias("k"), sc.in_millions(F.col("s.amount")).alias("v"))).alias("x"))
    return pairs.select(F.col("x.k").alias("o_orderkey"), F.round("x.v", 9).alias("millions"))


@_query("escapes", """SELECT p_partkey, p_name || '\\|<b> & "' AS cell, 'a&amp;b &lt;' || p_name || '&gt; &quot;x&quot; &#x27;' AS html FROM part""")
def _escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell, html = F.concat("p_name", F.lit('|<b>\n& "')), F.concat(F.lit("a&b <"), "p_name", F.lit("> \"x\" '"))
    return table(spark, sf_dir, "part").select("p_partkey", sc.table_cell(cell).alias("cell"), sc.html_escaped(html).alias("html"))


@_query("replace_symbol", f"""WITH {BARS} SELECT symbol, "date", "close" FROM bars WHERE symbol <> 'R' UNION ALL SELECT symbol, "date", "close" * 2 FROM bars WHERE symbol = 'R' AND "date" >= DATE '1994-01-01'""")
def _replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import merge

    old = bars(spark, sf_dir).select("symbol", "date", "close")
    fresh = old.where("symbol = 'R' and date >= date '1994-01-01'").withColumn("close", F.col("close") * 2)
    return merge.replace_groups(old, fresh, "symbol")


@_query("availability", """SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'full' WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'interim' ELSE 'none' END AS availability FROM orders GROUP BY 1""")
def _availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [F.count_if(F.col("o_orderstatus") == s) for s in ("F", "P")]
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(fin.availability(*kinds).alias("availability"))


@_query("latest_period", """SELECT c_custkey AS file, coalesce(max(CAST(o_orderdate AS DATE)), DATE '2024-03-31') AS period_end FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.to_date("o_orderdate").alias("period_end"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), _date("2024-03-31").alias("period_end"))
    return fin.latest_period(rows, docs)
