"""Queries over series side by side, work in turn and what columns mean, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import BARS, FILINGS, bars, filings, table
from ..operators import context, series
from ..operators import indicators as ind
from .bars import FRAMES, PANEL, rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(key: str, sql: str):
    def add(f):
        QUERIES[key], ORACLE_SQL[key] = f, sql
        return f

    return add


_LINES = ("sma_short", "sma_mid", "sma_long")
_LONG = " UNION ALL ".join(f"""SELECT symbol, '{c}' AS item, "date", CASE WHEN day("date") % 3 = 0 AND NOT (symbol = 'N' AND '{c}' = 'sma_long') THEN {c} END AS v FROM frames""" for c in _LINES)


@_query("series_aligned", f"""WITH {FRAMES}, idx AS (SELECT symbol, "date" FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "date" DESC) <= 60), l AS ({_LONG}),
t AS (SELECT l.* FROM l JOIN idx ON idx.symbol = l.symbol AND idx."date" = l."date" WHERE v IS NOT NULL), items AS (SELECT DISTINCT symbol, item FROM t)
SELECT idx.symbol, items.item, idx."date", round(v, 4) + 0.0 AS "value" FROM idx JOIN items ON items.symbol = idx.symbol LEFT JOIN t ON t.symbol = idx.symbol AND t."date" = idx."date" AND t.item = items.item""")
def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars(spark, sf_dir)
    index = context.split_recent(days.select("symbol", "date"), 60).drop("recent")
    lines = days.withColumns(ind.sma_columns()).unpivot(["symbol", "date"], list(_LINES), "item", "value").where(F.day("date") % 3 == 0)
    there = lines.where(~((F.col("symbol") == "N") & (F.col("item") == "sma_long")))  # a series without any value
    return rounded(series.aligned(index, there, ["symbol"]), "symbol", "item", "date", "value")


@_query("work_order", f"""WITH {FILINGS}, n AS (SELECT filer, doc_id, submit_at, row_number() OVER (PARTITION BY filer ORDER BY submit_at DESC, doc_id DESC) AS k FROM filings)
SELECT filer, doc_id, submit_at, CAST(row_number() OVER (PARTITION BY filer ORDER BY k DESC) AS INT) AS turn FROM n WHERE k <= 5""")
def _order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.in_turn(filings(spark, sf_dir).select("filer", "doc_id", "submit_at"), "filer", 5, ["submit_at", "doc_id"])


@_query("distinct_in_order", "SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.distinct_in_order(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@_query("page_texts", r"""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '\u0026'), '<', '\u003c'), '>', '\u003e'), chr(8232), '\u2028'), chr(8233), '\u2029') AS safe,
  month(DATE '2024-01-01' + CAST(page_id % 366 AS INT)) || '/' || day(DATE '2024-01-01' + CAST(page_id % 366 AS INT)) AS day FROM pages""")
def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", series.script_safe(F.col("html")).alias("safe"), series.short_date(day).alias("day"))


_COUNTED = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{g}' AS group_name, '{text.replace(chr(39), chr(39) * 2)}' AS meaning, count({c}) AS n_values FROM panel" for g, (columns, text) in series.MEANINGS.items() for c in columns)


@_query("column_meanings", f"WITH RECURSIVE {PANEL} {_COUNTED}")
def _meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.meanings(ind.panel(bars(spark, sf_dir)).transform(series.described))
