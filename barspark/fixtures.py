"""Bars, reports, filings and facts derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, symbol: str | Column = "l_returnflag") -> DataFrame:
    """Daily bars of ``lineitem``: one aggregation, partial on the map side."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    price = F.col("l_extendedprice")
    day = F.to_date("l_shipdate").alias("date")
    by = F.col(symbol) if isinstance(symbol, str) else symbol
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(by.cast("string").alias("symbol"), day)
        .agg(
            F.min_by(price, key).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, key).alias("close"),
            F.sum("l_quantity").cast("long").alias("volume"),
        )
    )


BARS = """bars AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS "date",
    first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS "open",
    max(l_extendedprice) AS high, min(l_extendedprice) AS low,
    last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS "close",
    CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2)"""


def short_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, calc_date, holder_id, ratio, quantity, note``: the last report of a holder and day."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    value = F.struct(
        F.round(F.col("l_discount") * 10, 2).alias("ratio"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0), F.lit("消失")).alias("note"),
    )
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("calc_date"), F.col("l_suppkey").alias("holder_id"))
        .agg(F.max_by(value, key).alias("v"))
        .select("symbol", "calc_date", "holder_id", "v.*")
    )


SHORTS = """shorts AS (
  SELECT symbol, calc_date, holder_id, ratio, quantity, note FROM (
    SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS calc_date, l_suppkey AS holder_id, round(l_discount * 10, 2) AS ratio,
      CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_linestatus = 'F' AND l_tax = 0 THEN '消失' END AS note,
      row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE), l_suppkey
        ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n
    FROM lineitem) WHERE n = 1)"""


def margin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, date, kind, balance, batch``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "final").otherwise("prelim").alias("kind"),
        F.col("o_totalprice").cast("long").alias("balance"),
        F.col("o_orderkey").alias("batch"),
    )


MARGIN = """margin AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS "date", CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'prelim' END AS kind,
    CAST(trunc(o_totalprice) AS BIGINT) AS balance, o_orderkey AS batch FROM orders)"""

#: Type codes that the derived filings run through.
FILING_TYPES = ("120", "160", "350", "240", "180", "235", "999", "030", "140", "220", "320", "321")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, doc_type, filer, issuer, subject, submit_at, withdrawal``."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("doc_id"),
        F.element_at(F.array(*map(F.lit, FILING_TYPES)), (key % len(FILING_TYPES) + 1).cast("int")).alias("doc_type"),
        F.concat(F.lit("E"), cust % 40).alias("filer"),
        F.concat(F.lit("E"), (cust + 7) % 40).alias("issuer"),
        F.concat(F.lit("E"), (cust + 13) % 40).alias("subject"),
        F.concat(F.lit("S"), cust % 11).alias("sec_code"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("submit_at"),
        F.when(key % 97 == 0, 1).otherwise(0).alias("withdrawal"),
    )


FILINGS = """filings AS (
  SELECT o_orderkey AS doc_id, ['120','160','350','240','180','235','999','030','140','220','320','321'][(o_orderkey % 12) + 1] AS doc_type,
    'E' || (o_custkey % 40) AS filer, 'E' || ((o_custkey + 7) % 40) AS issuer, 'E' || ((o_custkey + 13) % 40) AS subject,
    'S' || (o_custkey % 11) AS sec_code, CAST(o_orderdate AS TIMESTAMP) AS submit_at, CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS withdrawal
  FROM orders)"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, ts, tokens, is_request, event_id``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").cast("long").alias("tokens"),
        (F.col("event_id") % 5 != 0).alias("is_request"),
        "event_id",
    )


USAGE = """usage AS (
  SELECT event_type AS model, ts, CAST(trunc(value) AS BIGINT) AS tokens, event_id % 5 <> 0 AS is_request, event_id FROM events)"""
