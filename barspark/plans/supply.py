"""Queries over reports, margins and filings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import BARS, FILINGS, MARGIN, SHORTS, bars, filings, margin_rows, short_reports, table
from ..operators import filings as fil
from ..operators import merge, supply
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


TOTALS = f"""{SHORTS},
iv AS (SELECT *, lead(calc_date) OVER (PARTITION BY symbol, holder_id ORDER BY calc_date) AS until FROM shorts),
spine AS (SELECT DISTINCT symbol, calc_date AS "date" FROM shorts),
totals AS (SELECT spine.symbol, spine."date", round(coalesce(sum(ratio), 0), 6) AS total_ratio, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_qty, count(iv.symbol) AS holders
  FROM spine LEFT JOIN iv ON iv.symbol = spine.symbol AND iv.calc_date <= spine."date" AND (until IS NULL OR until > spine."date") AND note IS NULL AND NOT coalesce(ratio < 0.5, false)
  GROUP BY ALL)"""


@_query("short_totals", f'WITH {TOTALS} SELECT symbol, "date", round(total_ratio, 4) + 0.0 AS total_ratio, total_qty, holders FROM totals')
def _short_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(supply.short_totals(short_reports(spark, sf_dir)), "symbol", "date", "total_ratio", "total_qty", "holders")


@_query("locf_ratio", f"""WITH {BARS}, {TOTALS}, j AS (SELECT b.symbol, b."date", CASE WHEN day(b."date") % 3 = 0 THEN total_ratio END AS r FROM bars b LEFT JOIN totals t ON t.symbol = b.symbol AND t."date" = b."date")
SELECT symbol, "date", round(last_value(r IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY "date" ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS held FROM j""")
def _locf(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = supply.short_totals(short_reports(spark, sf_dir)).where(F.day("date") % 3 == 0)
    joined = bars(spark, sf_dir).select("symbol", "date").join(totals, ["symbol", "date"], "left")
    return rounded(joined.withColumn("held", supply.carry_forward(joined, "total_ratio")), "symbol", "date", "held")


@_query("short_points", f"""WITH {BARS}, {TOTALS}, t AS (SELECT * FROM totals WHERE year("date") < 2001),
p AS (SELECT t.*, false AS carried FROM t SEMI JOIN bars b ON b.symbol = t.symbol AND b."date" = t."date"
  UNION ALL SELECT l.symbol, e.fin, total_ratio, total_qty, holders, true FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "date" DESC) = 1) l
    JOIN (SELECT symbol, max("date") AS fin FROM bars GROUP BY 1) e ON e.symbol = l.symbol WHERE l."date" < fin)
SELECT symbol, "date", round(total_ratio, 4) + 0.0 AS total_ratio, total_qty, holders, carried FROM p""")
def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = supply.short_totals(short_reports(spark, sf_dir)).where(F.year("date") < 2001)
    return rounded(supply.points_with_carry(totals, bars(spark, sf_dir)), "symbol", "date", "total_ratio", "total_qty", "holders", "carried")


@_query("islands", f"""WITH {BARS}, m AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "date") - row_number() OVER (PARTITION BY symbol, "close" >= "open" ORDER BY "date") AS run FROM bars)
SELECT symbol, min("date") AS "start", max("date") AS "end", count(*) AS n FROM m WHERE "close" >= "open" GROUP BY symbol, run""")
def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.runs(bars(spark, sf_dir), F.col("close") >= F.col("open"))


_BEST = """best AS (SELECT symbol, "date", kind, balance, batch FROM (SELECT *, row_number() OVER (PARTITION BY symbol, "date" ORDER BY kind = 'final' DESC, batch DESC, balance DESC) AS n FROM margin) WHERE n = 1)"""


def _margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return margin_rows(spark, sf_dir)


@_query("merge_final_over_prelim", f"WITH {MARGIN}, {_BEST} SELECT * FROM best")
def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.final_over_prelim(_margin(spark, sf_dir), ["symbol", "date"], "balance").select("symbol", "date", "kind", "balance", "batch")


@_query("align_to_bars", f"""WITH {MARGIN}, {_BEST}, {BARS} SELECT best.* FROM best SEMI JOIN bars ON bars."date" = best."date" AND bars.symbol = 'A' AND bars."close" > bars."open" """)
def _align(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars(spark, sf_dir).where("symbol = 'A' and close > open")
    return supply.align_to_bars(_final(spark, sf_dir), days, ["date"])


# ---- merges --------------------------------------------------------------------------------------------------------
def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@_query("merge_lww", """SELECT o_custkey, arg_max(o_orderkey, (o_orderkey % 3, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderkey % 3, o_orderkey)) AS o_totalprice
FROM orders GROUP BY 1""")
def _lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_custkey", (F.col("o_orderkey") % 3).alias("batch"), "o_orderkey", "o_totalprice")
    old, new = rows.where("batch <> 2"), rows.where("batch = 2")
    return merge.last_writer_wins(old, new, ["o_custkey"], "batch", "o_orderkey").drop("batch")


_BALANCES = """balances AS (SELECT o_custkey % 400 AS code, DATE '1996-01-01' + CAST(o_custkey % 3 + o_orderkey % 2 AS INT) AS "date", CASE WHEN o_orderkey % 3 = 0 THEN 'final' ELSE 'prelim' END AS kind,
  o_totalprice AS balance, o_orderkey AS place, o_orderstatus FROM orders),
reg AS (SELECT c_custkey AS code, c_custkey || '.T' AS symbol FROM customer WHERE c_custkey < 500),
kept AS (SELECT code || '.T' AS symbol, "date", kind, balance FROM (
  SELECT *, row_number() OVER (PARTITION BY code, "date" ORDER BY kind = 'final' DESC, place DESC) AS n FROM balances WHERE o_orderstatus <> 'F') WHERE n = 1),
fresh AS (SELECT * FROM balances WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY code ORDER BY place DESC) = 1),
outcomes AS (SELECT reg.symbol, reg.code, f."date", f.kind, f.balance, CASE WHEN f.code IS NULL THEN 'missing' WHEN k.kind = 'final' AND f.kind <> 'final' THEN 'skipped' ELSE 'saved' END AS outcome
  FROM reg LEFT JOIN fresh f ON f.code = reg.code LEFT JOIN kept k ON k.symbol = reg.symbol AND k."date" = f."date")"""


def _balances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Balances that are kept, a batch, and the registered symbols."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        (cust % 400).alias("code"), F.date_add(F.lit("1996-01-01").cast("date"), (cust % 3 + key % 2).cast("int")).alias("date"),
        F.when(key % 3 == 0, "final").otherwise("prelim").alias("kind"), F.col("o_totalprice").alias("balance"), key.alias("place"), "o_orderstatus", F.lit(1).alias("batch"),
    )
    symbol = lambda c: F.concat(F.col(c).cast("string"), F.lit(".T")).alias("symbol")
    kept = merge.final_over_prelim(rows.where("o_orderstatus <> 'F'").select(symbol("code"), "date", "kind", "balance", "batch", "place"), ["symbol", "date"], "place")
    registered = table(spark, sf_dir, "customer").where("c_custkey < 500").select(F.col("c_custkey").alias("code"), symbol("c_custkey"))
    return kept.select("symbol", "date", "kind", "balance"), rows.where("o_orderstatus = 'F'").select("code", "date", "kind", "balance", "place"), registered


@_query("balance_outcomes", f"WITH {_BALANCES} SELECT * FROM outcomes")
def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.balance_outcomes(*_balances(spark, sf_dir)).select("symbol", "code", "date", "kind", "balance", "outcome")


@_query("save_balances", f"""WITH {_BALANCES}, s AS (SELECT * FROM outcomes WHERE outcome = 'saved')
SELECT symbol, "date", kind, balance FROM s UNION ALL SELECT k.* FROM kept k ANTI JOIN s ON s.symbol = k.symbol AND s."date" = k."date" """)
def _save(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.save_balances(*_balances(spark, sf_dir), Observation())


@_query("merge_linked", """WITH n AS (SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)),
l AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM n GROUP BY 1),
o AS (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1)
SELECT o_custkey, round(o_totalprice, 2) + 0.0 AS o_totalprice FROM l UNION ALL SELECT o_custkey, round(o_totalprice, 2) + 0.0 FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM l)""")
def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    old = rows.where("o_orderkey % 3 = 1").groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    new = rows.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    links = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    done = merge.replace_linked(old, new, links, "o_custkey", "o_orderkey")
    return done.select("o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@_query("merge_coalesce", """WITH o AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0),
n AS (SELECT c_custkey, c_name || '!' AS c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 END AS c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, round(coalesce(n.c_acctbal, o.c_acctbal), 4) + 0.0 AS c_acctbal,
  coalesce(o.c_mktsegment, n.c_mktsegment) AS c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def _coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    old = rows.where("c_custkey % 5 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")))
    new = rows.where("c_custkey % 7 <> 0").select(
        "c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment")
    )
    return rounded(merge.keep_old_where_missing(old, new, ["c_custkey"], ("c_mktsegment",)), *rows.columns)


@_query("merge_latest_correction", """SELECT o_custkey, o_orderstatus, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, max(CAST(o_orderdate AS TIMESTAMP)) AS o_orderdate
FROM orders GROUP BY 1, 2""")
def _correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.latest(_orders(spark, sf_dir), ["o_custkey", "o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return rows.select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@_query("merge_suffix_replace", f"""WITH {SHORTS}, n AS (SELECT symbol, calc_date, holder_id, ratio + 1 AS ratio FROM shorts WHERE calc_date >= DATE '2001-01-01' AND symbol <> 'R' AND holder_id % 2 = 0),
f AS (SELECT symbol, min(calc_date) AS d FROM n GROUP BY 1)
SELECT s.symbol, calc_date, holder_id, round(ratio, 4) + 0.0 AS ratio FROM shorts s LEFT JOIN f ON f.symbol = s.symbol WHERE d IS NULL OR calc_date < d
UNION ALL SELECT symbol, calc_date, holder_id, round(ratio, 4) + 0.0 FROM n""")
def _suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = short_reports(spark, sf_dir).select("symbol", "calc_date", "holder_id", "ratio")
    new = old.where("calc_date >= date '2001-01-01' and symbol <> 'R' and holder_id % 2 = 0").withColumn("ratio", F.col("ratio") + 1)
    return rounded(merge.replace_suffix(old, new, "symbol", "calc_date"), *old.columns)


@_query("merge_insert_ignore", """WITH o AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
n AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = n.o_custkey)""")
def _ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderstatus")
    old = rows.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return merge.insert_ignore(old, rows.drop("o_orderstatus"), ["o_custkey"])


_STUBS = """stubs AS (SELECT o_orderkey AS doc_id, o_orderkey - 1 AS parent, CAST(1 + o_orderkey % 2 AS INT) AS status, CAST(o_orderdate AS DATE) + 3 AS "date" FROM orders WHERE o_orderstatus = 'P')"""


def _stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(
        key.alias("doc_id"), (key - 1).alias("parent"), (1 + key % 2).cast("int").alias("status"), F.date_add(F.to_date("o_orderdate"), 3).alias("date")
    )


_STATE = f"""{FILINGS}, {_STUBS}, named AS (SELECT doc_id, status, "date", doc_id AS stub FROM stubs UNION ALL SELECT parent, status, "date", doc_id FROM stubs),
st AS (SELECT n.doc_id, arg_max(status, (n."date", stub)) AS status FROM named n JOIN filings f ON f.doc_id = n.doc_id AND n."date" >= CAST(f.submit_at AS DATE) GROUP BY 1),
state AS (SELECT f.* EXCLUDE (withdrawal), CAST(coalesce(status, withdrawal) AS INT) AS withdrawal, status IS NOT NULL AND status <> withdrawal AS changed FROM filings f LEFT JOIN st ON st.doc_id = f.doc_id)"""


@_query("merge_withdrawals", f"WITH {_STATE} SELECT doc_id, doc_type, submit_at, withdrawal, changed FROM state")
def _withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.withdrawals(filings(spark, sf_dir), _stubs(spark, sf_dir)).select("doc_id", "doc_type", "submit_at", "withdrawal", "changed")


@_query("withdrawal_stubs", f'WITH {_STUBS} SELECT doc_id, parent, status, "date" FROM stubs')
def _stub_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stubs(spark, sf_dir)


@_query("split_reload", f"""WITH {BARS}, c AS (SELECT symbol, max("date") AS fin FROM bars WHERE "date" < DATE '2001-01-01' GROUP BY 1)
SELECT b.symbol, bool_or("date" > fin AND (CASE WHEN volume % 97 = 0 AND b.symbol <> 'N' THEN 2.0 ELSE 0.0 END) <> 0) AS reload FROM bars b JOIN c ON c.symbol = b.symbol GROUP BY 1""")
def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = bars(spark, sf_dir)
    fresh = all_.withColumn("splits", F.when((F.col("volume") % 97 == 0) & (F.col("symbol") != "N"), 2.0).otherwise(0.0))
    return merge.needs_reload(all_.where("date < date '2001-01-01'"), fresh)


# ---- filings -------------------------------------------------------------------------------------------------------
_TENDER = "coalesce(TRY_CAST(doc_type AS INT) BETWEEN 240 AND 320, false)"
_CATEGORY = f"CASE WHEN doc_type IN ('120','130','140','150','160','170') THEN 'report' WHEN doc_type IN ('350','360','220','230') OR {_TENDER} THEN 'supply' ELSE 'other' END"
_LABEL = f"""CASE {" ".join(f"WHEN doc_type = '{k}' THEN '{v}'" for k, v in fil.LABELS.items())} WHEN {_TENDER} THEN 'TOB' ELSE 'その他' END"""


@_query("filing_category", f"WITH {FILINGS} SELECT doc_id, doc_type, {_CATEGORY} AS category FROM filings")
def _category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).select("doc_id", "doc_type", fil.category(F.col("doc_type")).alias("category"))


@_query("filing_label", f"WITH {FILINGS} SELECT doc_id, doc_type, {_LABEL} AS label FROM filings")
def _label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).select("doc_id", "doc_type", fil.label(F.col("doc_type")).alias("label"))


_TARGETS = """targets AS (SELECT * FROM (VALUES ('A', 'E3', 'S3'), ('N', 'E17', 'S6'), ('R', NULL, 'S9'), ('X', 'E16', NULL)) t(symbol, entity, sec_code))"""
_LINKS = f"""{FILINGS}, {_TARGETS}, links AS (
  SELECT doc_id, symbol, 'issuer' AS role FROM filings JOIN targets t ON issuer = entity WHERE doc_type IN ('350','360')
  UNION SELECT doc_id, symbol, 'subject' FROM filings JOIN targets t ON subject = entity WHERE {_TENDER}
  UNION SELECT doc_id, symbol, 'filer' FROM filings JOIN targets t ON filer = entity WHERE doc_type NOT IN ('350','360')
  UNION SELECT doc_id, symbol, 'filer' FROM filings f JOIN targets t ON f.sec_code = t.sec_code WHERE entity IS NULL AND doc_type NOT IN ('350','360'))"""


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", "E3", "S3"), ("N", "E17", "S6"), ("R", None, "S9"), ("X", "E16", None)], "symbol string, entity string, sec_code string")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fil.match_roles(filings(spark, sf_dir), _targets(spark))


@_query("match_roles", f"WITH {_LINKS} SELECT * FROM links")
def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


@_query("match_index", f"WITH {_TARGETS} SELECT symbol, coalesce(entity, sec_code) AS key, entity IS NOT NULL AS resolved FROM targets")
def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark).select("symbol", F.coalesce("entity", "sec_code").alias("key"), F.col("entity").isNotNull().alias("resolved"))


@_query("filings_by_symbol", f"""WITH {_LINKS} SELECT symbol, f.doc_id, doc_type, submit_at, string_agg(role, '/' ORDER BY role) AS roles
FROM filings f JOIN links l ON l.doc_id = f.doc_id GROUP BY ALL""")
def _by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = fil.by_symbol(filings(spark, sf_dir), _links(spark, sf_dir))
    return listed.select("symbol", "doc_id", "doc_type", "submit_at", F.array_join("roles", "/").alias("roles")).orderBy("symbol", F.desc("submit_at"), "doc_id")


@_query("filing_counts", f"""WITH {_LINKS}, d AS (SELECT DISTINCT doc_id, symbol FROM links), c AS (SELECT symbol, {_CATEGORY} AS category, withdrawal FROM filings f JOIN d ON d.doc_id = f.doc_id)
SELECT symbol, count(*) FILTER (category = 'report') AS report, count(*) FILTER (category = 'supply') AS supply, count(*) FILTER (category = 'other') AS other,
  count(*) FILTER (withdrawal = 1) AS withdrawn, count(*) AS total FROM c GROUP BY 1""")
def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fil.counts(fil.by_symbol(filings(spark, sf_dir), _links(spark, sf_dir)))


@_query("link_counts", f"WITH {_LINKS} SELECT symbol, count(*) AS n FROM links GROUP BY 1")
def _link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))


@_query("anti_orphans", f"WITH {_LINKS} SELECT doc_id, doc_type FROM filings f WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.doc_id = f.doc_id)")
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.orphans(filings(spark, sf_dir).select("doc_id", "doc_type"), _links(spark, sf_dir), ["doc_id"])


@_query("semi_registered", f"WITH {_LINKS} SELECT doc_id, doc_type FROM filings f WHERE EXISTS (SELECT 1 FROM links l WHERE l.doc_id = f.doc_id)")
def _semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.without_orphans(filings(spark, sf_dir).select("doc_id", "doc_type"), _links(spark, sf_dir), ["doc_id"])


_SYM = "['A','N','R'][(doc_id % 3) + 1]"
_MARKED = f"""{BARS}, {FILINGS}, f AS (SELECT *, {_SYM} AS symbol, CAST(submit_at AS DATE) + CAST(doc_id % 400 AS INT) - 200 AS day FROM filings),
firsts AS (SELECT symbol, min("date") AS fst FROM bars GROUP BY 1),
marked AS (SELECT f.*, CASE WHEN day >= fst THEN b."date" END AS marker_date FROM f JOIN firsts ON firsts.symbol = f.symbol ASOF LEFT JOIN bars b ON f.symbol = b.symbol AND f.day <= b."date")"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = filings(spark, sf_dir).withColumn("symbol", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("doc_id") % 3 + 1).cast("int")))
    docs = docs.withColumn("day", F.date_add(F.to_date("submit_at"), (F.col("doc_id") % 400).cast("int") - 200))
    return supply.next_bar(docs, bars(spark, sf_dir), F.col("day"))


@_query("asof_forward_marker", f"WITH {_MARKED} SELECT doc_id, symbol, day, marker_date FROM marked")
def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("doc_id", "symbol", "day", "marker_date")


_MARKERS = f"""{_MARKED}, c AS (SELECT *, {_CATEGORY} AS category, {_LABEL} AS label FROM marked WHERE marker_date IS NOT NULL AND withdrawal <> 1),
markers AS (SELECT symbol, marker_date, arg_min(category, CASE category WHEN 'supply' THEN 1 WHEN 'report' THEN 2 ELSE 3 END) AS category, count(*) AS n,
  string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids, CASE WHEN count(*) = 1 THEN min(label) ELSE '開示' || count(*) || '件' END AS text FROM c GROUP BY 1, 2)"""


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fil.markers(_marked(spark, sf_dir))
    return made.withColumn("doc_ids", F.array_join(F.col("doc_ids").cast("array<string>"), ","))


@_query("event_markers", f"WITH {_MARKERS} SELECT * FROM markers")
def _event_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markers(spark, sf_dir)


@_query("events_visible", f"""WITH {_MARKERS}, e AS (SELECT max("date") AS fin FROM bars) SELECT symbol, marker_date, n FROM markers, e WHERE marker_date BETWEEN DATE '2001-06-01' AND fin""")
def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = bars(spark, sf_dir).agg(F.max("date").alias("fin"))
    return _markers(spark, sf_dir).join(F.broadcast(end), F.col("marker_date").between(F.lit("2001-06-01").cast("date"), F.col("fin"))).select("symbol", "marker_date", "n")


@_query("markers_merged", f"""WITH {_MARKERS}, up AS (SELECT symbol, "date" FROM bars WHERE "close" > "open" * 20)
SELECT symbol, marker_date AS "date", 1 AS source_no, text FROM markers UNION ALL SELECT symbol, "date", 2, 'jump' FROM up""")
def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _markers(spark, sf_dir).select("symbol", F.col("marker_date").alias("date"), F.lit(1).alias("source_no"), "text")
    two = bars(spark, sf_dir).where("close > open * 20").select("symbol", "date", F.lit(2).alias("source_no"), F.lit("jump").alias("text"))
    return one.unionByName(two).orderBy("symbol", "date", "source_no")


@_query("filings_in_range", f"""WITH {_LINKS}, g AS (SELECT symbol, doc_id, string_agg(role, '/' ORDER BY role) AS roles FROM links GROUP BY 1, 2)
SELECT symbol, f.doc_id, CAST(submit_at AS DATE) AS day, {_LABEL} AS label, withdrawal = 1 AS withdrawn, roles FROM filings f JOIN g ON g.doc_id = f.doc_id
WHERE CAST(submit_at AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""")
def _in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("submit_at")
    docs = filings(spark, sf_dir).where(day.between(F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    listed = fil.by_symbol(docs, fil.match_roles(docs, _targets(spark)))
    return listed.select("symbol", "doc_id", day.alias("day"), fil.label(F.col("doc_type")).alias("label"), (F.col("withdrawal") == 1).alias("withdrawn"), F.array_join("roles", "/").alias("roles"))


_PENDING = """listed AS (SELECT symbol, f.doc_id, submit_at FROM filings f JOIN (SELECT DISTINCT doc_id, symbol FROM links) l ON l.doc_id = f.doc_id
  WHERE doc_type IN ('120','160','130','170') AND withdrawal <> 1 AND f.doc_id % 3 <> 0)"""


@_query("pending_docs", f"""WITH {_LINKS}, {_PENDING} SELECT symbol, doc_id, submit_at, CAST(row_number() OVER (PARTITION BY symbol ORDER BY submit_at DESC, doc_id DESC) AS INT) AS nth FROM listed QUALIFY nth <= 6""")
def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = filings(spark, sf_dir)
    done = docs.where("doc_id % 3 = 0").select("doc_id")
    wanted = docs.where(F.col("doc_type").isin("120", "160", "130", "170") & ~F.coalesce(F.col("withdrawal") == 1, F.lit(False))).join(done, "doc_id", "left_anti")
    order = Window.partitionBy("symbol").orderBy(F.desc("submit_at"), F.desc("doc_id"))
    listed = fil.by_symbol(wanted, fil.match_roles(wanted, _targets(spark)))
    return listed.withColumn("nth", F.row_number().over(order)).where("nth <= 6").select("symbol", "doc_id", "submit_at", "nth")


@_query("csv_flags", f"""WITH {_LINKS} SELECT doc_id, CASE WHEN withdrawal = 1 THEN NULL WHEN doc_type IN ('120','130','140','150','160','170') THEN 1 ELSE 0 END AS csv_flag FROM filings""")
def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = filings(spark, sf_dir)
    entry = docs.where(~F.coalesce(F.col("withdrawal") == 1, F.lit(False))).select(F.to_date("submit_at").alias("day"), F.lit(0).alias("pos"), "doc_id", F.when(F.col("doc_type").isin(*fil.REPORT), "1").when(F.col("doc_type").isin(*fil.SUPPLY), "0").alias("csv_flag"))
    again = entry.withColumns({"pos": F.lit(1), "csv_flag": F.lit("1")})  # later entries of a document don't count
    return fil.with_flag(docs, entry.unionByName(again)).select("doc_id", "csv_flag")


@_query("stock_coverage", f"""WITH {BARS}, st AS (SELECT * FROM (VALUES ('A'), ('N'), ('R'), ('Z')) t(symbol)) SELECT st.symbol, count("date") AS n, min("date") AS first_date, max("date") AS last_date
FROM st LEFT JOIN bars ON bars.symbol = st.symbol GROUP BY 1""")
def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stocks = spark.createDataFrame([("A",), ("N",), ("R",), ("Z",)], "symbol string")
    per = bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return stocks.join(per, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@_query("set_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _except(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").select("c_custkey").distinct().join(done, "c_custkey", "left_anti")


@_query("count_increase", f"""WITH {_LINKS}, b AS (SELECT symbol, count(*) AS n FROM links WHERE doc_id % 2 = 0 GROUP BY 1), a AS (SELECT symbol, count(*) AS n FROM links GROUP BY 1)
SELECT a.symbol, coalesce(b.n, 0) AS before, a.n AS after FROM a LEFT JOIN b ON b.symbol = a.symbol WHERE a.n > coalesce(b.n, 0)""")
def _increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _links(spark, sf_dir).groupBy("symbol").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("before"), F.count("*").alias("after"))
    return by.where("after > before")
