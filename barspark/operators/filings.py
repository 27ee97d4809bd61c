"""Filings: classes and labels, roles of entities, roll-up to chart markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filing type codes.
REPORT = ("120", "130", "140", "150", "160", "170")
SUPPLY = ("350", "360", "220", "230")
TENDER = (240, 320)
HOLDING = ("350", "360")
#: Short labels by type code, of tender offers and of all others.
LABELS = {
    "120": "有報",
    "130": "有報",
    "140": "四半期",
    "150": "四半期",
    "160": "半期",
    "170": "半期",
    "350": "大量保有",
    "360": "大量保有",
    "220": "自己株",
    "230": "自己株",
    "180": "臨報",
    "190": "臨報",
    "030": "届出",
    "040": "届出",
    "235": "内部統制",
    "236": "内部統制",
}
TENDER_LABEL, OTHER_LABEL = "TOB", "その他"
PRIORITY = ("supply", "report", "other")


def is_tender(code: Column) -> Column:
    return F.coalesce(code.try_cast("int").between(*TENDER), F.lit(False))


def category(code: Column) -> Column:
    return F.when(code.isin(*REPORT), "report").when(code.isin(*SUPPLY) | is_tender(code), "supply").otherwise("other")


def label(code: Column) -> Column:
    bare = F.trim(code)
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, bare), F.when(is_tender(bare), TENDER_LABEL), F.lit(OTHER_LABEL))


def match_roles(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, symbol, role``. ``targets``: ``symbol, entity, sec_code``; entity may be null, then the code decides.

    Holding reports match by issuer only. Tender offers match the subject, and the filer (or its code); all others the
    filer (or its code). The sides are small and looked up by key, Spark broadcasts them where their size allows it.
    """
    code = F.col("doc_type")
    by_entity = targets.where("entity is not null").select("symbol", F.col("entity").alias("e"))
    by_code = targets.where("entity is null").select("symbol", F.col("sec_code").alias("c"))
    holding, tender = code.isin(*HOLDING), is_tender(code)

    def on_entity(rows: DataFrame, column: str, role: str) -> DataFrame:
        return rows.join(by_entity, F.col(column) == F.col("e")).select("doc_id", "symbol", F.lit(role).alias("role"))

    others = docs.where(~holding)
    found = (
        on_entity(docs.where(holding), "issuer", "issuer")
        .unionByName(on_entity(docs.where(tender), "subject", "subject"))
        .unionByName(on_entity(others, "filer", "filer"))
        .unionByName(others.join(by_code, F.col("sec_code") == F.col("c")).select("doc_id", "symbol", F.lit("filer").alias("role")))
    )
    return found.distinct()


def by_symbol(docs: DataFrame, links: DataFrame) -> DataFrame:
    """A row a symbol and document with its roles in order."""
    roles = links.groupBy("doc_id", "symbol").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return docs.join(roles, "doc_id")


def with_flag(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``docs`` with ``csv_flag``: 1 or 0 where the list of the day of ``submit_at`` has the document (its first entry counts),
    null where it hasn't or is missing. ``listed``: ``day, pos, doc_id, csv_flag`` (text)."""
    first = listed.groupBy("day", "doc_id").agg(F.coalesce(F.min_by("csv_flag", "pos") == "1", F.lit(False)).cast("int").alias("csv_flag"))
    return docs.withColumn("day", F.to_date("submit_at")).join(first, ["day", "doc_id"], "left").drop("day")


def counts(listed: DataFrame) -> DataFrame:
    cat, gone = category(F.col("doc_type")), F.coalesce(F.col("withdrawal") == 1, F.lit(False))
    each = [F.count_if(cat == c).alias(c) for c in ("report", "supply", "other")]
    return listed.groupBy("symbol").agg(*each, F.count_if(gone).alias("withdrawn"), F.count("*").alias("total"))


def markers(marked: DataFrame) -> DataFrame:
    """``symbol, marker_date, category, n, doc_ids, text``; withdrawn filings and those without a bar are left out."""
    rows = marked.where(F.col("marker_date").isNotNull() & ~F.coalesce(F.col("withdrawal") == 1, F.lit(False)))
    cat, name = category(F.col("doc_type")), label(F.col("doc_type"))
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), cat)
    return rows.groupBy("symbol", "marker_date").agg(
        F.min_by(cat, rank).alias("category"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_list("doc_id")).alias("doc_ids"),
        F.when(F.count("*") == 1, F.first(name)).otherwise(F.concat(F.lit("開示"), F.count("*").cast("string"), F.lit("件"))).alias("text"),
    )
