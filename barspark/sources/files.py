"""Readers of the outside files: one row a file comes from Spark's binary reader, its parts are parsed where it is read.

Columns are found by name, and a missing one is an error.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import Tags, page
from ..functions.scalars import scrub_number

TOKYO, FINAL, PRELIM = "東証", "確報", "速報"


#: Rows and characters of a batch that goes on, whatever the number and the size of the files.
ROWS, CHARACTERS = 10_000, 1 << 22
KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def batched(parse, schema: str):
    """``path, content`` in record batches through ``parse(path, buffer) -> rows``: rows of many small files go on together, those
    of a large one in several batches."""
    names, kinds = zip(*[f.split(" ") for f in schema.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for row in parse(path.as_py(), content.as_buffer()):
                    rows.append(row)
                    size += sum([len(v) for v in row if v.__class__ is str])
                    if len(rows) >= ROWS or size >= CHARACTERS:
                        yield made()
                        rows, size = [], 0
        if rows:
            yield made()

    return run


def _parsed(files: DataFrame, parse, schema: str) -> DataFrame:
    """Files through batched(); every file is taken by itself."""
    return files.select("path", "content").mapInArrow(batched(parse, schema), schema)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


class _Table(Tags):
    """Cells and links of the rows of the table with an id."""

    def __init__(self, table_id: str):
        super().__init__()
        self.wanted, self.depth, self.rows, self.cell = table_id, 0, [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = dict(attrs) if attrs else {}
        if tag == "table" and (self.depth or found.get("id") == self.wanted):
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append({"classes": (found.get("class") or "").split(), "cells": [], "links": []})
        elif self.depth and tag in ("td", "th") and self.rows:
            self.rows[-1]["cells"].append("")
            self.rows[-1]["links"].append(None)
            self.cell = tag
        elif self.cell and tag == "a":
            self.rows[-1]["links"][-1] = found.get("href")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.rows[-1]["cells"][-1] += data


def html_rows(files: DataFrame, table_id: str = "sort", classes: tuple[str, ...] = ("obb", "occ"), columns: int = 7) -> DataFrame:
    """``path, pos, cells, links`` of the rows of some classes; a file without the table, or with other columns, is an error."""
    wanted = set(classes)

    def parse(path: str, content: pa.Buffer):
        page = _Table(table_id)
        page.feed(str(content, "utf-8", "replace"))
        if not page.rows:
            raise ValueError(f"{path}: no table {table_id}")
        for pos, row in enumerate(r for r in page.rows if wanted.intersection(r["classes"])):
            if len(row["cells"]) != columns:
                raise ValueError(f"{path}: {len(row['cells'])} columns")
            yield path, pos, [c.strip() for c in row["cells"]], row["links"]

    return _parsed(files, parse, "path string, pos long, cells array<string>, links array<string>")


def short_positions(rows: DataFrame) -> DataFrame:
    """Rows of the report table as typed columns; of a day and holder the later row counts."""
    cell, link = lambda i: F.get("cells", F.lit(i)), F.get("links", F.lit(1))
    holder = F.coalesce(F.nullif(F.try_parse_url(F.concat(F.lit("http://x"), link), F.lit("QUERY"), F.lit("f")), F.lit("")), cell(1))
    made = rows.select(
        "path", "pos", F.to_date(cell(0), "yyyy/MM/dd").alias("calc_date"), holder.alias("holder_id"), cell(1).alias("holder"),
        scrub_number(cell(2)).alias("ratio"), scrub_number(cell(3)).alias("ratio_delta"), scrub_number(cell(4), "株").cast("long").alias("quantity"),
        scrub_number(cell(5), "株").cast("long").alias("qty_delta"), F.nullif(cell(6), F.lit("")).alias("note"),
    )
    rest = [c for c in made.columns if c not in ("path", "calc_date", "holder_id")]
    best = made.groupBy("path", "calc_date", "holder_id").agg(F.max_by(F.struct(*rest), "pos").alias("v"))
    return best.select("path", "calc_date", "holder_id", *[F.col(f"v.{c}") for c in rest])


def margin_balances(spark: SparkSession, path: str, required: tuple[str, ...], exchange: str, kind: str) -> DataFrame:
    """A quoted cp932 CSV by its header, rows of the Tokyo exchange only, with ``kind`` final or prelim.

    Needs spark.sql.legacy.javaCharsets. An unknown kind counts as preliminary; ``kind_known`` is false there, to be warned of.
    """
    rows = spark.read.csv(path, header=True, encoding="cp932", quote='"', enforceSchema=False)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns missing: {missing}")
    made = rows.where(F.col(exchange).contains(TOKYO)).select(*required)
    return made.withColumn("kind", report_kind(F.col(kind))).withColumn("kind_known", F.trim(kind).isin(FINAL, PRELIM))


def report_kind(text: Column) -> Column:
    return F.when(F.trim(text) == FINAL, "final").otherwise("prelim")


#: The columns of the balance file and what each is called here.
MARGIN = {
    "申込日": "date",
    "決済日": "settle_date",
    "銘柄コード": "code",
    "取引所区分名": "exchange",
    "速報／確報": "kind",
    "融資新規株数": "yushi_new",
    "融資返済株数": "yushi_repay",
    "融資残高株数": "yushi_balance",
    "貸株新規株数": "kashi_new",
    "貸株返済株数": "kashi_repay",
    "貸株残高株数": "kashi_balance",
    "差引残高株数": "net_balance",
}


def margin_rows(files: DataFrame) -> DataFrame:
    """The same of files as bytes: Tokyo rows with days, kinds and numbers. The day must be there; the day of settlement and
    numbers that can't be read are null."""

    def parse(path: str, content: pa.Buffer):
        rows = csv.reader(io.TextIOWrapper(pa.BufferReader(content), "cp932", newline="\n"))
        at = {name: i for i, name in enumerate(next(rows, []))}
        if missing := [c for c in MARGIN if c not in at]:
            raise ValueError(f"{path}: columns missing: {missing}")
        places = [at[c] for c in MARGIN]
        for row in rows:
            if row:
                yield (path, *[row[i].strip() if i < len(row) else "" for i in places])

    text = _parsed(files, parse, ", ".join(f"{n} string" for n in ("path", *MARGIN.values())))
    numbers = [n for n in MARGIN.values() if n.endswith(("_new", "_repay", "_balance"))]
    return text.where(F.col("exchange").contains(TOKYO)).select(
        "path", "code", F.to_date("date", "yyyy/MM/dd").alias("date"), optional_date(F.col("settle_date")).alias("settle_date"),
        report_kind(F.col("kind")).alias("kind"), F.col("kind").isin(FINAL, PRELIM).alias("kind_known"), *[optional_long(F.col(n)).alias(n) for n in numbers],
    )


def optional_long(c: Column) -> Column:
    return F.nullif(F.nullif(F.replace(F.trim(c), F.lit(","), F.lit("")), F.lit("")), F.lit("-")).cast("long")


def optional_date(c: Column, pattern: str = "yyyy/MM/dd") -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("date")


def code_list(files: DataFrame, member: str, columns: dict[str, str]) -> DataFrame:
    """A cp932 CSV in a ZIP: the first line is no data, the header is on the second. ``columns``: name there -> name here.
    Blank rows go; empty values are null."""
    names = list(columns.values())

    def parse(path: str, content: pa.Buffer):
        with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as file:
            rows = csv.reader(io.TextIOWrapper(file, "cp932", newline="\n"))
            next(rows, None)
            head = next(rows, [])
            if missing := [c for c in columns if c not in head]:
                raise ValueError(f"{path}: columns missing: {missing}")
            at = [head.index(c) for c in columns]
            for row in rows:
                if any(x.strip() for x in row):
                    yield tuple((row[i].strip() or None) if i < len(row) else None for i in at)

    return _parsed(files, parse, ", ".join(f"{n} string" for n in names))


def filing_texts(files: DataFrame, most: int = 200_000) -> DataFrame:
    """``path, title, text, truncated`` of filings as ZIPs: their pages by name, those of the public folder if there are any,
    else all. A file that is no ZIP or has no page has an empty text."""

    def parse(path: str, content: pa.Buffer):
        title, texts = None, []
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                pages = sorted(n for n in archive.namelist() if n.lower().endswith((".htm", ".html")))
                for name in [n for n in pages if "PublicDoc/" in n] or pages:
                    named, text = page(archive.read(name).decode("utf-8", "replace"))
                    title = title or named
                    if text:
                        texts.append(text)
        except zipfile.BadZipFile:
            pass
        whole = "\n\n".join(texts)
        yield path, title, whole[:most], len(whole) > most

    return _parsed(files, parse, "path string, title string, text string, truncated boolean")


FACT_MEMBER = re.compile(r"jpcrp\d{6}-(asr|ssr)-")
FACT_COLUMNS = {"element": "要素ID", "context": "コンテキストID", "unit_id": "ユニットID", "value": "値"}


def fact_rows(files: DataFrame) -> DataFrame:
    """The tagged rows of the first fact file (UTF-16, by tabs) in each ZIP, with ``doc_period``."""

    def parse(path: str, content: pa.Buffer):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            name = next((n for n in sorted(archive.namelist()) if FACT_MEMBER.search(n)), None)
            if name is None:
                return
            period = "FY" if FACT_MEMBER.search(name)[1] == "asr" else "HY"
            with archive.open(name) as file:
                marked = file.peek(2)[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)
                text = io.TextIOWrapper(file, "utf-16" if marked else "utf-16-le", newline="\n")
                for pos, row in enumerate(csv.DictReader(text, delimiter="\t")):
                    yield (path, pos, *[row.get(c) for c in FACT_COLUMNS.values()], period)

    return _parsed(files, parse, "file string, pos long, element string, context string, unit_id string, value string, doc_period string")


#: The fields of the filing list, texts and numbers.
FILING = (
    "docID", "edinetCode", "secCode", "filerName", "issuerEdinetCode", "subjectEdinetCode", "docTypeCode", "formCode", "ordinanceCode", "docDescription",
    "currentReportReason", "periodStart", "periodEnd", "submitDateTime", "parentDocID",
)
FILING_NUMBERS = ("withdrawalStatus", "disclosureStatus")


def filing_rows(days: DataFrame) -> DataFrame:
    """Daily lists as JSON in ``text``, one a row: the results as rows, with ``other``: whatever fields a result has beside the known
    ones, as text. A text that is no JSON is skipped; a list whose status isn't 200 is an error, never a day without filings.

    The lists are read as VARIANT, so that a field of another type or place in one result changes nothing in the others: a text
    that comes as a number is that number's text, a number that can't be read is null, as is an empty text.
    """
    day = F.try_parse_json("text")
    status = F.try_variant_get("day", "$.metadata.status", "string")
    refused = F.raise_error(F.concat(F.lit("filing list with status "), status)).cast("boolean")
    good = F.when(status.isNull(), False).when(status == "200", True).otherwise(refused)
    results = F.try_variant_get("day", "$.results", "array<variant>")
    each = days.select(day.alias("day")).where(good).select(F.explode(results).alias("r"))
    text = lambda name: F.nullif(F.trim(F.try_variant_get("r", f"$.{name}", "string")), F.lit("")).alias(name)
    number = lambda name: F.trim(F.try_variant_get("r", f"$.{name}", "string")).try_cast("int").alias(name)
    other = F.map_filter(F.try_variant_get("r", "$", "map<string, variant>"), lambda k, v: ~k.isin(*FILING, *FILING_NUMBERS))
    shown = F.transform_values(other, lambda k, v: F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))
    return each.select(*[text(n) for n in FILING], *[number(n) for n in FILING_NUMBERS], shown.alias("other"))


def filing_list(spark: SparkSession, path: str) -> DataFrame:
    """The same of files, one day each; files that can't be read are skipped."""
    return filing_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def write_days(days: DataFrame, path: str) -> None:
    """``date, text`` kept by day, compressed; a day that comes again replaces its own and no other."""
    days.select("date", "text").write.partitionBy("date").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").text(path)


def kept_days(spark: SparkSession, path: str) -> DataFrame:
    """``date, text`` as write_days() keeps them. Files that are cut off or gone and folders that aren't named by a day are
    skipped."""
    read = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).schema("text string, date string").text(path, wholetext=True)
    return read.select("date", "text").where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("date", "yyyy-MM-dd").isNotNull())


def kept_dates(spark: SparkSession, path: str) -> DataFrame:
    """The days there are, oldest first. Only names are read: a day whose file is empty, cut off or huge is there, and folders that
    aren't named by a day are not."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(path, "date=*/[!._]*")) or []
    names = {re.search(r"/date=([^/]*)/[^/]*$", f.getPath().toString())[1] for f in found if f.isFile()}
    rows = spark.createDataFrame([(n,) for n in sorted(names)], "date string")
    return rows.where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("date", "yyyy-MM-dd").isNotNull()).orderBy("date")


def split_stubs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that have what is required, and stubs that only tell of a withdrawal."""
    whole = F.col("docID").isNotNull() & F.col("docTypeCode").isNotNull() & F.col("submitDateTime").isNotNull()
    return rows.where(whole), rows.where(~whole & F.col("docID").isNotNull() & (F.coalesce("withdrawalStatus", F.lit(0)) != 0))


def folded(word: Column) -> Column:
    """A search word: width folded, trimmed, upper case. Spark has no Unicode normalisation of its own."""

    @F.pandas_udf("string")
    def fold(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip().upper())

    return fold(word)
