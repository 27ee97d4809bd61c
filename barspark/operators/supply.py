"""Supply-side reports beside bars: totals as of each day, alignment, carry-forward, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOST_RATIO = 0.5


def lost(note: Column, ratio: Column) -> Column:
    """A report that ends a holder's position; a missing ratio does not."""
    return F.coalesce(note.rlike("消失|解消"), F.lit(False)) | F.coalesce(ratio < LOST_RATIO, F.lit(False))


def short_totals(reports: DataFrame) -> DataFrame:
    """``symbol, date, total_ratio, total_qty, holders`` for every report date: the sum over each holder's latest report
    not lost by then. A report adds on its day and its successor takes it away, so running sums over (symbol, date) do it:
    no join of dates with holders."""
    holder = Window.partitionBy("symbol", "holder_id").orderBy("calc_date")
    until = reports.withColumn("until", F.lead("calc_date").over(holder)).withColumn("lost", lost(F.col("note"), F.col("ratio")))
    ratio = F.coalesce(F.col("ratio"), F.lit(0.0)).cast("decimal(20,6)")
    quantity = F.coalesce("quantity", F.lit(0))
    held = F.struct(ratio.alias("r"), quantity.cast("long").alias("q"), F.lit(1).cast("long").alias("n"))
    none = F.struct(F.lit(0).cast("decimal(20,6)").alias("r"), F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("n"))
    minus = F.struct((-ratio).cast("decimal(20,6)").alias("r"), (-quantity).cast("long").alias("q"), F.lit(-1).cast("long").alias("n"))
    steps = F.array(
        F.struct(F.col("calc_date").alias("date"), F.lit(True).alias("report"), F.when(~F.col("lost"), held).otherwise(none).alias("d")),
        F.struct(F.col("until").alias("date"), F.lit(False).alias("report"), F.when(~F.col("lost"), minus).otherwise(none).alias("d")),
    )
    daily = (
        until.select("symbol", F.explode(steps).alias("x"))
        .where("x.date is not null")
        .groupBy("symbol", "x.date")
        .agg(F.sum("x.d.r").alias("r"), F.sum("x.d.q").alias("q"), F.sum("x.d.n").alias("n"))
    )
    upto = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        "symbol",
        "date",
        F.round(F.sum("r").over(upto).cast("double"), 6).alias("total_ratio"),
        F.sum("q").over(upto).alias("total_qty"),
        F.sum("n").over(upto).alias("holders"),
    )


def align_to_bars(rows: DataFrame, bars: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(bars.select(*on).distinct(), on, "left_semi")


def carry_forward(rows: DataFrame, value: str) -> Column:
    """The last value there was, null before the first."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def points_with_carry(totals: DataFrame, bars: DataFrame) -> DataFrame:
    """Totals on bar dates, and a copy of the last one at the last bar if that is later."""
    on_bars = align_to_bars(totals, bars, ["symbol", "date"]).withColumn("carried", F.lit(False))
    end = bars.groupBy("symbol").agg(F.max("date").alias("end"))
    value = F.struct("total_ratio", "total_qty", "holders")
    last = totals.groupBy("symbol").agg(F.max("date").alias("at"), F.max_by(value, "date").alias("v"))
    extra = last.join(end, "symbol").where("at < end").select("symbol", F.col("end").alias("date"), "v.*", F.lit(True).alias("carried"))
    return on_bars.unionByName(extra)


def runs(rows: DataFrame, flag: Column) -> DataFrame:
    """First and last date and length of each run of rows whose flag holds, in the order of dates of a symbol."""
    order = Window.partitionBy("symbol").orderBy("date")
    marked = rows.withColumn("flag", F.coalesce(flag, F.lit(False))).withColumn("i", F.row_number().over(order))
    inner = Window.partitionBy("symbol", "flag").orderBy("date")
    groups = marked.withColumn("run", F.col("i") - F.row_number().over(inner)).where("flag")
    return groups.groupBy("symbol", "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n")).drop("run")


def next_bar(docs: DataFrame, bars: DataFrame, day: Column) -> DataFrame:
    """``docs`` with ``marker_date``: the first bar date of the symbol on or after ``day``; null before the first bar, after
    the last, and for a missing day.

    One pass over each month of a symbol from its newest date back, without a join. The first bar of a month is carried to the
    months before it, back to the last one that has bars, so that no task holds more of a symbol than a month. Documents without a day
    stay dealt as they came. Bars without a date count for nothing.
    """

    def month(c: Column) -> Column:
        return F.year(c) * 12 + F.month(c)

    left = docs.select(
        "symbol", day.alias("day"), F.coalesce(month(day), -1 - F.spark_partition_id()).alias("block"),
        F.lit(None).cast("date").alias("bar"), F.lit(None).cast("date").alias("start"), F.struct(*docs.columns).alias("doc"),
    )
    none = F.lit(None).cast(left.schema["doc"].dataType).alias("doc")
    dated = bars.where(bars["date"].isNotNull()).select("symbol", F.col("date").alias("bar"), month(F.col("date")).alias("block"))
    right = dated.select("symbol", F.col("bar").alias("day"), "block", "bar", F.lit(None).cast("date").alias("start"), none)
    firsts = dated.groupBy("symbol", "block").agg(F.min("bar").alias("bar"))
    before = F.lag("block").over(Window.partitionBy("symbol").orderBy("block"))  # a row a month
    to = F.when(F.col("before").isNull(), F.array("block")).otherwise(F.sequence("before", F.col("block") - 1))
    is_first = F.col("before").isNull()
    carried = firsts.withColumn("before", before).select(
        "symbol", F.lit(None).cast("date").alias("day"), F.explode(to).alias("block"), F.when(~is_first, F.col("bar")).alias("bar"),
        F.when(is_first, F.col("bar")).alias("start"), none,
    )
    # what is carried first, then newest first, bars before the documents of their day: the last bar so far is the next one
    back = Window.partitionBy("symbol", "block").orderBy(F.desc_nulls_first("day"), F.col("bar").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).unionByName(carried)
    found = both.withColumn("next", F.last("bar", ignorenulls=True).over(back)).withColumn("from", F.last("start", ignorenulls=True).over(back))
    inside = F.col("day").isNotNull() & F.coalesce(F.col("day") >= F.col("from"), F.lit(True))
    return found.where("doc is not null").select("doc.*", F.when(inside, F.col("next")).alias("marker_date"))
