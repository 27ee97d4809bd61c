"""Bars from a stream of files; the reference polls, so this goes beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge

BAR = "symbol string, date date, open double, high double, low double, close double, volume long"


def bar_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with ``splits`` (null where a file has none) and ``place``: the order of rows that come in one batch, by file and row."""
    file = F.col("_metadata")
    place = F.struct(file["file_modification_time"].alias("at"), file["file_path"].alias("file"), file["row_index"].alias("row"))
    return spark.readStream.schema(BAR + ", splits double").parquet(folder).select("*", F.to_json(place).alias("place"))


def stored_rows(batch: DataFrame, target: str) -> DataFrame:
    """The rows at ``target`` of the symbols of a batch, in the columns of the batch; none where there is no table yet."""
    spark = batch.sparkSession
    try:
        old = spark.read.parquet(target).select(*batch.columns)
    except Exception as e:  # the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = batch.limit(0)
    return old.join(batch.select("symbol").distinct(), "symbol", "left_semi").select(*batch.columns)


def rewrite(rows: DataFrame, target: str, number: int) -> None:
    """Replaces the symbols of ``rows`` in the table at ``target``. The table of before stays until the new rows are written beside
    it; what was written beside it goes when it has been taken over."""
    spark = rows.sparkSession
    staged = f"{target}-staged-{number}"
    rows.write.mode("overwrite").parquet(staged)
    spark.read.schema(rows.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(target)
    path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_merged(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Every batch replaces the bars that it has in the table at ``target``, by symbol and date, of equal ones the last in its order;
    a split after the last bar replaces the symbol's whole history by the batch. Only the symbols of the batch are rewritten. A batch wins over what
    is there whatever its number: the same batch again changes nothing, and under a new checkpoint, where all files are one batch,
    only what a split took away comes back."""
    columns = [c.split()[0] for c in BAR.split(", ")]

    def upsert(batch: DataFrame, number: int) -> None:
        batch = batch.dropna(subset=["open", "high", "low", "close"]).persist()
        try:
            old = stored_rows(batch.select(*columns), target)
            reload = merge.needs_reload(old, batch).where("reload").select("symbol")
            stay = old.join(reload, "symbol", "left_anti").withColumns({"splits": F.lit(None).cast("double"), "place": F.lit(""), "turn": F.lit(0)})
            merged = merge.last_writer_wins(stay.select(*batch.columns, "turn"), batch.withColumn("turn", F.lit(1)), ["symbol", "date"], "turn", "place")
            rewrite(merged.select(*columns), target, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
