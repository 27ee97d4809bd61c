"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import dropped, shared_folder, stored  # noqa: F401  what the operators of this subpackage write goes there too

#: White space of every word rule of this subpackage; a word is a run of anything else.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_of(docs: DataFrame) -> Column:
    """The whole row as one column, whatever its columns are called."""
    return F.struct(*[docs["`" + c.replace("`", "``") + "`"] for c in docs.columns])


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
