"""What a text about a symbol is made from: recent bars whole, older ones summed up; numbers of a text checked.

Only bars, indicators, filings and fundamentals come here, never supply reports.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import number_tokens

RAW = 20
LEVEL = ("macd", "macd_signal", "momentum", "momentum_signal", "stddev", "parabolic")


def split_recent(rows: DataFrame, days: int, raw: int = RAW) -> DataFrame:
    """The last ``days`` rows of each symbol, with ``recent`` for the last ``raw`` of them."""
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return rows.withColumn("nth", F.row_number().over(back)).where(F.col("nth") <= days).withColumn("recent", F.col("nth") <= raw).drop("nth")


def summary(older: DataFrame) -> DataFrame:
    """One row a symbol for a stretch of bars."""
    return older.groupBy("symbol").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("bars"),
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"),
        F.avg("volume").alias("volume_avg"), F.max("volume").alias("volume_max"),
    )


def direction(start: Column, end: Column, percent_kind: Column) -> Column:
    """up, down or flat: by five points for values in percent, else by three percent; by sign from about zero."""
    change = end - start
    near = F.abs(start) < 1e-9
    rate = F.when(percent_kind, change / 5).when(near, F.when(F.abs(change) > 1e-9, F.signum(change) * 2).otherwise(0.0)).otherwise(change / F.nullif(F.abs(start), F.lit(0.0)) * 100 / 3)
    return F.when(rate > 1, "up").when(rate < -1, "down").otherwise("flat")


PERCENT_KIND = ("rsi", "rci_short", "rci_long", "plus_di", "minus_di", "adx", "stoch_k", "stoch_d", "deviation_short", "deviation_long", "psychological")


def indicator_summary(older: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A row a symbol and indicator with any value: first, last, least, largest, direction."""
    long = older.unpivot(["symbol", "date"], list(columns), "indicator", "value").where("value is not null")
    by = long.groupBy("symbol", "indicator").agg(
        F.min_by("value", "date").alias("start_value"), F.max_by("value", "date").alias("end_value"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    return by.withColumn("direction", direction(F.col("start_value"), F.col("end_value"), F.col("indicator").isin(*PERCENT_KIND)))


def tokens(rows: DataFrame, text: str = "text") -> DataFrame:
    """A row for each number or date of a text, with ``place`` (from 0) and ``token``; the other columns stay, the text too."""
    return rows.select("*", F.posexplode(number_tokens(F.col(text))).alias("place", "token"))


@F.pandas_udf(T.StringType())
def _shown(token: pd.Series, decimals: pd.Series) -> pd.Series:
    """The number as a double at so many decimals, rounded by its exact value; with -1 as short as it can be read back."""
    values = token.str.replace(",", "").astype(float)
    return pd.Series([str(v) if d < 0 else f"{v:.{d}f}" for v, d in zip(values, decimals, strict=True)], dtype=object)


def _is_date(token: Column) -> Column:
    return token.rlike(r"^\d{4}-\d{2}-\d{2}$")


def _decimals(token: Column) -> Column:
    return F.length(F.regexp_extract(token, r"\.(\d+)$", 1))


def judged(claims: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """``claims`` (the key, ``token`` and any others) with ``found``: whether the sources of their key have the token. Whole numbers
    from 1 to 10 are left out.

    Dates must be the same. Numbers agree if one is the other at the decimals of either, whatever the number of digits. Every
    number is written at its own decimals and at those that the other side has in its key, and hash joins find what agrees.
    A claim whose key has no sources isn't found; a null key meets null keys.
    """
    names = [f"_k{i}" for i in range(len(key))]
    packed = lambda df: df.select(*[F.coalesce(F.to_json(F.struct(k)), F.lit("")).alias(n) for k, n in zip(key, names, strict=True)], "token")
    token = F.col("token")
    small = F.coalesce(~token.rlike("[,.]") & token.try_cast("int").between(1, 10), F.lit(False))
    asked = claims.where(token.isNotNull() & ~small)
    own, theirs = packed(asked).distinct(), packed(sources.where(token.isNotNull())).distinct()
    told = [df.where(~_is_date(token)).withColumn("d", _decimals(token)) for df in (own, theirs)]
    written = [df.withColumn("v", _shown("token", "d")) for df in told]

    def at_others(df: DataFrame, other: DataFrame) -> DataFrame:
        """The numbers at each number of decimals that the other side has."""
        return df.drop("d").join(other.select(*names, "d").distinct(), names).withColumn("v", _shown("token", "d"))

    on = [*names, "d", "v"]
    hits = [
        written[0].join(at_others(told[1], told[0]).select(*on).distinct(), on, "left_semi"),
        at_others(told[0], told[1]).join(written[1].select(*on).distinct(), on, "left_semi"),
    ]
    same = own.where(_is_date(token)).join(theirs, [*names, "token"], "left_semi")
    hit = hits[0].select(*names, "token").unionByName(hits[1].select(*names, "token")).unionByName(same).distinct().withColumn("found", F.lit(True))
    keyed = asked.withColumns({n: F.coalesce(F.to_json(F.struct(k)), F.lit("")) for k, n in zip(key, names, strict=True)})
    return keyed.join(hit, [*names, "token"], "left").withColumn("found", F.coalesce("found", F.lit(False))).select(*claims.columns, "found")


def verify(claims: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """``key, checked, found, rate``: how many of a key's tokens its sources have. A key without a token to check has no row."""
    by = judged(claims, sources, key).groupBy(*key).agg(F.count("*").alias("checked"), F.count_if("found").alias("found"))
    return by.withColumn("rate", F.col("found") / F.col("checked"))


def missing(claims: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """The claims that their sources don't have, with ``number``: a number as a double reads, a date as it stands."""
    gone = judged(claims, sources, key).where("not found").drop("found")
    return gone.withColumn("number", F.when(_is_date(F.col("token")), F.col("token")).otherwise(_shown(F.when(_is_date(F.col("token")), "0").otherwise(F.col("token")), F.lit(-1))))
