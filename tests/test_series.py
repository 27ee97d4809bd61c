import datetime as dt
import json

from barspark.operators import indicators as ind
from barspark.operators import series
from pyspark.sql import functions as F

D = dt.date.fromisoformat


def test_items_on_one_index(spark):
    index = spark.createDataFrame([("A", D(f"2024-01-0{d}")) for d in (2, 3, 4)] + [("B", D("2024-01-02"))], "symbol string, date date")
    rows = [("A", "x", "2024-01-02", 1.0), ("A", "x", "2024-01-09", 9.0), ("A", "y", "2024-01-03", None), ("A", "z", "2024-01-09", 1.0), ("A", "n", "2024-01-02", float("nan")), ("C", "x", "2024-01-02", 1.0)]
    there = spark.createDataFrame([(s, i, D(d), v) for s, i, d, v in rows], "symbol string, item string, date date, value double")
    got = sorted(map(tuple, series.aligned(index, there, ["symbol"]).collect()))
    assert got == [("A", "x", D("2024-01-02"), 1.0), ("A", "x", D("2024-01-03"), None), ("A", "x", D("2024-01-04"), None)]
    assert series.aligned(index.limit(0), there, ["symbol"]).count() == 0


def test_newest_are_worked_off_oldest_first(spark):
    rows = spark.createDataFrame([("a", n, 10 - n) for n in range(6)] + [("b", 1, 1)], "k string, at int, id int")
    assert sorted((r.k, r.turn, r["at"]) for r in series.in_turn(rows, "k", 3, ["at", "id"]).collect()) == [("a", 1, 3), ("a", 2, 4), ("a", 3, 5), ("b", 1, 1)]
    again = spark.createDataFrame([("x", 3), ("y", 1), ("x", 2), (None, 5), (None, 4)], "v string, pos int")
    assert [r.v for r in series.distinct_in_order(again, ["v"], "pos").orderBy("pos").collect()] == ["y", "x", None]


def test_short_dates_and_json_in_a_script(spark):
    text = json.dumps({"a": "</script><!-- &   "}, ensure_ascii=False)
    got = spark.createDataFrame([(text, D("2024-03-09"))], "t string, d date").select(series.script_safe(F.col("t")).alias("s"), series.short_date(F.col("d")).alias("d")).first()
    assert json.loads(got.s) == json.loads(text) and not set(got.s) & set("<>&  ") and got.d == "3/9"


def test_every_indicator_has_a_meaning_that_goes_along(spark, tmp_path):
    assert len(series.MEANINGS) == 15 and sorted(c for columns, _ in series.MEANINGS.values() for c in columns) == sorted(ind.COLUMNS)
    made = series.described(spark.createDataFrame([("A", 1.0, None)], "symbol string, rsi double, adx double"))
    made.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.schema["rsi"].metadata["group"] == "rsi" and back.schema["symbol"].metadata == {}
    assert sorted((r.column_name, r.group_name, r.n_values) for r in series.meanings(back).collect()) == [("adx", "direction", 0), ("rsi", "rsi", 1)]
