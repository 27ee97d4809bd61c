import pytest
from barspark.operators import merge
from pyspark.sql import Observation
from pyspark.sql import functions as F

ROW = "symbol string, date string, kind string, balance int, batch int, place int"


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_the_last_of_a_batch_wins_however_rows_are_dealt(spark, parts):
    rows = [("X", "d", "final", 10, 2, 1), ("X", "d", "final", 20, 2, 2), ("X", "d", "prelim", 99, 9, 9), ("Y", "d", "prelim", 5, 1, 2), ("Y", "d", "prelim", 4, 1, 1)]
    frame = spark.createDataFrame(rows * 3, ROW).repartition(parts)
    for df in (frame, frame.orderBy(F.desc("place")), frame.orderBy("place")):
        assert {r.symbol: r.balance for r in merge.final_over_prelim(df, ["symbol", "date"], "place").collect()} == {"X": 20, "Y": 5}
        won = merge.last_writer_wins(df.where("batch < 2"), df.where("batch >= 2"), ["symbol", "date"], "batch", "place")
        assert {r.symbol: r.balance for r in won.collect()} == {"X": 99, "Y": 5}


def test_outcomes_of_a_batch_and_their_counts(spark):
    kept = spark.createDataFrame([("A.T", "d1", "final", 1), ("A.T", "d0", "prelim", 0), ("B.T", "d1", "prelim", 2), ("C.T", "d1", "final", 3), ("Z.T", "d1", "prelim", 9)], "symbol string, date string, kind string, balance int")
    batch = spark.createDataFrame(
        [("A", "d1", "prelim", 11, 1), ("B", "d1", "prelim", 20, 1), ("B", "d1", "prelim", 21, 2), ("C", "d1", "final", 30, 1), ("D", "d1", "prelim", 40, 3), ("X", "d1", "final", 50, 1)],
        "code string, date string, kind string, balance int, place int",
    )
    registered = spark.createDataFrame([(f"{c}.T", c) for c in "ABCDE"], "symbol string, code string")
    counts = Observation()
    after = merge.save_balances(kept, batch, registered, counts)
    assert sorted(map(tuple, after.collect())) == [
        ("A.T", "d0", "prelim", 0), ("A.T", "d1", "final", 1), ("B.T", "d1", "prelim", 21), ("C.T", "d1", "final", 30), ("D.T", "d1", "prelim", 40), ("Z.T", "d1", "prelim", 9),
    ]
    assert counts.get == {"saved": 3, "skipped": 1, "missing": 1}
    outcome = {r.symbol: r.outcome for r in merge.balance_outcomes(kept, batch, registered).collect()}
    assert outcome == {"A.T": "skipped", "B.T": "saved", "C.T": "saved", "D.T": "saved", "E.T": "missing"}
    again = merge.save_balances(after, batch, registered, Observation())
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))
    assert merge.save_balances(kept, batch.limit(0), registered, Observation()).count() == kept.count()


def test_rows_without_a_link_are_dropped(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "doc string, v int, w string")
    new = spark.createDataFrame([("a", None, "y", 1), ("a", 7, None, 2), ("b", 5, "z", 1), ("c", 6, "z", 1)], "doc string, v int, w string, place int")
    links = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1)], "doc string, n int")
    assert sorted(map(tuple, merge.replace_linked(old, new, links, "doc", "place").collect())) == [("a", 7, None), ("b", 2, "x"), ("c", 6, "z")]
