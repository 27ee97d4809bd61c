import datetime as dt
import random

from barspark.operators import metering
from barspark.streaming import rates

SCHEMA = "model string, ts timestamp, tokens long, is_request boolean, event_id long"


def test_counts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rng = random.Random(1)
    begin = dt.datetime(2024, 3, 1, 11, 58, 30)
    times = sorted(begin + dt.timedelta(microseconds=rng.choice([rng.randrange(600_000_000), 60_000_000 * rng.randrange(10)])) for _ in range(500))
    rows = [(rng.choice("ab"), t, rng.randrange(50), rng.random() < 0.6, i) for i, t in enumerate(times)]
    rows.append((None, begin + dt.timedelta(seconds=1), None, None, 500))
    late = ("a", begin + dt.timedelta(seconds=2), 10**6, True, 999)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(batch):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = rates.trailing_minute(spark.readStream.schema(SCHEMA).parquet(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(0, 100)))  # up to 100 seconds late
    for k in range(0, len(order), 140):
        run(order[k : k + 140])
    run([("z", begin + dt.timedelta(hours=1), 0, False, 10_000)])  # all windows of before end
    run([late, ("z", begin + dt.timedelta(hours=1, minutes=1), 0, False, 10_001)])
    got = sorted((r.event_id, r.requests_60s, r.tokens_60s) for r in spark.read.parquet(out).collect())
    whole = metering.trailing_minute(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got == sorted((r.event_id, r.requests_60s, r.tokens_60s or 0) for r in whole)
    table = rates.trailing_minute(spark.createDataFrame(rows, SCHEMA)).collect()  # a table is a stream that has ended
    assert sorted((r.event_id, r.requests_60s, r.tokens_60s) for r in table) == got and rates.trailing_minute(spark.createDataFrame([], SCHEMA)).count() == 0
