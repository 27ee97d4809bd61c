import numpy as np
import pandas as pd
import pytest
from barspark.llm import multi_index as mi
from barspark.llm import queries


def exact(ids, x, every, k=10):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        other = np.flatnonzero(ids != ids[i])
        best = other[np.lexsort((ids[other], far[other]))][:k]
        out[int(ids[i])] = [(int(ids[b]), float(far[b])) for b in best]
    return out


def test_traverse_is_in_order():
    rng = np.random.default_rng(4)
    a, b, counts = rng.random(7), rng.random(9), rng.integers(0, 3, 63)
    got = mi.traverse(a, b, counts, int(counts.sum()))
    want = [c for c in np.argsort((a[:, None] + b).ravel()) if counts[c]]
    assert got == want


def recall(got, want):
    return sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    got = found(queries.op8_multi_index(spark, f"/root/testdata/{sf}"))
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    want, place = exact(ids, x, 100), {int(i): n for n, i in enumerate(ids)}
    assert set(got) == set(want)
    for q, near in got.items():
        assert len(near) == 10 and [s for _, s in near] == sorted(s for _, s in near)
        for v, s in near:
            assert abs(s - np.sqrt(((x[place[v]] - x[place[q]]) ** 2).sum())) < 1e-12
    assert recall(got, want) >= 0.9


@pytest.mark.parametrize("n", [6000, 24000])
def test_clustered_vectors_need_a_small_share(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, n)] * 4 + rng.normal(size=(n, 16))
    index = mi.MultiIndex(sample=3000, centroids=24, block=2500, probes=100)
    halves = [mi.fit(x[:3000, :8], 24, 12, 1), mi.fit(x[:3000, 8:], 24, 12, 2)]
    assert mi.measured_share(x[:3000], halves, index) < 0.25
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}))
    got, want = found(mi.search(frame, 100, index)), exact(np.arange(n), x, 100)
    assert set(got) == set(want) and recall(got, want) >= 0.9


@pytest.mark.parametrize("n", [2, 10, 11, 13])
def test_small_tables_by_the_default_index(spark, n):
    x = np.random.default_rng(n).random((n, 3))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = found(mi.search(frame, 3))
    assert got == {q: [(v, pytest.approx(s)) for v, s in near] for q, near in exact(np.arange(n), x, 3).items()}


def test_small_tables_are_looked_at_in_part_too():
    """The share holds at any size: 600 clustered rows are not searched whole, and few probes ask for more than many."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 8))[rng.integers(0, 20, 600)] * 6 + rng.normal(size=(600, 8))
    halves = [mi.fit(x[:, :4], 16, 12, 1), mi.fit(x[:, 4:], 16, 12, 2)]
    many, few = (mi.measured_share(x, halves, mi.MultiIndex(probes=p)) for p in (600, 12))
    assert many < 0.4
    needs_all = mi.measured_share(x, halves, mi.MultiIndex(probes=12, recall=1.0))
    assert few == needs_all  # two standard errors of twelve probes reach beyond everything


def test_blocks_are_bounded():
    counts = np.array([3, 0, 50, 4, 4, 4, 9, 10, 1])
    first, parts = mi.blocks_of(counts, 10)
    load = {}
    for c, f, p in zip(counts, first, parts, strict=True):
        for k in range(p if c else 0):
            load[f + k] = load.get(f + k, 0) + -(-c // p)
    assert max(load.values()) <= 10 and parts[2] == 5 and first[1] == -1


def test_ties_unusable_vectors_and_small_tables(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(0, 60)] + [(i, rng.random(4).tolist()) for i in range(60, 130)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [float("nan")] * 4), (204, [float("inf"), 1.0, 1.0, 1.0]), (300, [1.0]), (205, []), (None, [1.0] * 4), (60, None)]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, cell int, v int")
    small = mi.MultiIndex(centroids=4, block=16, share=1.0)
    got = {}
    for r in mi.search(docs, 20, small).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    good = rows[:130]
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good], dtype=np.float32).astype(np.float64)
    want = exact(ids, x, 20)
    assert {q: [v for v, _ in f] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()}
    assert got[0][0] == (1, 0.0) and got[20][0] == (0, 0.0)
    assert mi.search(docs.limit(0), 20, small).count() == 0
    few = docs.where("vec_id in (0, 60, 61) and embedding is not null")
    assert mi.search(few, 60, small).groupBy("query_id").count().orderBy("query_id").collect() == [(0, 2), (60, 2)]
