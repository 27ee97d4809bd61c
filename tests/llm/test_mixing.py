import re

import pytest
from barspark.llm import mixing, queries


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    whole, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = whole - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs):
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + words(d.text)
    want, taken, largest = expected_targets(sizes), {}, {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3 and (r.size or not r.copies)
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6, s


def test_whole_table_near_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = mixing.mix(docs, fan_in=16).collect()
    assert len(one) == docs.count()
    check(one, docs.collect())
    two = mixing.mix(docs.repartition(7), fan_in=16).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_nulls_ties_repeats_hot_source_and_small_caps(spark):
    rows = [(i, "w " * (1 + i % 40), "hot") for i in range(900)]
    rows += [(i, "a b c", None) for i in range(900, 905)] + [(950, None, "z"), (951, "", "z"), (None, "x y", "z")]
    rows += [(960, "same row", "r")] * 6 + [(961, "x", "s0")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, part int, key string")
    got = mixing.mix(docs, fan_in=8).collect()
    assert len(got) == len(rows)
    check(got, docs.collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_expectation_is_kept(spark):
    """Over many disjoint seeds (ids) each of three unequal fractions comes up as often as its share."""
    parts = spark.range(3000).selectExpr(
        "cast(id div 3 as string) AS source", "named_struct('id', id, 'size', 1L, 'nth', 1L) AS key",
        "cast(1 + id % 3 AS double) AS size", "element_at(array(0.2D, 0.5D, 0.7D), cast(1 + id % 3 AS int)) AS part",
    )
    up = mixing.round_parts(parts, 8, 3000).selectExpr("key.id % 3 AS k", "cast(up AS int) AS up").groupBy("k").avg("up").collect()
    for r in up:
        assert abs(r[1] - (0.2, 0.5, 0.7)[r[0]]) < 0.06


def test_the_query_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = {r.doc_id: r for r in queries.op4_mixing(spark, sf).collect()}
    assert len(rows) == len(docs)
    sizes, largest, taken = {}, {}, {}
    for d in docs:
        n, r = words(d.text), rows[d.doc_id]
        assert r.size == n and 0 <= r.taken <= 3 * n
        sizes[d.source] = sizes.get(d.source, 0) + n
        largest[d.source] = max(largest.get(d.source, 0), n)
        taken[d.source] = taken.get(d.source, 0) + r.taken
    targets = expected_targets(sizes)
    for d in docs:
        assert rows[d.doc_id].source_size == sizes[d.source] and abs(rows[d.doc_id].target - targets[d.source]) < 1e-6 * max(1, targets[d.source])
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)
    again = {r.doc_id: r.taken for r in queries.op4_mixing(spark, sf).collect()}
    assert again == {k: r.taken for k, r in rows.items()}
