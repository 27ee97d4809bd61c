import numpy as np
import pytest
from barspark.llm import alike, simhash


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def parts_of(n, links):
    part = list(range(n))
    for a, b in links:
        low, high = sorted((part[a], part[b]))
        part = [low if p == high else p for p in part]
    return part


def families(rng, n, values=400):
    """Sets in groups: templates of which elements were exchanged, of several sizes, and sets on their own."""
    out = []
    while len(out) < n:
        base = rng.choice(values, int(rng.integers(0, 60)), replace=False)
        for _ in range(int(rng.integers(1, 30))):
            now = set(base.tolist())
            for x in base[: int(rng.integers(0, 1 + len(base) // 3))].tolist() if rng.random() < 0.5 else rng.permutation(base)[: int(rng.integers(0, 1 + len(base) // 5))].tolist():
                now.discard(x)
                if rng.random() < 0.6:
                    now.add(int(rng.integers(-(2**62), 2**62) if rng.random() < 0.5 else rng.integers(0, values)))
            out.append(now)
    return out[:n]


@pytest.mark.parametrize(("many", "pairs", "looked_up"), [(64, 10**6, 10**6), (2, 40, 50), (6, 300, 10**5)])
def test_links_connect_what_all_alike_pairs_connect(monkeypatch, many, pairs, looked_up):
    for name, value in (("MANY", many), ("PAIRS", pairs), ("LOOKED_UP", looked_up)):
        monkeypatch.setattr(alike, name, value)
    rng = np.random.default_rng(many)
    found = 0
    for turn in range(12):
        sets = families(rng, int(rng.integers(1, 160)))
        n = len(sets)
        group = np.sort(rng.integers(0, 3, n))
        row, col = (np.ones((2, n), bool) if turn % 2 else rng.random((2, n)) < 0.6)
        for s in (0.5, 0.8, 0.95):
            want = [(a, b) for a in range(n) for b in range(a) if group[a] == group[b] and (row[a] & col[b] | row[b] & col[a]) and (sets[a] and sets[b]) and jaccard(sets[a], sets[b]) >= s]
            got = list(alike.within(group, np.arange(n), row, col, np.array([len(x) for x in sets]), np.array([x for y in sets for x in sorted(y)], np.int64), s))
            links = [(int(a), int(b)) for p, q in got for a, b in zip(p, q, strict=True)]
            assert parts_of(n, links) == parts_of(n, want)
            found += len(want)
    assert found > 1000


@pytest.mark.parametrize("block", [None, 200, 1500])
def test_groups_of_one_and_of_many_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(alike, "CENTRES", 3)
    rng = np.random.default_rng(9)
    sets = families(rng, 500, 150)
    roots = [int(x) for x in rng.choice([-5, 7, 8, 9], 500, p=[0.7, 0.1, 0.1, 0.1])]
    frame = spark.createDataFrame([(1000 - i, r, list(s)) for i, (r, s) in enumerate(zip(roots, sets, strict=True))], "node long, root long, set array<long>")
    got = [(1000 - r.a, 1000 - r.b) for r in alike.links(frame.repartition(7), 0.8, block).collect()]
    want = [(a, b) for a in range(500) for b in range(a) if roots[a] == roots[b] and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
    assert parts_of(500, got) == parts_of(500, want) and len(got) < 4 * 500
    assert alike.links(frame.limit(0), 0.8, block).count() == 0


def test_components_of_a_table_equal_those_of_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sets = {}
    for d in docs.collect():
        w = (d.text or "").encode().lower().split()
        sets[d.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if jaccard(sets[ids[a]], sets[ids[b]]) >= 0.8]
    want = {ids[i]: ids[p] for i, p in enumerate(parts_of(len(ids), links))}
    got = {r.id: r.component for r in simhash.alike(docs, 0.8, simhash.for_similarity(0.8, words=5, prints=12, spread=3)).collect()}
    assert got == want and len(links) > 5
