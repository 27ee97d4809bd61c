import hashlib
import math

import numpy as np
from barspark.llm import part_codes, queries


def brute(rows, entries=256, rounds=4, parts=4):
    """{place in rows: (code, error)} and the digest, with Python's whole numbers."""
    kept = [(i, r[0], [math.floor(1024 * x) if abs(x) < 1e15 else int(x) * 1024 for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    wide = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    cut = [[(v + [0] * (wide * parts - len(v)))[p * wide : (p + 1) * wide] for p in range(parts)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][1] is None, kept[k][1] or 0, kept[k][2]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]

    def assign(p):
        book = np.array(books[p], object)
        out = []
        for v in cut:
            d = book - np.array(v[p], object)
            d = (d * d).sum(axis=1).tolist() if wide else [0] * len(books[p])
            out.append(min((x, e) for e, x in enumerate(d))[::-1])
        return out

    for _ in range(rounds):
        for p in range(parts):
            sums = {}
            for v, (e, _) in zip(cut, assign(p), strict=True):
                n, s = sums.get(e, (0, [0] * wide))
                sums[e] = n + 1, [a + b for a, b in zip(s, v[p], strict=True)]
            for e, (n, s) in sums.items():
                books[p][e] = [x // n for x in s]
    done = [assign(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ([d[k][0] for d in done], sum(d[k][1] for d in done)) for k, (i, _, _) in enumerate(kept)}, digest


def test_transform_keeps_distances_in_order_of_sequency():
    for n in (1, 2, 8, 32):
        h = part_codes.walsh(n)
        assert (h @ h.T == n * np.eye(n, dtype=int)).all()
        assert [(row[1:] != row[:-1]).sum() for row in h] == list(range(n))


def test_nearest_is_exact_with_ties_and_large_numbers():
    rng = np.random.default_rng(1)
    for length, high in ((1, 5), (3, 4), (16, 3000), (5, 2**21), (16, 2**40), (7, 2**70)):
        parts = np.array([[int(x) * (high // 2**20 + 1) for x in row] for row in rng.integers(-(min(high, 2**20)), min(high, 2**20), (300, length))], object)
        book = parts[rng.integers(0, 300, 40)] + rng.integers(-1, 2, (40, length)).astype(object)
        d = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        small = [a.astype(np.int64) if high < 2**50 else a for a in (parts, book)]
        for prefix in (1, 4, 64):
            entry, error = part_codes.nearest(*small, prefix)
            assert entry.tolist() == [row.tolist().index(min(row)) for row in d] and error.tolist() == d.min(axis=1).tolist()


def test_small_tables(spark):
    rng = np.random.default_rng(4)
    bad = [(900, None, 1), (901, [0.5, None, 1.0, 1.0], 1), (902, [float("nan")] * 4, 2), (903, [float("-inf"), 0.0, 0.0, 0.0], None)]
    tables = [
        bad,
        [],
        [(7, [0.25, -0.1, 3.0, 0.0], 1)],
        [(1, [], 1), (2, [], None)],
        [(i, [float(x) for x in rng.integers(-2, 3, 8)], int(i % 3) if i % 5 else None) for i in range(700)] + bad,
        [(i // 2, rng.normal(size=int(rng.integers(0, 12))).tolist(), 1) for i in range(400)] + [(None, [1.0], 2)] * 3,
        [(i, (rng.normal(size=6) * 10.0 ** rng.integers(-3, 14)).tolist(), 3) for i in range(300)] + [(999, [1e305] * 6, 4)],
    ]
    for rows in tables:
        frame = spark.createDataFrame([(*r, 5, "c") for r in rows], "vec_id long, embedding array<double>, label int, id int, code string")
        want, digest = brute(rows)
        coded = part_codes.encode(frame)
        got = part_codes.with_label_errors(coded.rows).collect()
        fit = lambda e: e if e < 2**63 else None
        assert sorted(map(repr, ((r.id, r.label, list(r.code), r.error) for r in got))) == sorted(
            map(repr, ((rows[i][0], rows[i][2], c, fit(e)) for i, (c, e) in want.items()))
        )
        assert coded.digest() == digest
        for label in {r[2] for r in rows}:
            errors = [fit(e) for i, (_, e) in want.items() if rows[i][2] == label]
            total = fit(sum(e for e in errors if e is not None)) if any(e is not None for e in errors) else None
            assert {r.label_error for r in got if r.label == label} <= {total}


def test_many_labels_are_joined_by_shuffles(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3, [1], i) for i in range(300)], "id long, label int, code array<int>, error long")
    few = sorted(map(repr, part_codes.with_label_errors(rows).collect()))
    monkeypatch.setattr(part_codes, "FEW", 0)
    assert sorted(map(repr, part_codes.with_label_errors(rows).collect())) == few and len(few) == 300


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = brute(rows)
    got = queries.op12_part_codes(spark, sf).collect()
    by_label = {}
    for i, (_, e) in want.items():
        by_label[rows[i][2]] = by_label.get(rows[i][2], 0) + e
    assert sorted(tuple(r) for r in got) == sorted((rows[i][0], "".join(f"{c:02x}" for c in code), e, by_label[rows[i][2]], digest) for i, (code, e) in want.items())
