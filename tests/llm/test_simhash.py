import re

import numpy as np
import xxhash
from barspark.llm import graph, queries, simhash


def brute_print(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, most=2):
    ids, x = list(prints), np.array(list(prints.values()), dtype=np.uint64)
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= most) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_covering_is_complete():
    """Any two prints within the threshold share an anchor that one of them owns."""
    rng = np.random.default_rng(5)
    scheme = simhash.Scheme()
    x = rng.integers(0, 2, (300, 64), dtype=np.uint8)
    y = x.copy()
    for i in range(300):
        y[i, rng.choice(64, i % 3, replace=False)] ^= 1
    held = [{True: {}, False: {}} for _ in range(2)]
    for which, bits in enumerate((x, y)):
        blocks = simhash.blocks_of(np.packbits(bits, axis=1, bitorder="little"))
        seen = {}
        for row, key, own in simhash.anchors(blocks, scheme):
            for r, k in zip(row.tolist(), key.tolist(), strict=True):
                seen.setdefault(r, set()).add(k)
                if own:
                    held[which][True].setdefault(r, set()).add(k)
        held[which][False] = seen
    for i in range(300):
        assert len(held[0][True][i]) == 1 and held[0][True][i] <= held[1][False][i]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, sf).collect()}
    prints = {d.doc_id: brute_print(d.text) for d in docs}
    want = brute_components(prints)
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_chains_edges_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 900))
    texts = {}
    for i in range(150):  # each differs from the one before in a word: chains
        base[i * 5] = words[i]
        texts[i * 3 + 7] = " ".join(base)
    texts |= {1: None, 2: "", 3: " \n", 4: "One TWO", 5: "one two", 6: "ONE", 2000: " ".join(rng.choice(words, 30000)), 2001: "É é", 2002: "é é"}
    docs = spark.createDataFrame([(k, v, "p", 0) for k, v in texts.items()], "doc_id long, text string, print string, id int")
    got = {r.id: (bytes(r.print), r.component) for r in simhash.near_duplicates(docs).collect()}
    prints = {k: brute_print(v) for k, v in texts.items()}
    want = brute_components(prints)
    assert {k: (int.from_bytes(v[0]), v[1]) for k, v in got.items()} == {k: (prints[k], want[k]) for k in texts}
    twice = simhash.near_duplicates(docs.unionAll(docs))
    assert twice.count() == 2 * len(texts)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_similarity_scheme_finds_near_copies(spark):
    rng = np.random.default_rng(8)
    words, rows, pairs = [f"w{i}" for i in range(3000)], [], []
    for i in range(200):
        w = list(rng.choice(words, int(rng.integers(60, 400))))
        rows.append((2 * i, " ".join(w), 1))
        v = list(w)
        for at in rng.choice(len(w), max(1, len(w) // 60), replace=False):
            v[at] = "changed"
        rows.append((2 * i + 1, " ".join(v), 1))
        a, b = ({tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (w, v))
        pairs.append(len(a & b) / len(a | b))
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = {r.id: r.component for r in simhash.near_duplicates(docs, simhash.for_similarity()).collect()}
    hit = [got[2 * i + 1] == 2 * i for i, j in enumerate(pairs) if j >= 0.8]
    assert len(hit) > 100 and sum(hit) / len(hit) > 0.95
    assert all(c in (d, d - d % 2) for d, c in got.items())  # no two unrelated texts



def test_only_sets_that_are_alike_link(spark):
    rng = np.random.default_rng(4)
    texts = {}
    for group in range(6):  # texts about 0.8 alike: many estimates are on the wrong side
        base = [f"g{group}w{i}" for i in range(300)]
        for n in range(20):
            w = list(base)
            for at in rng.choice(300, int(rng.integers(2, 9)), replace=False):
                w[at] = f"c{n}"
            texts[100 * group + n] = " ".join(w)
    for n in range(2):  # different words and one line many times: sets that share next to nothing
        texts[1000 + n] = " ".join(f"d{n}w{i}" for i in range(500)) + " one line of ten words that both have many times" * 50
    sets = {k: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for k, t in texts.items()}
    want = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {k: low if c == high else c for k, c in want.items()}
    docs = spark.createDataFrame([*texts.items(), (7000, None), (7001, " "), (None, texts[0])], "doc_id long, text string")
    scheme = simhash.for_similarity(prints=12, spread=3)
    got = {r.id: r.component for r in simhash.alike(docs, 0.8, scheme).collect()}
    assert got == want | {7000: 7000, 7001: 7000, None: 0}
    assert len({c for k, c in want.items() if k < 1000}) > 6
    assert simhash.alike(docs.limit(0), 0.8, scheme).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (300, 200), (250, 200), (200, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)} | dict.fromkeys((200, 250, 300), 200)


def test_large_anchors_give_the_same_components(monkeypatch):
    rng = np.random.default_rng(0)
    anchor, own = np.sort(rng.integers(0, 6, 1500)), rng.random(1500) < 0.3
    prints = rng.integers(0, 2**63, (8, 2)).astype(np.uint64)[rng.integers(0, 8, 1500)]
    for _ in range(9):
        prints[np.arange(1500), rng.integers(0, 2, 1500)] ^= np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)
    prints[::4] = rng.integers(0, 2**63, (375, 2)).astype(np.uint64)
    found = []
    for large, pivots in ((2, 3), (2, 1000), (64, 32), (10**9, 32)):
        for name, value in (("LARGE", large), ("PIVOTS", pivots), ("PAIRS", 5000), ("LINKS", 400)):
            monkeypatch.setattr(simhash, name, value)
        root = np.arange(1500)
        a, b = simhash._compare(anchor, own, np.arange(1500), prints, 14)
        root[a] = b
        found.append(root.tolist())
    assert found[0] == found[1] == found[2] == found[3] and 8 < len(set(found[0])) < 1000
