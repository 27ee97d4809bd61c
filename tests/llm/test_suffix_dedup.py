import hashlib
from collections import Counter

import numpy as np
from barspark.llm import queries, suffix_dedup


def brute(texts, length):
    raws = {k: (v or "").encode() for k, v in texts.items()}
    count = Counter(r[i : i + length] for r in raws.values() for i in range(len(r) - length + 1))
    out = {}
    for k, r in raws.items():
        gone = np.zeros(len(r) + 1, np.int8)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = 1
        edge = np.diff(np.r_[0, gone])
        out[k] = (len(r), list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)))
    return raws, out


def check(rows, texts, length):
    raws, want = brute(texts, length)
    assert len(rows) == len(texts)
    for r in rows:
        spans = [(s["first"], s["after"]) for s in r.spans]
        assert (r.n_bytes, spans) == want[r.id], r.id
        kept, at = b"", 0
        for a, b in spans:
            kept += raws[r.id][at:a]
            at = b
        assert bytes(r.kept) == kept + raws[r.id][at:]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 4, 200):
        pieces = [bytes(rng.integers(0, letters, int(n), dtype=np.uint8)) for n in rng.integers(0, 300, 20)]
        pieces += [b"\0" * 50, b"ab" * 60, b"ab" * 60, b""]
        sizes = np.array([len(p) for p in pieces])
        begins = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
        stop = np.repeat(begins + sizes, sizes + 1)
        order = suffix_dedup.suffix_array(text, stop)
        assert sorted(order.tolist()) == list(range(len(text)))
        suffix = [text[i : stop[i]].tobytes() for i in order]
        assert all(a <= b for a, b in zip(suffix, suffix[1:], strict=False))
        prefix = suffix_dedup.common_prefixes(text, stop, order, 40)
        for k in range(1, len(order)):
            a, b = suffix[k - 1], suffix[k]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert prefix[k] == n


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 7))))
    texts = {}
    passages = [" ".join(word() for _ in range(k)) for k in (12, 14, 30)]
    for i in range(n):
        parts = [word() for _ in range(int(rng.integers(0, 80)))]
        if i % 3 == 0:
            parts.insert(len(parts) // 2, passages[i % 9 // 3])
        if i % 10 == 1:
            parts = texts[i - 1].split(" ")
            parts[len(parts) // 2] = "changed"
        texts[i] = " ".join(parts)
        if i % 10 == 5:
            texts[i] = texts[i - 2]
    return texts | {n: "x" * 300, n + 1: "ab" * 100, n + 2: None, n + 3: "", n + 4: "y" * 40, n + 5: texts[0] * 2}


def test_small_lengths_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 3000)
    monkeypatch.setattr(suffix_dedup, "BATCH", 2000)
    for seed, spread in ((1, 2000), (2, 2), (3, 1)):  # the last ones spread most anchors over shards
        monkeypatch.setattr(suffix_dedup, "SPREAD", spread)
        texts = corpus(seed)
        docs = spark.createDataFrame([(k, v, 1, "n") for k, v in texts.items()], "doc_id long, text string, first int, kept string")
        check(suffix_dedup.remove_repeats(docs, 40).collect(), texts, 40)
    assert suffix_dedup.remove_repeats(docs.limit(0), 40).count() == 0
    twice = docs.where("doc_id = 3")
    assert len(texts[3]) > 40 and {bytes(r.kept) for r in suffix_dedup.remove_repeats(twice.unionAll(twice), 40).collect()} == {b""}
    nameless = docs.where("doc_id in (3, 4)").selectExpr("cast(null as long) AS doc_id", "text")
    again = suffix_dedup.remove_repeats(nameless.unionAll(nameless.where("length(text) = %d" % len(texts[3]))), 40).collect()
    assert sorted((len(r.kept), r.n_bytes) for r in again) == sorted([(0, len(texts[3].encode()))] * 2 + [(len(texts[4].encode()),) * 2])


def test_rows_under_one_id_are_told_apart(spark):
    rng = np.random.default_rng(5)
    one, two, three = ("".join(rng.choice(list("abcdefgh"), 200)) for _ in range(3))
    rows = [(1, one + two[:100]), (1, three), (2, two), (None, three[:120] + one[:20]), (None, "z" + two[150:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.id, r.n_bytes): r.kept_text for r in suffix_dedup.remove_repeats(docs, 40).collect()}
    assert found == {(1, 300): one, (1, 200): three[120:], (2, 200): two[100:150], (None, 140): one[:20], (None, 51): "z"}


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    raws, want = brute(texts, 400)
    rows = queries.op2_suffix_dedup(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, spans = want[r.doc_id]
        kept, at = b"", 0
        for a, b in spans:
            kept += raws[r.doc_id][at:a]
            at = b
        kept += raws[r.doc_id][at:]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def test_passages_beside_longer_strings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 3000)
    monkeypatch.setattr(suffix_dedup, "BATCH", 2000)
    for seed, spread in ((4, 2000), (5, 2)):
        monkeypatch.setattr(suffix_dedup, "SPREAD", spread)
        texts = corpus(seed)
        docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, passages int")
        rows = suffix_dedup.remove_repeats(docs, 40, passage=24).collect()
        check(rows, texts, 40)
        passages = brute(texts, 24)[1]
        assert {r.id: [(s.first, s.after) for s in r.passages] for r in rows} == {k: spans for k, (_, spans) in passages.items()}
        assert any(not r.spans and r.passages for r in rows)
    assert suffix_dedup.remove_repeats(docs.limit(0), 40, passage=24).count() == 0
    twice = docs.where("doc_id = 3")
    again = suffix_dedup.remove_repeats(twice.unionAll(twice), 40, passage=24).collect()
    assert [[(s.first, s.after) for s in r.passages] for r in again] == [[(0, len(texts[3].encode()))]] * 2 and {bytes(r.kept) for r in again} == {b""}


def test_passages_of_over_fifty_words_are_found_below_the_length(spark, tmp_path):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9))))
    prose = lambda n: [word() for _ in range(n)]
    shared = [prose(int(n)) for n in rng.integers(51, 61, 6)]
    sizes = [len(" ".join(p).encode()) for p in shared]
    assert 240 < min(sizes) < 400
    rows = [(i, " ".join([*prose(80), *shared[i % 6], *prose(80)])) for i in range(12)] + [(i, " ".join(prose(200))) for i in range(12, 24)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op2_suffix_dedup(spark, str(tmp_path)).collect():
        if r.doc_id < 12:  # the spaces around are shared too, and whatever letters follow by chance
            n = sizes[r.doc_id % 6]
            assert r.n_passages == 1 and n + 2 <= r.n_passage_bytes < n + 12
            assert r.n_removed == (r.n_passage_bytes if r.n_passage_bytes >= 400 else 0)
        else:
            assert (r.n_passages, r.n_passage_bytes, r.n_removed) == (0, 0, 0)


def test_passages_of_the_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {k: (len(spans), sum(b - a for a, b in spans)) for k, (_, spans) in brute(texts, 240)[1].items()}
    assert {r.doc_id: (r.n_passages, r.n_passage_bytes) for r in queries.op2_suffix_dedup(spark, sf).collect()} == want
