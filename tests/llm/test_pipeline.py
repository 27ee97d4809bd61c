from collections import Counter

import corpus_pipeline
import numpy as np
from barspark.llm import mixing, simhash
from tests.llm.test_mixing import expected_targets, words

from barspark.llm import bpe, queries


def prose(rng, n):
    return ". ".join(" ".join("".join(rng.choice(list("abcdefghijklm"), int(rng.integers(2, 9)))) for _ in range(10)) for _ in range(n)) + "."


def corpus():
    rng = np.random.default_rng(11)
    rows = [(i, prose(rng, int(rng.integers(4, 20))), "en", f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s1") for i in range(10)]  # exact copies
    rows += [(300 + i, rows[20 + i][1].replace(" ", " x ", 1), None, "s2") for i in range(10)]  # near copies
    passage = prose(rng, 6)
    rows += [(400 + i, prose(rng, 8) + " " + passage + " " + prose(rng, 8), "en", None) for i in range(6)]
    rows += [(500, None, "en", "s0"), (501, "", None, None), (502, "SHOUT!! " * 40, "en", "s0"), (503, rows[119][1] + "\nHome | About | News | More", "en", "s3")]
    rows += [(None, prose(rng, 9), "en", "s0"), (None, prose(rng, 9), "en", "s0")]
    return [(*r, len(r[1] or ""), "x", 7) for r in rows], passage


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int"


def test_stages_one_by_one(spark):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    clean = corpus_pipeline.quality_rules(spark, docs, "").cache()
    assert clean.columns == docs.columns
    kept = {r.doc_id: r for r in clean.collect()}
    assert set(kept) == {r[0] for r in rows} - {500, 501, 502}
    assert kept[503].text == rows[119][1] and kept[503].n_chars == len(kept[503].text) and kept[503].size == 7

    single = corpus_pipeline.near_dedup(spark, clean, "").cache()
    ids = [r.doc_id for r in single.collect()]
    assert single.columns == docs.columns and len(ids) == len(set(ids)) + 1  # two rows have no id
    gone = set(kept) - set(ids)
    assert gone == {200 + i for i in range(10)} | {300 + i for i in range(10)} | {503}

    unique = corpus_pipeline.passage_dedup(spark, single, "").cache()
    texts = {r.doc_id: r.text for r in unique.collect()}
    assert unique.count() == single.count() and not any(passage[5:-5] in t for t in texts.values())
    before = {r.doc_id: r.text for r in single.collect()}
    assert all(texts[d] == before[d] for d in texts if d is None or d < 400)

    mixed = corpus_pipeline.source_mix(spark, unique, "").cache()
    sizes, taken = {}, {}
    for r in unique.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    for s, t in expected_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= max(words(r.text) for r in unique.collect() if r.source == s)

    coded = corpus_pipeline.token_ids(spark, mixed, "").collect()
    tokenizer = bpe.opened(queries.tokenizer_file())
    want = sorted((r.doc_id or -1, tokenizer.encode(r.text or "")) for r in mixed.collect())
    assert sorted((r.doc_id or -1, list(r.ids)) for r in coded) == want


def test_rows_that_repeat(spark):
    text = prose(np.random.default_rng(5), 12)
    rows = [(1, text, "en", "s0", 9, "x", 7)] * 3 + [(None, text + " More words stand here.", "en", "s0", 9, "x", 7)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    single = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert len(single) == 1 and single[0].text.startswith(text)
    unique = corpus_pipeline.passage_dedup(spark, spark.createDataFrame(single, SCHEMA), "").collect()
    assert [r.text for r in unique] == [single[0].text]


def test_rows_of_one_key_share_what_the_mix_gives(spark):
    rng = np.random.default_rng(4)
    rows = [(7, f"{prose(rng, 1)[:-1]} w", "en", "s0", 9, "x", i % 2) for i in range(60)] + [(7, "one two three", "en", "s0", 9, "x", 7)] * 40
    rows += [(7, "one two three", "en", "s0", 9, "y", 7), (7, None, "en", "s0", 0, "x", 7)] + [(i, prose(rng, 2), "en", "s1", 9, "x", 7) for i in range(30)]
    rows += [(8, "one two three four", None, "s2", 9, "x", 7)] * 50
    results = []
    for n in (1, 7):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(n)
        given = Counter()
        for r in mixing.mix(docs, id_col="doc_id").collect():
            given[r.id, r.source, r.size] += r.copies
        out = corpus_pipeline.source_mix(spark, docs, "").collect()
        assert Counter((r.doc_id, r.source, words(r.text)) for r in out) == +given
        times, there = Counter(tuple(r) for r in out), Counter(tuple(r) for r in docs.collect())
        assert set(times) <= set(there) and all(k <= 3 * there[r] for r, k in times.items())
        by_key = {}
        for r, m in there.items():
            by_key.setdefault((r[0], r[3], words(r[1])), []).append((times[r], m))
        for key, found in by_key.items():  # none has two more than another
            whole = given[key] // sum(m for _, m in found)
            assert all(whole * m <= k <= (whole + 1) * m for k, m in found)
        results.append(times)
    assert results[0] == results[1]


def test_columns_of_any_name_stay(spark):
    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, 6), "en", "s0", 9, "x", 7) for i in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA.replace("id string, size int", "`m.k` string, `a``b` int"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[-2:] == ["m.k", "a`b"] and {(r["m.k"], r["a`b"]) for r in docs.collect()} == {("x", 7)}
    assert corpus_pipeline.token_ids(spark, docs, "").count() == docs.count()


def test_a_mention_in_a_long_line_is_clean(spark):
    rng = np.random.default_rng(6)
    long, more = prose(rng, 8), prose(rng, 8)
    mentions = [f"{long} Whoever holds the copyright reads the privacy policy. {more}", f"{long} a > b | c > d {more}"]
    boilerplate = ["Copyright 2020 by the firm. All rights reserved.", "Home | About | News | More", " ".join(f"{w} copyright" for w in more.split()[:15]), " ".join(f"{w} |" for w in more.split()[:30])]
    texts = mentions + [f"{long}\n{b}" for b in boilerplate]
    docs = spark.createDataFrame([(n, t, "en", "s0", 9, "x", 7) for n, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert got == dict(enumerate([*mentions, long, long, long, long]))


def test_a_line_many_times_makes_no_near_copy(spark):
    texts = [" ".join(f"d{n}w{i}" for i in range(500)) + " one line of ten words that both have many times" * 50 for n in range(2)]
    docs = spark.createDataFrame([(n, t, "en", "s0", 9, "x", 7) for n, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {0, 1}


def test_empty_table_and_run(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 50 and out.where("n_tokens < 1").count() < 5
    assert corpus_pipeline.STAGES[1][1] is corpus_pipeline.near_dedup and simhash.for_similarity().words == 5
