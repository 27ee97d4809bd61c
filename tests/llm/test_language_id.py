import numpy as np
from barspark.llm import language_id as li
from barspark.llm import queries
from pyspark.sql import functions as F


def parsed(text, sample):
    """Longest matches one after the other, by search."""
    at, n = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        at, n = end, n + 1
    return n


def test_whole_predictions_against_search(monkeypatch):
    monkeypatch.setattr(li, "STRETCH", 50)
    rng = np.random.default_rng(1)
    samples = {k: li.plain(" ".join("".join(rng.choice(list(letters), int(rng.integers(1, 9)))) for _ in range(200))) for k, letters in (("a", "abcd"), ("b", "abcdé"), ("c", "cdef語"))}
    texts = [" ".join("".join(rng.choice(list("abcdefé語x"), int(rng.integers(1, 7)))) for _ in range(int(rng.integers(0, 60)))) for _ in range(80)]
    texts += [samples["b"][20:200], samples["c"][7:400], None, "", "1 2"]
    judge = li.Judge(samples)
    costs = judge.costs([li.plain(t) for t in texts])
    langs, scores = judge.judge(texts)
    for t, cost, lang, score in zip(texts, costs, langs, scores, strict=True):
        flat = li.plain(t)
        want = [sum(parsed(flat[i : i + 50], samples[k]) for i in range(0, len(flat), 50)) * np.log2(len(samples[k])) for k in "abc"]
        assert np.allclose(cost, want)
        assert lang == ("abc"[int(np.argmin(want))] if flat else "und") and (1 / 3 - 1e-9 <= score <= 1 if flat else score == 0)
    assert langs[80:82] == ["b", "c"]


def test_phrases_run_across_words():
    judge = li.Judge({"a": " the end of the road ", "b": " end the of road the "})
    (a, b), *_ = judge.costs([" the end of the road "])
    assert a < b


def test_a_language_of_little_text_takes_nothing_from_others(spark):
    rng = np.random.default_rng(3)
    long = [(i, " ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(300)), "en") for i in range(20)]
    docs = spark.createDataFrame([*long, (90, "tres palabras solas", "es")], "doc_id long, text string, lang string")
    both = li.learn(docs, F.lit(True), li.Sample(letters=5000))
    assert both["es"] == " tres palabras solas " and 5000 <= len(both["en"]) < 5300
    assert both["en"] == li.learn(docs.where("lang = 'en'"), F.lit(True), li.Sample(letters=5000))["en"]
    begins = [t[:200] for _, t, _ in long]  # passages come from everywhere in a text
    assert sum(b in both["en"] for b in begins) < 10


def test_held_out_accuracy(spark, sf):
    got = {r.doc_id: r for r in queries.op1_cross_parsing(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [(got[d.doc_id].lang_pred, d.lang) for d in docs if got[d.doc_id].held_out]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_texts_without_letters_and_no_labels(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 %% 3 ²", None), (4, "the end " * 20000, "en"), (4, "the end " * 20000, "en"), (None, "und so weiter", "de")]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, lang string, score double, id int")
    texts = {"en": " the end of this and that ", "de": " und so weiter der die das "}
    got = sorted(((r.id or 0, r.lang) for r in li.predict(docs, texts).collect()))
    assert got == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert li.learn(docs.limit(0), F.lit(True)) == {}
    assert {r.lang for r in li.predict(docs, {}).collect()} == {"und"}
    assert set(li.learn(docs, F.lit(True))) == {"en"}


def test_more_languages_than_a_table_holds(spark):
    rng = np.random.default_rng(6)
    words = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 8)))) for _ in range(60)] for k in range(300)}
    texts = {k: li.plain(" ".join(rng.choice(w, 150))) for k, w in words.items()}
    rows = [(i, " ".join(rng.choice(words[k], 12)), k) for i, k in enumerate(list(words) * 2)]
    rows += [(9000, None, "und"), (9001, " 1 ", "und"), (9002, rows[0][1], rows[0][2]), (9002, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert len(li.tables_of(texts, 20_000)) > 5 and sum(map(len, li.tables_of(texts, 20_000))) == 300
    many = sorted((r.id, r.lang, r.score) for r in li.predict(docs, texts, letters=20_000).collect())
    one = sorted((r.id, r.lang, r.score) for r in li.predict(docs, texts).collect())
    assert [m[:2] for m in many] == [o[:2] for o in one] and np.allclose([m[2] for m in many], [o[2] for o in one])
    assert len(many) == len(rows) and np.mean([m[1] == w for m, (_, _, w) in zip(many, sorted(rows), strict=True)]) > 0.97


def test_a_script_of_many_characters():
    chars = [chr(c) for c in range(0x3400, 0x3400 + 60_000) if chr(c).isalpha()][:50_000]
    sample = " ".join("".join(chars[i : i + 20]) for i in range(0, len(chars), 20))
    judge = li.Judge({"h": li.plain(sample), "l": " latin text here "})
    assert len(chars) > 32_767 and judge.judge(["".join(chars[40_000:40_030]), "text"])[0] == ["h", "l"]
