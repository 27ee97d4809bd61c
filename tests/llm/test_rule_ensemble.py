import numpy as np
from barspark.llm import queries
from barspark.llm import rule_ensemble as re_
from pyspark.sql import functions as F


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_auc(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op7_rule_ensemble(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    score, y = np.array([got[r.doc_id].score for r in labels]), np.array([r.quality for r in labels])
    assert auc(score, y) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_fit_finds_a_conjunction_and_compiles_it(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(re_.NAMES)))
    y = ((x[:, 1] > 0.5) & (x[:, 3] <= 0.4)).astype(float)
    rules = re_.fit(x, y)
    assert 0 < len(rules.terms) < 60
    frame = spark.createDataFrame(x.tolist(), list(re_.NAMES)).withColumn("s", re_.score(rules)).select("s").toPandas()["s"].to_numpy()
    assert np.mean((frame > 0.5) == (y == 1)) > 0.97
    for weight, path in rules.terms:
        assert weight and path


def test_query_scores_as_the_rules_do(spark):
    """The compiled expression against the rules evaluated on the statistics, over documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rules = re_.learn(docs, labels, F.lit(True))
    frame = re_.described(docs).withColumn("score", re_.score(rules)).toPandas()
    assert rules.terms and np.allclose(frame["score"], re_.score_of(rules, frame[list(re_.NAMES)].to_numpy(float)), atol=1e-12)


def test_clashing_names_and_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 30, f"text {i} " * (i % 7 + 1), 1.0, "a", "b") for i in range(90)], "doc_id long, text string, y double, id string, `m.k` string")
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(30)], "doc_id long, quality int, text string")
    rules = re_.learn(docs, labels, F.lit(True), re_.Fit(rows=10))
    assert re_.described(docs).withColumn("score", re_.score(rules)).count() == 90


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (3, "a " * 60000), (None, "x"), (3, "a " * 60000)]
    docs = spark.createDataFrame([(*r, 1, "w", 0.1) for r in rows], "doc_id long, text string, words int, w string, score double")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, None), (9, 1)], "doc_id long, quality int")
    rules = re_.learn(docs, labels, F.lit(True))
    got = re_.described(docs).withColumn("score", re_.score(rules)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert re_.learn(docs, labels.limit(0), F.lit(True)) == re_.Rules(0.0, ())
    assert re_.described(docs.limit(0)).count() == 0
