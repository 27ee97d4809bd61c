import hashlib
import os
import random
import re

import duckdb
from barspark.llm import middle, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_every_cut_of_random_texts():
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice(["a", "bé", "日", "😀", " ", "\n", "\t ", " ", "\x0b"]) for _ in range(rng.randrange(0, 90)))
        units = UNIT.findall(text)
        for block in (1, 2, 7, 64):
            tree = middle.UnitTree(text, block)
            assert tree.units == len(units)
            assert [tree.end_of(u) for u in range(len(units) + 1)] == [len("".join(units[:u])) for u in range(len(units) + 1)]


def test_edges(spark):
    texts = [None, "", " ", "\n\t", "one", " one ", "a <P> b", "x<S", "<", "é😀 日本  z", "w " * 200_000, "no-space" * 50_000, "<P", "a\x00b c"]
    rows = [(i, t, "x", 1) for t in texts for i in range(40)] + [(None, "a b c", "y", 2), (5, "one", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    made = middle.rearrange(docs)
    got = made.withColumn("again", middle.restored(made.output, made.form)).collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, ((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got))) == sorted(
        map(repr, ((i, *brute(i, t), t or "") for i, t, *_ in rows))
    )
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.rearrange(docs.limit(0)).count() == 0


def test_whole_table_and_its_sql(spark, sf):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(tuple(r) for r in queries.op13_middle(spark, sf).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((d.doc_id, *brute(d.doc_id, d.text)[:4], sha(brute(d.doc_id, d.text)[4]), sha(d.text or "")) for d in docs)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{os.path.join(sf, 'documents.parquet')}'")
    assert got == sorted(con.execute(queries.OP13_SQL).fetchall())
