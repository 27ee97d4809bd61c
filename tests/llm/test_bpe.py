import hashlib

import pytest
from barspark.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")

ODD = [
    "", " ", "Hello  WORLD's it'll 123 ½ ²", "ΣΑΣ Σ İstanbul ẞ ŉ", "<|endoftext|>a<|startoftext|> b <|endoftext|", "é é ẛ̣",
    "日本語テキスト 😀👩‍👩‍👧 \x1c\x85  x", "a" * 700, "ab" * 3000, "!?!?!?'s'S'tt\n\n\tx", "\u0000​zero", "don't WE'VE I'D", "٣٤٥ Ⅷ ೬",
]


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_file())


def test_odd_texts(reference):
    own = bpe.opened(queries.tokenizer_file())
    for text in ODD:
        want = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.decode(want) == reference.decode(want, skip_special_tokens=False)


def test_whole_table(spark, sf, reference):
    rows = {r.doc_id: r for r in queries.op9_bpe_automaton(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = reference.encode(d.text or "", add_special_tokens=False).ids
        got = rows[d.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_null_empty_repeated_and_no_rows(spark):
    schema = "doc_id long, text string, ids string, decoded int"
    docs = spark.createDataFrame([(1, None, "x", 1), (1, None, "x", 1), (None, "a", "y", 2), (2, "", None, None)], schema)
    got = sorted((r.id or 0, list(r.ids), r.decoded) for r in bpe.encode_decode(docs, queries.tokenizer_file()).collect())
    assert [g[0] for g in got] == [0, 1, 1, 2] and got[1][1:] == ([], "") and len(got[0][1]) == 1
    assert bpe.encode_decode(docs.limit(0), queries.tokenizer_file()).count() == 0
