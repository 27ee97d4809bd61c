"""A corpus made ready for training: line rules, near duplicates, repeated passages, source mix, token ids.

Every stage takes the rows that the one before it left and returns their columns, the last one token ids. A row without
doc_id is known by a hash of its text and source instead. Stages neither fail on nor drop clean rows that have nulls in
other columns, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm import bpe, line_rules, mixing, simhash, suffix_dedup
from barspark.llm.common import row_of, stored
from barspark.llm.queries import tokenizer_file

#: Any number of words, and up to half of them in repeated windows, where the query's own limits are 10 words and a fifth.
RULES = line_rules.LineRules(min_words=1, repeats=50)
#: Bytes of a repeated passage: about forty words of usual length. Fifty words are longer but where they average under 3.8 bytes.
PASSAGE = 240


def _key(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"], docs["source"]))


def _packed(docs: DataFrame) -> DataFrame:
    """The key, the text and the whole row as one column, whatever its columns are called."""
    return docs.select(_key(docs).alias("id"), docs["text"].alias("text"), docs["source"].alias("source"), row_of(docs).alias("row"))


def _unpacked(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs``, with another text and its length if given."""
    new = {} if text is None else {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    fields = rows.select("*", *[F.col("row").getField(c).alias(f"field{i}") for i, c in enumerate(docs.columns)])
    return fields.select(*[new.get(c, F.col(f"field{i}")).alias(c) for i, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; documents that fail go. Short texts and texts with a repeated line are clean here."""
    judged = line_rules.clean(docs, RULES, carry=True).where("kept")
    return _unpacked(judged, docs, F.col("cleaned"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents whose sets of five-word shingles are alike by 0.8 or more, through others too, the smallest id stays;
    fingerprints find the groups and the sets themselves decide in them. Of rows that have one key and one text, one. Rows of one key with different texts stay together or go together."""
    rows = _packed(docs)
    found = simhash.alike(rows, 0.8, simhash.for_similarity(0.8, words=5, prints=12, spread=3), id_col="id")
    stay = found.where(F.col("id") == F.col("component")).select("id").distinct()
    kept = rows.join(stay, "id", "left_semi").withColumn("h", F.xxhash64("text"))
    return _unpacked(kept.dropDuplicates(["id", "h"]), docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes that come again, in any document, go wherever they are; a character cut in two goes. A null text
    stays null; rows without an id are known by text and source, so that rows that repeat lose what they share with each other."""
    done = suffix_dedup.remove_repeats(_packed(docs), PASSAGE, id_col="id", carry="row")
    return _unpacked(done, docs, F.when(F.size("spans") > 0, F.col("kept_text")).otherwise(F.col("row.text")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight has it: not at all, or up to three times. A null text has size 0 and
    comes at most as often as the mix says; null sources are one source. Rows of one id, source and size share what the mix gives
    them: each as often as all can, what remains by the order of a digest of the row. Rows that repeat whole are one row with
    their number until then, so that none of these groups meets in one task, however many rows share a key."""
    group = ["id", "skey", "size"]
    by_source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("skey")
    packed = _packed(docs)
    digest = F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256).alias("digest")
    rows = packed.select("id", by_source, mixing.size_of(F.col("text")).alias("size"), digest, "row")
    mixed = mixing.mix(packed, id_col="id").groupBy("id", by_source, "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    # of n rows of a key, all come whole times, and the first more of them once more
    shares = mixed.where("copies > 0").select(*group, F.expr("copies div n").alias("whole"), F.expr("copies % n").alias("more"))
    # how many rows of the key are before a row: within the digest's part, and in the parts before it
    part = F.substring("digest", 1, 4).alias("part")
    each = rows.groupBy(*group, "digest").agg(F.count("*").alias("m")).select("*", part)
    until = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy(*group, "part").agg(F.sum("m").alias("m"))
    parts = parts.select(*group, "part", F.coalesce(F.sum("m").over(until.partitionBy(*group).orderBy("part")), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("m").over(until.partitionBy(*group, "part").orderBy("digest")), F.lit(0))
    placed = each.select("*", within.alias("within")).join(parts, [*group, "part"]).join(shares, group)
    before = F.col("within") + F.col("earlier")
    times = F.col("whole") * F.col("m") + F.greatest(F.lit(0), F.least("m", F.col("more") - before))
    picked = placed.select(*group, "digest", times.alias("times")).where("times > 0")
    out = rows.dropDuplicates([*group, "digest"]).join(picked, [*group, "digest"])
    return _unpacked(out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document of the mix. A null text has no ids and an empty decoded text; a
    null doc_id stays null."""
    coded = bpe.encode_decode(docs, tokenizer_file())
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The stages aren't SQL: they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
