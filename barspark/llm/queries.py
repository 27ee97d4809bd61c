"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import (
    bpe, language_id, license_scan, line_rules, middle, mixing, multi_index, part_codes, quotation, rule_ensemble, simhash, suffix_dedup, url_rules,
)
from .common import table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file's place: the folder in BARSPARK_TOKENIZERS, else that of the installed package."""
    if folder := os.environ.get("BARSPARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file())
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS gram FROM grams),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
judged AS (
  SELECT doc_id, l, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS c,
    NOT (len(regexp_extract_all(l, '[#*$%&|<>!?~^=_{}\\]')) * 100
           > length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) * 10
      OR (len(regexp_extract_all(l, '[|>]')) >= 3 AND len(regexp_extract_all(l, '[|>]')) * 10 >= len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')))
      OR regexp_matches(l, '{navigation}')
      OR len(regexp_extract_all(l, '{boilerplate}')) * 25
           >= greatest(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')), 1)
    ) AS ok
  FROM lines),
by_doc AS (
  SELECT doc_id, sum(c) AS chars, sum(CASE WHEN ok THEN c ELSE 0 END) AS left_chars,
    count(CASE WHEN c > 0 THEN 1 END) - count(DISTINCT CASE WHEN c > 0 THEN l END) AS dup
  FROM judged GROUP BY 1),
f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(left_chars, 0) AS left_chars
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN by_doc USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (word_chars - left_chars) * 100 <= word_chars * 50 AS kept
FROM f
"""
for _name, _pattern in (("{navigation}", line_rules.NAVIGATION), ("{boilerplate}", line_rules.BOILERPLATE)):
    OP10_SQL = OP10_SQL.replace(_name, _pattern.replace("'", "''"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.hex("print")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE)
    covered = F.aggregate("passages", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return done.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.col("kept_text").alias("text"),
        F.size("passages").cast("long").alias("n_passages"),
        covered.alias("n_passage_bytes"),
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


OP3_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0) AS h0, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM b),
d AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%%.example.net') AND path LIKE '/en/%%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%%.example.com') AND path LIKE '/de/%%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%%.org') AND path LIKE '/fr/%%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%%.net') AND path LIKE '/%%' THEN 'net/' END AS rule
  FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|[^A-Za-z0-9])(%s)([^A-Za-z0-9]|$)') OR regexp_matches(host || path, '(^|[./])(%s)([./]|$)')
      OR regexp_matches(host || path, '(?s)(^|[./])(page([./]|$).*(^|[./])page|tag([./]|$).*(^|[./])tag|category([./]|$).*(^|[./])category|calendar([./]|$).*(^|[./])calendar|search([./]|$).*(^|[./])search|wp-json|index\.php([./]|$)index\.php)([./]|$)')
      OR regexp_matches(host || path, ';jsessionid=|(^|[./])sid=') OR regexp_matches(host || path, '(^|[./])(feed/?|rss|print/?|trackback/?|amp/?|xmlrpc\.php)\z')
      OR regexp_matches(host || path, '\.(pdf|tar\.gz|mp3|apk|iso|webm)\z') OR regexp_matches(host, '(?s)^(ad\.|(ads|adserv|track|click|pixel).*\.)')
      OR regexp_matches(host, '(?s)^([^/]*\.)?(banner|affiliate).*\.') THEN 'block'
    ELSE 'allow' END AS verdict
FROM d
""" % ("|".join(url_rules.HOST_WORDS), "|".join(url_rules.SEGMENTS))


def _shown(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), "depth", "n_quoted", "body", "formatted"
    )


def op5_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(quotation.conversations(table(spark, sf_dir, "conversations")))


_OP5 = r"""m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM src),
l0 AS (SELECT rid, conv_id, turn, unnest(range(len(s))) AS i, unnest(s) AS raw FROM (SELECT *, string_split(text, chr(10)) AS s FROM m)),
l1 AS (
  SELECT *, len(regexp_extract_all(regexp_extract(raw, '^(?:[ \t]*>)+', 0), '>')) AS level,
    regexp_replace(regexp_replace(translate(regexp_replace(raw, '^(?:[ \t]*>)+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS line
  FROM l0),
lw AS (
  SELECT *, coalesce(level = lead(level) OVER w AND regexp_matches(line || chr(10) || lead(line) OVER w,
    '^(?:on|am|le|el) [^\n]*[0-9,](?:[^\n]*[^.!?:;\n])?\n(?:[^\n]* )?(?:wrote|schrieb[^\n]*|a écrit|escribió) ?:$'), false) AS wrapped FROM l1 WINDOW w AS (PARTITION BY rid ORDER BY i)),
l2 AS (
  SELECT *, NOT (coalesce(lead(level) OVER w > level, false) AND (coalesce(lag(wrapped) OVER w, false) OR regexp_matches(line,
    '^(?:on|am|le|el) .*(?:wrote|schrieb.*|a écrit|escribió) ?:$|^[^:]* (?:wrote|writes|schrieb|a écrit|escribió) ?:$'))
    OR coalesce(lead(level, 2) OVER w > level, false) AND wrapped) AS own FROM lw WINDOW w AS (PARTITION BY rid ORDER BY i)),
l AS (SELECT *, own AND line <> '' AS counts FROM l2),
l3 AS (SELECT *, counts AND NOT coalesce(lag(counts) OVER w AND lag(level) OVER w = level, false) AS begins FROM l WINDOW w AS (PARTITION BY rid ORDER BY i)),
l4 AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY rid ORDER BY i) AS run FROM l3),
u AS (
  SELECT DISTINCT conv_id, turn, level, text FROM (
    SELECT conv_id, turn, level, line AS text, 12 AS least FROM l WHERE counts
    UNION ALL SELECT conv_id, turn, min(level), string_agg(line, ' ' ORDER BY i), 12 FROM l4 WHERE counts GROUP BY rid, conv_id, turn, run
    UNION ALL SELECT conv_id, turn, level, string_agg(line, ' ' ORDER BY i), 0 FROM l WHERE counts AND level < 2 GROUP BY rid, conv_id, turn, level)
  WHERE length(text) >= least AND conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT conv_id, text, min(turn) AS parent FROM u WHERE level = 0 GROUP BY ALL),
q AS (SELECT u.conv_id, u.turn, level, parent, sum(length(u.text)) AS chars FROM u JOIN f ON f.conv_id = u.conv_id AND f.text = u.text WHERE level > 0 AND parent < turn GROUP BY ALL),
p AS (SELECT conv_id, turn, parent FROM q QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, parent DESC) = 1),
r AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM p
  UNION ALL SELECT r.conv_id, r.turn, p.parent, r.depth + 1 FROM r JOIN p ON p.conv_id = r.conv_id AND p.turn = r.root),
deep AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM r GROUP BY ALL),
c AS (
  SELECT m.rid, m.conv_id, m.turn, role, count(*) FILTER (level > 0) AS n_quoted,
    regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (own AND level = 0), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body
  FROM m JOIN l2 ON l2.rid = m.rid GROUP BY ALL)
SELECT c.conv_id, c.turn, role, p.parent AS parent_turn, coalesce(deep.root, c.turn) AS root_turn, coalesce(deep.depth, 0)::BIGINT AS depth, n_quoted, body,
  '<|' || coalesce(role, '') || '|>' || chr(10) || body || chr(10) AS formatted
FROM c LEFT JOIN p ON p.conv_id = c.conv_id AND p.turn = c.turn LEFT JOIN deep ON deep.conv_id = c.conv_id AND deep.turn = c.turn
"""
OP5_SQL = "WITH RECURSIVE src AS (SELECT * FROM conversations), " + _OP5


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of messages that quote: each turn begins with an attribution, every fifth one over two lines, and what the one
    before says, every third of them with what that quotes in turn."""
    said = table(spark, sf_dir, "conversations").where("text is not null and conv_id is not null and turn is not null")
    one = said.groupBy("conv_id", "turn").agg(F.min(F.struct("text", "role")).alias("v")).select("conv_id", "turn", "v.role", "v.text")
    by = Window.partitionBy("conv_id").orderBy("turn")
    marked = lambda c, mark: F.concat(F.lit(mark), F.replace(c, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    before, older = F.lag("text").over(by), F.lag("text", 2).over(by)
    told = F.when(F.col("turn") % 5 == 4, "On Monday, 6 May,\nu wrote:\n").otherwise("On Monday u wrote:\n")
    quote = F.concat(told, F.when(F.col("turn") % 3 == 2, F.coalesce(marked(older, ">> "), F.lit(""))).otherwise(""), marked(before, "> "))
    return _shown(quotation.conversations(one.select("conv_id", "turn", "role", F.concat(F.coalesce(quote, F.lit("")), "text").alias("text"))))


QUOTED_REPLIES_SQL = r"""WITH RECURSIVE one AS (SELECT conv_id, turn, min({'text': text, 'role': role}) AS v FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
src AS (SELECT conv_id, turn, v.role AS role, coalesce(CASE WHEN turn % 5 = 4 THEN 'On Monday, 6 May,' || chr(10) || 'u wrote:' ELSE 'On Monday u wrote:' END || chr(10) || CASE WHEN turn % 3 = 2 THEN coalesce('>> ' || replace(lag(v.text, 2) OVER w, chr(10), chr(10) || '>> ') || chr(10), '') ELSE '' END
    || '> ' || replace(lag(v.text) OVER w, chr(10), chr(10) || '> ') || chr(10), '') || v.text AS text
  FROM one WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), """ + _OP5


def _fold(name: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; that of the empty text for a null id."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = language_id.learn(docs, _fold("doc_id", 4) != 2)
    return language_id.predict(docs, texts).select(
        F.col("id").alias("doc_id"), (_fold("id", 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score"
    )


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = rule_ensemble.learn(docs, table(spark, sf_dir, "labels"), _fold("doc_id", 5) != 0)
    scored = rule_ensemble.described(docs).withColumn("score", rule_ensemble.score(rules))
    return scored.select(
        F.col("id").alias("doc_id"), (_fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base, names = F.filter("places", lambda x: x["kind"] == "base"), lambda xs: F.array_join(F.array_sort(F.array_distinct(xs["label"])), ",")
    starts = F.col("base")["word"]
    return found.withColumn("base", base).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(F.col("base")).alias("base_labels"),
        names(F.col("places")).alias("labels"),
        (F.coalesce(F.array_max(F.col("places")["level"]), F.lit(0)) / 100).alias("score"),
    )


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = part_codes.encode(table(spark, sf_dir, "embeddings"))
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return part_codes.with_label_errors(coded.rows).select(
        F.col("id").alias("vec_id"), F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256")
    )


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.rearrange(table(spark, sf_dir, "documents"))
    again = middle.restored(F.col("output"), F.col("form"))
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""


QUERIES = {
    "op1_cross_parsing": op1_cross_parsing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_rules": op3_url_rules,
    "op4_mixing": op4_mixing,
    "op5_quotation": op5_quotation,
    "quoted_replies": quoted_replies,
    "op6_simhash": op6_simhash,
    "op7_rule_ensemble": op7_rule_ensemble,
    "op8_multi_index": op8_multi_index,
    "op9_bpe_automaton": op9_bpe_automaton,
    "op10_quality_rules": op10_quality_rules,
    "op11_license_scan": op11_license_scan,
    "op12_part_codes": op12_part_codes,
    "op13_middle": op13_middle,
}
#: The others can't be told in SQL; tests hold them against brute force, exact round trips or held-out labels.
ORACLE_SQL = {"op3_url_rules": OP3_SQL, "op5_quotation": OP5_SQL, "quoted_replies": QUOTED_REPLIES_SQL, "op10_quality_rules": OP10_SQL, "op13_middle": OP13_SQL}
