"""Language by cross-parsing: texts are cut into the longest phrases that a language's labelled text holds.

Every language has a suffix automaton over its labelled sample. A text is parsed from left to right: the automaton follows
it as far as it can, that is a phrase, and begins anew. Few phrases mean a near language; a phrase is a pointer into the
sample, so its number is normalised to bits by the sample's size. Texts are parsed as words with one blank between them, so
phrases run across words; those of one batch are parsed side by side, a character of each at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W\d_]+")
NONE = "und"
#: Characters of a stretch of text (a phrase ends where a longer text is cut), and of the texts that are parsed side by side.
STRETCH, BATCH = 2048, 1 << 22


@dataclass(frozen=True)
class Sample:
    """Bounds of the labelled text that is learnt from: documents of a language, and characters of their passages of
    ``words`` words. What is taken of a language doesn't depend on any other."""

    docs: int = 120
    words: int = 40
    letters: int = 80_000


def plain(text: str | None) -> str:
    """Words in lower case with one blank around each; empty without a letter."""
    words = [w for w in WORDS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]
    return f" {' '.join(words)} " if words else ""


def automaton(text: str) -> list[dict[str, int]]:
    """The suffix automaton of a text: the transitions of each state by character; the first state is the start."""
    moves: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


#: Bits of a character's number and of a state's in an entry of the table of transitions.
CHAR, STATE = 16, 23
#: Letters of the samples that one table holds: languages beyond go to further tables, each of which judges all texts.
LETTERS = 2_000_000


class Judge:
    """The automata of all languages, their transitions in one hash table of (state, character)."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.bits = np.log2([max(2, len(texts[x])) for x in self.languages])
        letters = sorted({c for t in texts.values() for c in t})
        self.number = np.zeros(0x110000, np.int64)  # characters by number; 0 is one that no sample has
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.start = np.zeros((len(letters) + 1, len(self.languages)), np.int64)
        keys, to, states = [], [], 0
        for k, x in enumerate(self.languages):
            moves = automaton(texts[x])
            size = [len(m) for m in moves]
            chars = self.number[[ord(c) for m in moves for c in m]]
            to.append(np.array([t for m in moves for t in m.values()], np.int64) + states)
            keys.append(np.repeat(np.arange(len(moves)) + states, size) << CHAR | chars)
            self.start[chars[: size[0]], k] = to[-1][: size[0]]
            states += len(moves)
        if states >= 1 << STATE or len(letters) >= 1 << CHAR:
            raise ValueError("a sample is too long, or has too many different characters, for a table of transitions")
        key, to = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *to])
        self.shift = np.uint64(64 - max(4, (2 * len(key)).bit_length()))
        self.table = np.full(1 << 64 - int(self.shift), -1, np.int64)
        at = self._slot(key)
        while len(key):  # one entry a slot; the others try the next one
            _, first = np.unique(at, return_index=True)
            won = np.zeros(len(key), bool)
            won[first] = self.table[at[first]] < 0
            self.table[at[won]] = key[won] << STATE | to[won]
            key, to, at = key[~won], to[~won], at[~won] + 1 & len(self.table) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _moved(self, key: np.ndarray) -> np.ndarray:
        """Where a state goes by a character; 0 without a transition."""
        at = self._slot(key)
        entry = self.table[at]
        same = entry >> STATE == key
        out = np.where(same, entry & (1 << STATE) - 1, 0)
        left = np.flatnonzero(~same & (entry >= 0))
        while len(left):
            at[left] = at[left] + 1 & len(self.table) - 1
            entry = self.table[at[left]]
            same = entry >> STATE == key[left]
            out[left[same]] = entry[same] & (1 << STATE) - 1
            left = left[~same & (entry >= 0)]
        return out

    def phrases(self, chars: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many longest matches, one after the other, each stretch takes in each language; a character never seen is
        one. ``lengths`` in falling order. State 0 stands for every start: nothing matched yet."""
        width = len(self.languages)
        count, state = np.zeros((len(begins), width), np.int64), np.zeros((len(begins), width), np.int64)
        live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        for t, n in enumerate(live.tolist()):
            char, now = chars[begins[:n] + t], state[:n].ravel()
            to = self._moved(now << CHAR | np.repeat(char, width))
            stuck = np.flatnonzero((to == 0) | (now == 0))
            anew = self.start[char[stuck // width], stuck % width]
            count.reshape(-1)[stuck] += (now[stuck] != 0).astype(np.int64) + (anew == 0)
            to[stuck] = anew
            state[:n] = to.reshape(n, width)
        return count + (state != 0)

    def costs(self, texts: list[str]) -> np.ndarray:
        """Bits of each text in each language, a column each."""
        chars = self.number[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
        sizes = np.array([len(t) for t in texts], np.int64)
        parts = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begins = (np.cumsum(sizes) - sizes)[text] + nth * STRETCH
        lengths = np.minimum(sizes[text] - nth * STRETCH, STRETCH)
        order = np.argsort(-lengths, kind="stable")
        found = self.phrases(chars, begins[order], lengths[order])
        return np.stack([np.bincount(text[order], found[:, k], len(texts)) for k in range(found.shape[1])], axis=1) * self.bits

    def weighed(self, flat: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of plain texts the nearest language, its bits a letter (at most fifty letters' worth: a long text is not a surer one), and
        the odds of all languages against it, its own included."""
        costs = self.costs(flat)
        best = costs.argmin(axis=1)  # of equal ones the first in order of name
        letters = np.array([len(t) for t in flat])
        scaled = costs * (np.minimum(letters, 50) / np.maximum(letters, 1))[:, None]
        least = scaled.min(axis=1)
        odds = np.exp2(-np.minimum(scaled - least[:, None], 60.0)).sum(axis=1)
        return [self.languages[b] for b in best], least, odds

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        flat = [plain(t) for t in texts]
        if not self.languages or not any(flat):
            return [NONE] * len(texts), [0.0] * len(texts)
        langs, _, odds = self.weighed(flat)
        return [x if t else NONE for x, t in zip(langs, flat, strict=True)], [1 / o if t else 0.0 for o, t in zip(odds.tolist(), flat, strict=True)]


def tables_of(texts: dict[str, str], letters: int | None = None) -> list[dict[str, str]]:
    """The samples dealt to as many tables as it takes, in order of name."""
    groups: list[dict[str, str]] = []
    seen: set[str] = set()
    size = 0
    for x in sorted(texts):
        seen |= set(texts[x])
        if not groups or size + len(texts[x]) > (letters or LETTERS) or len(seen) >= 1 << CHAR:
            groups.append({})
            size, seen = 0, set(texts[x])
        groups[-1][x] = texts[x]
        size += len(texts[x])
    return groups or [{}]


def learn(docs: DataFrame, allowed: Column, sample: Sample = Sample(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Each language's sample: passages of the documents with the least hash of their id among those allowed and labelled, in
    order of the passages' hash until there are enough letters. At most ``docs`` rows a language are read whole; their
    passages are cut and chosen on the executors, what reaches the driver is bounded by letters a language. The languages are
    few. A document under an id that comes again counts as often, within the same bound."""
    known = docs.where(allowed & docs[lang_col].isNotNull() & docs[id_col].isNotNull() & docs[text_col].isNotNull())
    rows = known.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    ids = rows.select("id", "lang", F.xxhash64("text").alias("h"), F.row_number().over(first).alias("n")).where(F.col("n") <= sample.docs).select("id", "lang", "h").distinct()
    chosen = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(ids), ["id", "lang", "h"]).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = plain(text).split()
                parts = list(dict.fromkeys(" ".join(words[i : i + sample.words]) for i in range(0, len(words), sample.words)))
                keys = [xxhash.xxh64_intdigest(p, 1) >> 1 for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts), pa.string()), pa.array(keys, pa.int64()), pa.array(parts, pa.string())], names=["lang", "key", "part"])

    parts = chosen.mapInArrow(cut, "lang string, key long, part string").distinct()
    upto = Window.partitionBy("lang").orderBy("key", "part").rowsBetween(Window.unboundedPreceding, -1)
    room = parts.withColumn("before", F.coalesce(F.sum(F.length("part") + 1).over(upto), F.lit(0))).where(F.col("before") < sample.letters)
    texts: dict[str, list[str]] = {}
    for r in room.orderBy("lang", "key", "part").collect():
        texts.setdefault(r.lang, []).append(r.part)
    return {k: f" {' '.join(v)} " for k, v in texts.items()}


_JUDGES: dict[int, Judge] = {}


def _judge(name: int, texts: dict[str, str]) -> Judge:
    """One table a worker at a time."""
    if name not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[name] = Judge(texts)
    return _JUDGES[name]


def _side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The rows, texts last, in parts of as many characters as are parsed side by side; texts apart."""
    rows, held, size = [], [], 0
    for batch in batches:
        last = batch.num_columns - 1
        for n, text in enumerate(batch.column(last)):
            rows.append(batch.slice(n, 1).select(range(last)))
            held.append(text.as_py())
            size += len(held[-1] or "") + 20
            if size > BATCH:
                yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0], held
                rows, held, size = [], [], 0
    if held:
        yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0], held


def predict(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text", letters: int | None = None) -> DataFrame:
    """``id, lang, score`` of each row. A null text, or one without a letter, is ``und`` with score 0, and all are if
    nothing was learnt. Rows that repeat are judged alike; other columns are not read; an empty table gives no row.
    Whole texts are parsed; one of over STRETCH characters in stretches of that many.

    Samples of more than ``letters`` (LETTERS) in all are dealt to several tables: every text goes to each of them, a task holds
    one of them, and what they find is put together by id and text."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    groups = tables_of(texts, letters)
    shared = [docs.sparkSession.sparkContext.broadcast(g) for g in groups]
    names = [xxhash.xxh64_intdigest(repr(sorted(g.items()))) for g in groups]
    if len(groups) == 1:
        table, name = shared[0], names[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = _judge(name, table.value)
            for part, held in _side_by_side(batches):
                langs, scores = judge.judge(held)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang", "score"])

        return rows.mapInArrow(run, f"id {kind}, lang string, score double")

    def by_table(table, name: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = _judge(name, table.value)
            for part, held in _side_by_side(batches):
                flat = [plain(t) for t in held]
                langs, least, odds = judge.weighed(flat)
                langs = [x if t else None for x, t in zip(langs, flat, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(least, pa.float64()), pa.array(odds, pa.float64())], names=["id", "h", "lang", "least", "odds"])

        return run

    hashed = rows.withColumn("h", F.xxhash64("text")).select("id", "h", "text")
    found = None
    for nth, (table, name) in enumerate(zip(shared, names, strict=True)):
        one = hashed.mapInArrow(by_table(table, name), f"id {kind}, h long, lang string, least double, odds double").withColumn("nth", F.lit(nth))
        found = one if found is None else found.unionByName(one)
    each = found.groupBy("id", "h", "nth", "lang", "least", "odds").agg(F.count("*").alias("n"))  # rows that repeat
    weighed = each.groupBy("id", "h").agg(
        F.min_by("lang", F.struct("least", "lang")).alias("lang"), F.min("least").alias("best"), F.max("n").alias("n"), F.collect_list(F.struct("least", "odds")).alias("all")
    )
    total = F.aggregate("all", F.lit(0.0), lambda t, x: t + x["odds"] * F.pow(F.lit(2.0), -F.least(x["least"] - F.col("best"), F.lit(60.0))))
    score = F.when(F.col("lang").isNull(), 0.0).otherwise(1 / total)
    judged = weighed.select("id", F.coalesce("lang", F.lit(NONE)).alias("lang"), score.alias("score"), "n")
    return judged.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
