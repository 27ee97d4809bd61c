"""BPE as a deterministic automaton over tokens, built by one merge gadget for each merge.

The start has an arc for every symbol. The gadget of a merge ``u v -> w`` redirects the arcs labelled ``u`` to a copy of
their target that lacks the arc ``v``, and gives every state with an arc ``u`` an arc ``w`` to where ``v`` led. All arcs
of one label lead to one state, so a state is named by the label that leads to it and kept as what its gadgets changed:
``w`` begins as the state of ``v`` at that time, ``u`` loses ``v`` from that time on, and an arc that came later stands or
falls with the left part of its label. A word has exactly one path through the finished automaton: its encoding.

Written out, the table of transitions would have nearly as many arcs as there are pairs of tokens (over two billion for a
vocabulary of 49,000). So what is compiled is its complement, the arcs that gadgets removed; an arc is read off from it when
a word first comes to it, and then stays in a table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words whose encoding a worker remembers; the memory is emptied when full, results don't depend on it.
REMEMBERED = 300_000
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    table = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class MergeAutomaton:
    """``vocab``: token to id; ``merges``: pairs in order of rank."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.ids, self.labels = vocab, {i: t for t, i in vocab.items()}
        self.longest = max((len(t.removesuffix(END)) for t in vocab), default=0)
        self.born = dict.fromkeys(vocab.values(), -1)
        self.left: dict[int, int] = {}
        self.trunk: dict[int, tuple[int, int]] = {}  # a label's state: that of another label up to a time
        self.gone: dict[tuple[int, int], int] = {}  # and without these arcs, from these times on
        made = {a + b for a, b in merges}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.usable = {i for t, i in vocab.items() if t not in made}
        for at, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u in self.usable and v in self.usable and self._allows(u, v):
                self.gone[u, v] = at
                self.trunk[w], self.born[w], self.left[w] = (v, at), at, u
                self.usable.add(w)

    def _allows(self, last: int | None, label: int) -> bool:
        """Whether the state of ``last`` has an arc ``label``: no gadget removed it, nor the one it was added beside."""
        parts, above = [], len(self.born) + 1
        part: int | None = label
        while part is not None:
            parts.append((part, self.born[part], above))
            above, part = self.born[part], self.left.get(part)
        until = len(self.born) + 1
        while last is not None:
            for part, since, before in parts:
                at = self.gone.get((last, part))
                if at is not None and since < at <= before and at < until:
                    return False
            last, cut = self.trunk.get(last, (None, 0))
            until = min(until, cut)
        return True

    def step(self, last: int | None, label: int) -> bool:
        """Whether there is such an arc; None is the start."""
        if last is None:
            return label in self.usable
        key = (last, label)
        if (found := self.arcs.get(key)) is None:
            if len(self.arcs) > 4 * REMEMBERED:
                self.arcs.clear()
            found = self.arcs[key] = label in self.usable and self._allows(last, label)
        return found

    def encode_word(self, symbols: str) -> list[int]:
        """The labels of the path that spells ``symbols`` and ends with the word end. Long arcs are tried first; as every
        beginning of a word has one path at most, a place from which the end was not reached is not tried again."""
        n, ids, longest, step = len(symbols), self.ids, self.longest, self.step
        out: list[int] = []
        begins: list[int] = []
        dead: set[int] = set()
        at, last, j = 0, None, min(n, longest)
        while at < n:
            while j > at:
                label = ids.get(symbols[at:j] if j < n else symbols[at:] + END)
                if label is not None and j not in dead and step(last, label):
                    break
                j -= 1
            if j > at:
                out.append(label)
                begins.append(at)
                at, last, j = j, label, min(n, j + longest)
            else:
                dead.add(at)
                j, at = at - 1, begins.pop()
                out.pop()
                last = out[-1] if out else None
        return out


class _Chunks(dict):
    """Ids by chunk, of short chunks; emptied when full."""

    def __init__(self, tokenizer: WordTokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> list[int]:
        found = self.tokenizer.chunk(chunk)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) < 200:
            self[chunk] = found
        return found


class WordTokenizer:
    """A tokenizer file with word ends: NFC, lower case, words by the file's pattern, byte symbols, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added, self.labels = added, self.automaton.labels | {i: t for t, i in added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        self.bytes = byte_symbols()
        self.words: dict[str, list[int]] = {}
        self.chunks = _Chunks(self)

    def word(self, word: str) -> list[int]:
        if (found := self.words.get(word)) is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            found = self.automaton.encode_word("".join([self.bytes[b] for b in word.encode()]))
            if len(word) < 200:
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a text, or of a part of one between blanks: no rule of the file reaches across a blank."""
        out: list[int] = []
        for piece in self.special.split(chunk) if "<|" in chunk else (chunk,):
            if piece in self.added:
                out.append(self.added[piece])
                continue
            # one character at a time, as the tokenizer lowers: no final form of sigma
            plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
            for word in self.pattern.findall(plain):
                out += self.word(word)
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.chunks.__getitem__, text.split(" "))))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


_OPEN: dict[str, WordTokenizer] = {}


def opened(path: str) -> WordTokenizer:
    """The tokenizer of a file, compiled once in each worker."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds nothing to the rows but what they need: id, ``ids`` (array of int) and ``decoded`` (string).

    A null text counts as empty: no ids, an empty decoded text. Repeated rows each give a row, an empty table none;
    other columns are not read. ``path`` is a tokenizer file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = opened(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [tokenizer.encode(t or "") for t in part.column(1).to_pylist()]
                decoded = [tokenizer.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                    names=["id", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType
    schema = T.StructType().add("id", kind).add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
