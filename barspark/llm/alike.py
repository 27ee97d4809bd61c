"""Which sets of one group are alike, decided where the sets lie: a pair never is a row.

Sets that have the Jaccard similarity ``s`` hold each other's elements to a share ``s`` at least. So a set of whose elements
fewer are found again in its group links to nothing, and of two that link the rarest ``1 - s`` of the elements have one in
common; what is left after that element bounds how much can be common at all. Only pairs that pass are counted out, and not
those that links found before connect already. None of this loses a link.

Groups are dealt to blocks of bounded size. A group of one block is a block; of a larger one all sets are held first against
a few of its own, which brings together what is alike all over, and then each block pairs a part of the sets outside the
largest component with a part of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .graph import components, forest

#: Elements of a block; sets of a large group that all others are held against first.
BLOCK, CENTRES = 300_000, 32
#: Elements that a task gathers before it compares, pairs that it looks at, elements that it looks up at once, and sets with a rare
#: element in common from which on some are compared first.
GATHERED, PAIRS, LOOKED_UP, MANY, PIVOTS = 1_000_000, 1_000_000, 4_000_000, 64, 16


def _range(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``n`` of them, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Sets:
    """Sets of several groups: ``group`` and number of elements of each, and the elements of all, one set after the other."""

    def __init__(self, group: np.ndarray, sizes: np.ndarray, elements: np.ndarray, similarity: float):
        self.sizes, self.similarity = sizes, similarity
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((elements, group[owner]))
        first = np.r_[True, (elements[order][1:] != elements[order][:-1]) | (group[owner[order]][1:] != group[owner[order]][:-1])][: len(order)]
        token = np.empty(len(order), np.int64)
        token[order] = np.cumsum(first) - 1
        often = np.bincount(token)
        again = often[token] > 1 if len(token) else np.zeros(0, bool)
        self.least = np.ceil(similarity * sizes - 1e-9).astype(np.int64)  # that a set has in common with any that it links to
        shared = np.bincount(owner[again], minlength=len(sizes))
        again &= (shared >= self.least)[owner]
        owner, token = owner[again], token[again]
        by = np.lexsort((token, owner))
        self.tokens, self.n = token[by], np.bincount(owner, minlength=len(sizes))
        self.first = np.cumsum(self.n) - self.n
        self.keys = owner[by] * (len(often) + 1) + self.tokens
        self.span = len(often) + 1
        # the rarest first; what no other set has comes before all
        by = np.lexsort((token, often[token], owner))
        owner, token = owner[by], token[by]
        place = (sizes - shared)[owner] + np.arange(len(owner)) - self.first[owner]
        begins = place <= (sizes - self.least)[owner]
        owner, token, place = owner[begins], token[begins], place[begins]
        by = np.lexsort((owner, sizes[owner], token))
        self.owner, self.token, self.rest = owner[by], token[by], (sizes[owner] - place - 1)[by]

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair is as alike as asked, by counting."""
        less = self.n[a] <= self.n[b]
        x, y = np.where(less, a, b), np.where(less, b, a)
        upto = np.cumsum(self.n[x])
        found = np.zeros(len(a), np.int64)
        cuts = np.searchsorted(upto, np.arange(LOOKED_UP, upto[-1], LOOKED_UP)) if len(a) else []
        for part in np.split(np.arange(len(a)), cuts):
            n = self.n[x[part]]
            want = np.repeat(y[part] * self.span, n) + self.tokens[_range(self.first[x[part]], n)]
            at = np.searchsorted(self.keys, want)
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == want if len(want) else np.zeros(0, bool)
            found[part] = np.bincount(np.repeat(np.arange(len(part)), n)[hit], minlength=len(part))
        return found >= (self.sizes[a] + self.sizes[b] - found) * self.similarity - 1e-9

    def may(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sets of two places with one element can be as alike as asked, if it is their first in common."""
        s, t = self.sizes[self.owner[i]], self.sizes[self.owner[j]]
        common = 1 + np.minimum(self.rest[i], self.rest[j])
        return (np.minimum(s, t) >= np.maximum(s, t) * self.similarity - 1e-9) & (common * (1 + self.similarity) >= (s + t) * self.similarity - 1e-9)


def within(group: np.ndarray, part: np.ndarray, row: np.ndarray, col: np.ndarray, sizes: np.ndarray, elements: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among sets, by their number, that connect what all pairs of a ``row`` and a ``col`` set of one group do that are
    alike; sets of one ``part`` count as connected."""
    sets = Sets(group, sizes, elements, similarity)
    part = np.unique(part, return_inverse=True)[1]

    def linked(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal part
        a, b = sets.owner[i], sets.owner[j]
        wanted = (part[a] != part[b]) & (row[a] & col[b] | row[b] & col[a])
        i, j = i[wanted], j[wanted]
        may = sets.may(i, j)
        a, b = sets.owner[i[may]], sets.owner[j[may]]
        once = np.unique(np.minimum(a, b) * len(sizes) + np.maximum(a, b))
        a, b = once // len(sizes), once % len(sizes)
        right = sets.alike(a, b)
        if right.any():
            yield forest(a[right], b[right])
            node, root = forest(part[a[right]], part[b[right]])
            name = np.arange(len(sizes))
            name[node] = root
            part = name[part]

    starts = np.flatnonzero(np.r_[True, sets.token[1:] != sets.token[:-1]][: len(sets.token)])
    counts = np.diff(np.r_[starts, len(sets.token)])
    end = np.repeat(starts + counts, counts)
    places = np.arange(len(end))
    few = places[np.repeat(counts < MANY, counts)]
    upto = np.cumsum(end[few] - few - 1)
    for some in np.split(few, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS))) if len(few) else ():
        n = end[some] - some - 1
        yield from linked(np.repeat(some, n), _range(some + 1, n))
    for first, n in sorted(zip(starts[counts >= MANY].tolist(), counts[counts >= MANY].tolist(), strict=True), key=lambda x: x[1]):
        all_ = np.arange(first, first + n)
        chosen = all_[np.linspace(0, n - 1, PIVOTS).astype(int)]
        yield from linked(np.repeat(chosen, n), np.tile(all_, PIVOTS))
        at, wide = first, max(1, PAIRS // n)
        while at < first + n:
            some = np.arange(at, min(at + wide, first + n))
            # parts that are whole need no look: only those of a band that are not one with all that follow
            later = np.arange(at + 1, first + n)
            i, j = np.nonzero((part[sets.owner[some]][:, None] != part[sets.owner[later]]) & (some[:, None] < later))
            yield from linked(some[i], later[j])
            at += wide


def _blocks(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows in order of block: root, lo, hi, node, part, row, col, set."""

    def compared(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        root, lo, hi, node, part, row, col = (table.column(k).to_numpy() for k in range(7))
        lists = table.column(7).combine_chunks()
        sizes, elements = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        group = np.cumsum(_begins(root, lo, hi))
        for a, b in within(group, part, row, col, sizes, elements, similarity):
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    elements = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and elements >= GATHERED:  # all whole blocks but the one that may go on
            last = [held[-1].column(k)[-1].as_py() for k in range(3)]
            keep: list[pa.RecordBatch] = []
            while held:
                same = np.all([held[-1].column(k).to_numpy() == last[k] for k in range(3)], axis=0)
                begin = int(np.argmax(same)) if same.any() else held[-1].num_rows
                keep.insert(0, held[-1].slice(begin))
                held[-1] = held[-1].slice(0, begin)
                if begin:
                    break
                held.pop()
            if held:
                yield from compared(held)
            held = keep
            elements = sum(len(b.column(7).flatten()) for b in held) // 2  # what a long block keeps is not gone through for each batch
        held.append(batch)
        elements += len(batch.column(7).flatten())
    if held:
        yield from compared(held)


def _begins(*columns: np.ndarray) -> np.ndarray:
    changed = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.r_[True, changed][: len(columns[0])]


def _stars(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows in order of root, slot, kind (0: a centre, 1: any set), node, set: links of sets with centres."""
    key, centres = None, []
    for batch in batches:
        root, slot, kind, node = (batch.column(k).to_numpy() for k in range(4))
        lists = batch.column(4)
        cuts = np.flatnonzero(np.r_[_begins(root, slot, kind), True]) if batch.num_rows else [0]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if (root[begin], slot[begin]) != key:
                key, centres = (root[begin], slot[begin]), []
            mine = lists.slice(begin, end - begin)
            sizes, elements = mine.value_lengths().to_numpy().astype(np.int64), mine.flatten().to_numpy()
            if not kind[begin]:
                centres.append((node[begin:end], sizes, elements))
                continue
            ids, s, e = (np.concatenate(c) for c in zip(*centres, (node[begin:end], sizes, elements), strict=True))
            n = len(ids) - (end - begin)
            is_centre = np.arange(len(ids)) < n
            one = np.zeros(len(ids), np.int64)
            for a, b in within(one, np.arange(len(ids)), is_centre, ~is_centre, s, e, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])


def links(sets: DataFrame, similarity: float, block: int | None = None) -> DataFrame:
    """``node`` (long), ``root`` (long), ``set`` (array of different longs), a row a node -> ``a, b``: links that connect what all pairs
    of one root do whose sets have the Jaccard similarity or more. ``sets`` is read several times."""
    block = block or BLOCK
    total = sets.groupBy("root").agg(F.sum(F.size("set")).alias("elements"), F.count("*").alias("nodes")).where("nodes > 1")
    sized = stored(total.select("root", F.ceil(F.col("elements") / block).cast("int").alias("cols"), "elements"), "sized")
    schema = "root long, lo int, hi int, node long, part long, row boolean, col boolean, set array<long>"
    yes, none = F.lit(True), F.lit(0)
    one = sets.join(sized.where("cols <= 1"), "root").select("root", none.alias("lo"), none.alias("hi"), "node", F.col("node").alias("part"), yes.alias("row"), yes.alias("col"), "set")
    compare = lambda rows: rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(lambda b: _blocks(b, similarity), "a long, b long")
    large = sized.where("cols > 1")
    if large.isEmpty():
        return compare(one)

    many = stored(sets.join(large.select("root", "cols"), "root"), "many")
    slot = F.pmod(F.xxhash64("node"), F.col("cols")).cast("int")
    nth = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node", F.lit(1)), "node"))
    chosen = many.select("root", "node", nth.alias("nth")).where(F.col("nth") <= CENTRES).select("node")
    centres = many.join(chosen, "node", "left_semi").select("root", F.explode(F.sequence(none, F.col("cols") - 1)).alias("slot"), none.alias("kind"), "node", "set")
    every = many.select("root", slot.alias("slot"), F.lit(1).alias("kind"), "node", "set")
    beside = centres.unionByName(every).repartition("root", "slot").sortWithinPartitions("root", "slot", "kind")
    sure = stored(beside.mapInArrow(lambda b: _stars(b, similarity), "a long, b long"), "stars")

    part = components(sure).withColumnRenamed("root", "part")
    parts = stored(many.select("root", "node", "cols", F.size("set").alias("n")).join(part, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts")
    main = parts.groupBy("root", "part").agg(F.sum("n").alias("n")).groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("inside"))
    rows = main.join(large, "root").select("root", "main", F.ceil((F.col("elements") - F.col("inside")) / block).cast("int").alias("rows")).where("rows > 0")
    out = F.col("part") != F.col("main")
    placed = parts.join(rows, "root").select("root", "node", "part", out.alias("out"), F.when(out, F.pmod(F.xxhash64("node", F.lit(2)), F.col("rows")).cast("int")).alias("r"), slot.alias("c"), "rows", "cols")
    each = placed.select("root", "node", "part", F.explode(F.concat(
        F.when(F.col("out"), F.transform(F.sequence(none, F.col("cols") - 1), lambda c: F.struct(F.col("r").alias("lo"), c.alias("hi"), yes.alias("row"), (c == F.col("c")).alias("col")))).otherwise(F.array()),
        F.transform(F.filter(F.sequence(none, F.col("rows") - 1), lambda r: ~r.eqNullSafe(F.col("r"))), lambda r: F.struct(r.alias("lo"), F.col("c").alias("hi"), F.lit(False).alias("row"), yes.alias("col"))),
    )).alias("at")).select("root", "at.lo", "at.hi", "node", "part", "at.row", "at.col")
    blocks = each.join(many.select("node", "set"), "node").select(*[f.split()[0] for f in schema.split(", ")])
    return compare(one).unionByName(compare(blocks)).unionByName(sure)
