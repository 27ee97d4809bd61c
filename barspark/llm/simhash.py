"""Near duplicates by SimHash fingerprints, found through anchor points of a covering code.

A block of a fingerprint is 23 bits; the words of the binary Golay code cover all blocks with radius 3, each block having
exactly one code word (its anchor) that near. Two blocks that differ in ``t`` bits share the anchor of either one within
radius 3 + t. So every fingerprint goes to its own anchor as owner and to every anchor within radius plus threshold as
guest; each anchor compares its owners with all it holds. With several blocks a table the excess over 3 is shared among
the blocks, which keeps the number of copies low and the number of anchors high (4096 for each block).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import alike as exact
from .common import stored
from .graph import components, forest

BITS, RADIUS, GENERATOR = 23, 3, 0b110001110101
SEED = 42


@dataclass(frozen=True)
class Scheme:
    """``words`` a shingle, ``prints`` fingerprints of 64 bits a text, ``tables``: the blocks of each table, by number of
    block; fingerprints meet if all blocks of a table together differ in ``threshold`` bits at most, and link if the
    first ``compared`` fingerprints together differ in ``max_bits`` at most. ``distinct``: a shingle counts once a text,
    however often it stands there."""

    words: int = 3
    prints: int = 1
    tables: tuple[tuple[int, ...], ...] = ((0, 1),)
    threshold: int = 2
    compared: int = 1
    max_bits: int = 2
    distinct: bool = False
    salt: int = field(default=0x9E3779B97F4A7C15)


def for_similarity(similarity: float = 0.8, words: int = 5, prints: int = 8, compared: int = 4, spread: float = 2) -> Scheme:
    """Every block of 23 bits is a table of its own. Texts whose shingle sets have the given Jaccard similarity differ in
    a share acos(2 J / (1 + J)) / pi of the bits on average; ``spread`` times the spread of that number is allowed above it."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * compared
    most = int(bits * share + spread * math.sqrt(bits * share * (1 - share)))
    return Scheme(words, prints, tuple((i,) for i in range(64 * prints // BITS)), 1, compared, most, distinct=True)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit, lowest bit first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    total = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # sums of 255 bits fit a byte, which adds up fastest
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def shingles(text: str | None, scheme: Scheme) -> np.ndarray:
    """A hash of each shingle; different ones in order if only those count. A text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z only, splits at ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    k = min(scheme.words, len(words))
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :], strict=False)], dtype=np.uint64)
    return np.unique(hashes) if scheme.distinct else hashes


def fingerprint(text: str | None, scheme: Scheme) -> bytes:
    """``prints`` times 8 bytes, each from the highest bit on. A text without words has all bits 0."""
    return _print_of(shingles(text, scheme), scheme)


def _print_of(hashes: np.ndarray, scheme: Scheme) -> bytes:
    if not len(hashes):
        return bytes(8 * scheme.prints)
    out = []
    for nth in range(scheme.prints):
        x = hashes
        if nth:  # further fingerprints come of the same hashes, mixed
            x = x + np.uint64(scheme.salt * nth & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
        out.append(np.packbits((bit_counts(x) * 2 > len(x))[::-1]).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, scheme: Scheme, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, print`` (binary, 8 bytes a fingerprint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), scheme) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["id", "print"])

    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("print", T.BinaryType())
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


@lru_cache(4)
def _patterns(threshold: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """By excess over the radius: patterns in order of their syndrome, and where each syndrome's begin and how many it has.
    Last: tables of the syndrome by byte."""
    tables = []
    for byte in range(3):
        values = []
        for b in range(256):
            x = b << 8 * byte
            for bit in range(30, BITS - 13, -1):
                if x >> bit & 1:
                    x ^= GENERATOR << (bit - 11)
            values.append(x)
        tables.append(np.array(values, dtype=np.int64))
    patterns, begins, counts = [], [], []
    for excess in range(threshold + 1):
        weights = range(RADIUS + 1) if not excess else [RADIUS + excess]
        found = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(BITS), w)], dtype=np.int64)
        syndrome = _syndrome(found, tables)
        order = np.argsort(syndrome, kind="stable")
        count = np.bincount(syndrome, minlength=1 << 11)
        patterns.append(found[order])
        counts.append(count)
        begins.append(np.cumsum(count) - count)
    return patterns, begins, counts, tables


def _syndrome(x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16]


def blocks_of(prints: np.ndarray) -> np.ndarray:
    """Rows of fingerprint bytes -> rows of 23-bit blocks."""
    bits = np.unpackbits(prints, axis=1, bitorder="little")
    n = bits.shape[1] // BITS
    return bits[:, : n * BITS].reshape(len(prints), n, BITS) @ (1 << np.arange(BITS, dtype=np.int64))


def anchors(blocks: np.ndarray, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, anchor, owner) of every anchor within radius plus threshold; the first of each table are the owners'."""
    patterns, begins, counts, tables = _patterns(scheme.threshold)
    syndromes = _syndrome(blocks, tables)
    for table, chosen in enumerate(scheme.tables):
        for excess in product(range(scheme.threshold + 1), repeat=len(chosen)):
            if sum(excess) > scheme.threshold:
                continue
            row, key = np.arange(len(blocks)), np.full(len(blocks), table, dtype=np.int64)
            for block, e in zip(chosen, excess, strict=True):
                s = syndromes[row, block]
                n = counts[e][s]
                first = np.repeat(begins[e][s] - (np.cumsum(n) - n), n)
                pattern = patterns[e][first + np.arange(len(first))]
                row, key = np.repeat(row, n), np.repeat(key, n)
                key = key << BITS | (blocks[row, block] ^ pattern)
            yield row, key, not any(excess)


#: Pairs that a task compares at once, links that it holds before it thins them, rows that it gathers before it compares,
#: rows of an anchor (or of a group in one) that are compared as a matrix, owners that are compared first.
PAIRS, LINKS, ROWS, LARGE, PIVOTS = 2_000_000, 1_000_000, 400_000, 64, 32


def _near(prints: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of two lists of rows, by bands of a matrix."""
    theirs = np.ascontiguousarray(prints[right].T)
    for band in np.array_split(left, -(-len(left) * len(right) // PAIRS)) if len(left) and len(right) else ():
        far = np.zeros((len(band), len(right)), np.uint16)
        for word in range(prints.shape[1]):
            far += np.bitwise_count(prints[band, word][:, None] ^ theirs[word])
        i, j = np.nonzero(far <= most)
        other = band[i] != right[j]
        yield band[i[other]], right[j[other]]


def _compare_large(prints: np.ndarray, owners: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links with the components of all near pairs of an owner and a row. A few owners are compared first: what they
    connect need not be compared again, so that a group of many near copies costs little more than its rows."""
    n = len(prints)
    rows, part = np.arange(n), np.arange(n)
    if len(owners) > PIVOTS:
        chosen = owners[np.linspace(0, len(owners) - 1, PIVOTS).astype(int)]
        pairs = [np.concatenate(x) for x in zip(*_near(prints, chosen, rows, most), strict=True)]
        if pairs and len(pairs[0]):
            node, root = forest(*pairs)
            yield node, root
            part[node] = root
    size = np.bincount(part, minlength=n)
    together = size[part[owners]] >= LARGE
    for p in np.unique(part[owners[together]]):
        yield from _near(prints, owners[part[owners] == p], rows[part != p], most)
    yield from _near(prints, owners[~together], rows, most)


def _pairs(anchor: np.ndarray, own: np.ndarray, prints: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs among rows in order of anchor: owners against all of their anchor, in blocks of bounded size."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    group = np.repeat(np.arange(len(starts)), sizes)
    owners = np.flatnonzero(own & (sizes[group] > 1))
    # large anchors one after the other, owners by rows of a matrix
    large = sizes[group[owners]] >= LARGE
    cut = np.flatnonzero(np.diff(group[owners[large]], prepend=-1, append=-1))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        mine = owners[large][lo:hi]
        first, n = starts[group[mine[0]]], sizes[group[mine[0]]]
        for left, right in _compare_large(prints[first : first + n], mine - first, most):
            yield first + left, first + right
    # small ones all at once
    small = owners[~large]
    upto = np.cumsum(sizes[group[small]])
    for part in np.split(small, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS))) if len(small) else ():
        n = sizes[group[part]]
        left = np.repeat(part, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts[group[part]], n)
        far = np.zeros(len(left), np.int64)
        for word in range(prints.shape[1]):
            far += np.bitwise_count(prints[left, word] ^ prints[right, word])
        near = (far <= most) & (left != right)
        yield left[near], right[near]


def _compare(anchor: np.ndarray, own: np.ndarray, ids: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows in order of anchor, thinned."""
    a, b = np.empty(0, ids.dtype), np.empty(0, ids.dtype)
    for left, right in _pairs(anchor, own, prints, most):
        a, b = np.concatenate([a, ids[left]]), np.concatenate([b, ids[right]])
        if len(a) > LINKS:
            a, b = forest(a, b)
    return forest(a, b) if len(a) else (a, b)


def links(distinct: DataFrame, scheme: Scheme) -> DataFrame:
    """``id`` (long), ``print`` of different texts -> ``a, b``: links whose components are those of all near pairs."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                short = np.array([x.tobytes() for x in raw[:, : 8 * scheme.compared]], dtype=object)
                for row, key, own in anchors(blocks_of(raw), scheme):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.full(len(key), own)), pa.array(ids[row]), pa.array(short[row], pa.binary())],
                        names=["anchor", "own", "id", "print"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = len(cols[0]) if last else int(np.searchsorted(cols[0], cols[0][-1]))
            now = [c[:end] for c in cols]
            held = [tuple(c[end:] for c in cols)]
            a, b = _compare(*now, scheme.max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        rows = 0
        for batch in batches:
            raw = b"".join(batch.column(3).to_pylist())
            if not batch.num_rows:
                continue
            held.append((
                batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(),
                np.frombuffer(raw, np.uint64).reshape(batch.num_rows, -1),
            ))
            rows += batch.num_rows
            if rows >= ROWS:
                yield from flush(False)
                rows = len(held[0][0]) // 2  # what a long group keeps is not compared again for each batch
        if held:
            yield from flush(True)

    placed = distinct.select("id", "print").mapInArrow(place, "anchor long, own boolean, id long, print binary")
    return placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, ``print`` (binary), ``component`` (the smallest id that links reach).

    Texts with one fingerprint are one node, however many they are. Null and blank texts have fingerprint 0, linked like
    any other. A null id is never a component unless all of it is null. Other columns are not read; rows that repeat
    each give a row; an empty table gives none.
    """
    prints = stored(fingerprints(docs, scheme, id_col, text_col), "prints")  # several steps read them
    nodes = prints.groupBy("print").agg(F.min("id").alias("id")).withColumn("node", F.xxhash64("print"))
    # a node is named by its print where that is 64 bits, else by a hash of it
    if scheme.prints == 1:
        nodes = nodes.withColumn("node", F.conv(F.hex("print"), 16, -10).cast("long"))
    roots = components(links(nodes.select(F.col("node").alias("id"), "print"), scheme))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written, so that the join reads two exchanges and Spark can split a large component
    least = stored(rooted.groupBy("root").agg(F.min("id").alias("component")), "least")
    named = rooted.join(least, "root").select(F.col("print").alias("p"), "component")
    return prints.join(named, prints["print"] == named["p"]).select("id", "print", "component")


def alike(docs: DataFrame, similarity: float, scheme: Scheme, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, ``component`` (the smallest id that links reach), where a link is a pair of one group
    of the scheme's candidates whose sets of shingles have the given Jaccard similarity. Shingles are compared by 64-bit hashes.

    Texts with one set are one node, however many they are; texts without a word are one. The scheme's links, thinned, tell
    which texts can have to do with each other at all; in these groups the sets themselves are compared (``alike.links``), so
    that a wrong link neither joins two texts nor hides a right one. A null id is never a component unless all of it is null.
    Rows that repeat each give a row; an empty table gives none.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("h"))
    kind = docs.schema[id_col].dataType.simpleString()

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints = [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py(), scheme)
                nodes.append(xxhash.xxh64_intdigest(np.unique(hashes).tobytes(), SEED) - (1 << 63))
                prints.append(_print_of(hashes, scheme))
            columns = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "node", "print"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles(text.as_py(), scheme)).view(np.int64) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], names=["node", "root", "set"])

    prints = stored(rows.mapInArrow(printed, f"id {kind}, h long, node long, print binary"), "prints")
    nodes = prints.groupBy("node").agg(F.min("print").alias("print"), F.min(F.struct(F.col("id").isNull().alias("no"), "id", "h")).alias("one"))
    nodes = stored(nodes, "nodes")
    loose = components(links(nodes.select(F.col("node").alias("id"), "print"), scheme))
    ones = nodes.join(loose, "node").select("node", "root", F.col("one.id").alias("i"), F.col("one.h").alias("g"))
    texts = rows.join(ones, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))).select("node", "root", "text")
    grouped = stored(texts.mapInArrow(sets, "node long, root long, set array<long>").dropDuplicates(["node"]), "shingles")
    roots = components(exact.links(grouped, similarity))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = stored(rooted.groupBy("root").agg(F.min("one.id").alias("component")), "least")
    return prints.join(rooted.select("node", "root").join(least, "root"), "node").select("id", "component")
