"""Codes of vectors by codebooks of their parts, in whole numbers only.

Components become whole numbers and vectors four parts. Parts and entries are filled up with zeros to a power of two and
taken through the Walsh-Hadamard transform, which multiplies all squared distances by that power. Squared differences are
added up in order of sequency, smooth functions first; an entry goes as soon as its sum is over the distance of the best
entry known. Sums are whole, so what is left is the nearest entry exactly, ties at the lowest number.

Each round is one pass: a task adds up its vectors by entry, Spark adds up the tasks' sums, and the codebooks (256 entries
a part, whatever the rows) go back to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Codes:
    """``scale``: what a component is multiplied by before it is floored; ``rows`` that are compared at once; ``prefix``:
    coefficients that all entries are compared by before any goes."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    rows: int = 2048
    prefix: int = 4


#: Most labels whose sums are broadcast; more are joined by shuffles, and each label's rows by so many keys.
FEW, KEYS = 100_000, 32
#: Sums of a task are handed on in pieces below this.
LIMB = 10**18


@lru_cache(8)
def walsh(n: int) -> np.ndarray:
    """The matrix of 1 and -1 of order ``n``, a power of two, its rows by the number of their changes of sign."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def whole(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where the sum of some thousands fits, else Python's whole numbers."""
    if not len(flat) or np.abs(flat).max() < 2**50 // scale:
        return np.floor(flat.astype(np.float64) * scale).astype(np.int64)
    exact = [x.as_integer_ratio() for x in flat.astype(np.float64).tolist()]
    return np.array([a * scale // b for a, b in exact], dtype=object)


def spectra(parts: np.ndarray) -> np.ndarray:
    """Rows of parts, transformed: as many coefficients as the next power of two."""
    width = 1 << max(parts.shape[1] - 1, 0).bit_length()
    matrix = walsh(width)[:, : parts.shape[1]]  # columns of the zeros don't count
    return parts.dot(matrix.T if parts.dtype != object else matrix.T.astype(object))


def nearest(parts: np.ndarray, book: np.ndarray, prefix: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of parts."""
    n, rows = len(parts), np.arange(len(parts))
    if not parts.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    width = 1 << (parts.shape[1] - 1).bit_length()
    largest = max(int(abs(a).max()) for a in (parts, book)) if n else 0
    room = np.int64 if largest * width < 2**30 else object  # a scaled distance is (2 * largest * width)^2 at most
    x, c = spectra(parts.astype(room)), spectra(book.astype(room))
    sums = np.zeros((n, len(c)), room)
    for j in range(min(prefix, width)):
        d = x[:, j, None] - c[None, :, j]
        sums += d * d
    guess = sums.argmin(axis=1)
    d = x - c[guess]
    best = (d * d).sum(axis=1)
    row, entry = np.nonzero(sums <= best[:, None])
    total, at = sums[row, entry], min(prefix, width)
    while at < width:
        upto = min(width, 2 * at)
        d = x[row, at:upto] - c[entry, at:upto]
        total = total + (d * d).sum(axis=1)
        left = total <= best[row]
        row, entry, total, at = row[left], entry[left], total[left], upto
    # the guess is among them, so every row has one; entries are in order, so the first least is the lowest number
    begins = np.searchsorted(row, rows)
    least = np.minimum.reduceat(total, begins)
    first = np.flatnonzero(total == least[row])
    _, one = np.unique(row[first], return_index=True)
    return entry[first[one]], least // width


def _vectors(batches: Iterator[pa.RecordBatch], width: int, codes: Codes) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their whole numbers, rows by ``width`` components; shorter vectors end in zeros."""
    for batch in batches:
        for start in range(0, batch.num_rows, codes.rows):
            part = batch.slice(start, codes.rows)
            lists = part.column(part.num_columns - 1)
            flat = whole(lists.flatten().to_numpy(zero_copy_only=False), codes.scale)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            made = np.zeros((part.num_rows, width), flat.dtype)
            row = np.repeat(np.arange(part.num_rows), sizes)
            made[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            yield part, made


def _long(x: int) -> int | None:
    return x if abs(x) < 1 << 63 else None


@dataclass(frozen=True)
class Coded:
    """``rows``: id, label, ``code`` (array of entry numbers, a part each), ``error`` (squared distance of the whole vector to
    its entries); ``books``: by part, the entries' components."""

    rows: DataFrame
    books: list[list[list[int]]]

    def digest(self) -> str:
        """Of all components by part, entry and place, in decimals between commas."""
        return hashlib.sha256(",".join(str(v) for book in self.books for entry in book for v in entry).encode()).hexdigest()


def encode(
    vectors: DataFrame, codes: Codes = Codes(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> Coded:
    """Codes of all vectors, written once.

    Vectors that are null or hold a null or a component that isn't finite are dropped. The codebooks begin with the vectors of
    the least ids (null ids last, of rows with one id the vector that sorts first); fewer rows than entries make fewer
    entries. A vector shorter than the longest, or a length that isn't a multiple of the parts, ends in zeros. An error beyond
    the range of a long is null. Repeated rows each give a row; an empty table gives none and no entries; other columns are not read.
    """
    good = vectors[vec_col].isNotNull() & F.forall(vectors[vec_col], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(good).select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vec_col].alias("vec"))
    first = [tuple(r) for r in kept.orderBy(F.asc_nulls_last("id"), "vec").limit(codes.entries).select("vec").collect()]
    longest = kept.agg(F.max(F.size("vec"))).first()[0] or 0
    wide = -(-longest // codes.parts)
    width = wide * codes.parts
    begun = np.zeros((len(first), width), object)
    for row, (vec,) in enumerate(first):
        begun[row, : len(vec)] = whole(np.array(vec, np.float64), codes.scale)
    books = [begun[:, p * wide : (p + 1) * wide] for p in range(codes.parts)]
    only = kept.select("vec")

    def sums_of(books: list[np.ndarray]):
        """Sums and numbers of the vectors by part and entry, a row each from a task."""
        plain = [_plain(b) for b in books]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((codes.parts, len(plain[0])), np.int64)
            totals = np.zeros((codes.parts, len(plain[0]), wide), object)
            for _, made in _vectors(batches, width, codes):
                for p, book in enumerate(plain):
                    mine = made[:, p * wide : (p + 1) * wide]
                    entry, _ = nearest(mine, book, codes.prefix)
                    counts[p] += np.bincount(entry, minlength=len(book))
                    order = np.argsort(entry, kind="stable")
                    used, begins = np.unique(entry[order], return_index=True)
                    if wide:
                        totals[p][used] += np.add.reduceat(mine[order], begins, axis=0).astype(object)
            part, entry = np.nonzero(counts)
            n, left, limb = counts[part, entry], totals[part, entry], 0
            while limb == 0 or left.size and left.any():  # decimals of LIMB digits a row: almost always one
                low = left - np.sign(left) * (abs(left) // LIMB * LIMB) if left.size else left
                columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(np.full(len(part), limb, np.int32)), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(low.tolist(), pa.list_(pa.int64()))], names=["part", "entry", "limb", "n", "total"])
                left, n, limb = (left - low) // LIMB if left.size else left, np.zeros_like(n), limb + 1

        return run

    for _ in range(codes.rounds if first else 0):
        found = only.mapInArrow(sums_of(books), "part int, entry int, limb int, n long, total array<long>")
        # rows of up to 256 entries a part from each task: added up by place before the driver sees them
        each = found.select("part", "entry", "limb", "n", F.posexplode("total").alias("place", "v"))
        added = each.groupBy("part", "entry", "limb", "place").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        sums: dict[tuple[int, int, int], list[int]] = {}
        for r in added.collect():
            total = sums.setdefault((r.part, r.entry, r.place), [0, 0])
            total[0] += int(r.v) * LIMB**r.limb
            total[1] += r.n
        books = [b.copy() for b in books]
        for (part, entry, place), (total, n) in sums.items():
            books[part][entry, place] = total // n

    plain = [_plain(b) for b in books]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, made in _vectors(batches, width, codes):
            done = [nearest(made[:, p * wide : (p + 1) * wide], book, codes.prefix) for p, book in enumerate(plain)]
            error = sum(e.astype(object) for _, e in done)
            code = np.stack([c for c, _ in done], axis=1).tolist()
            columns = [part.column(0), part.column(1), pa.array(code, pa.list_(pa.int32())), pa.array([_long(int(e)) for e in error], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    rows = kept.mapInArrow(assign, f"id {kinds[0]}, label {kinds[1]}, code array<int>, error long")
    return Coded(stored(rows, "codes"), [b.tolist() for b in books])


def _plain(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if not book.size or max(abs(v) for v in book.flat) < 2**62 else book


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``: the errors of their label added up, nulls together; null beyond the range of a long."""
    total = F.sum(F.col("error").cast("decimal(20,0)")).try_cast("long").alias("label_error")
    sums = stored(rows.groupBy("label").agg(total).withColumnRenamed("label", "of"), "label_errors")
    if sums.count() <= FEW:
        return rows.join(F.broadcast(sums), rows["label"].eqNullSafe(F.col("of"))).drop("of")
    each = sums.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(KEYS - 1))))
    keyed = rows.withColumn("at", F.pmod(F.xxhash64("id", "code"), F.lit(KEYS)).cast("int"))
    return keyed.join(each, keyed["label"].eqNullSafe(F.col("of")) & (F.col("at") == F.col("to"))).drop("of", "at", "to")
