"""Fill-in-the-middle: a text is cut into prefix, middle and suffix and written in another order.

A unit is a word with the white space before it, or the white space at the end. Fixed blocks of a text count the units that
end in them and their code points; a Fenwick tree over the blocks adds both up. A cut after so many units descends the tree
by powers of two to the block that holds the last of them, and only that block is looked through for the place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Forms:
    """``share`` of texts in 100 that are rearranged, ``spm`` of those in 100 that begin with their suffix; ``block``: code
    points of a block."""

    seed: int = 42
    share: int = 50
    spm: int = 80
    block: int = 512


def unit_ends(points: np.ndarray) -> np.ndarray:
    """Whether a unit ends with each code point."""
    space = (points == 32) | (points >= 9) & (points <= 13)
    ends = ~space
    ends[:-1] &= space[1:]
    if len(ends):
        ends[-1] = True
    return ends


class UnitTree:
    """A Fenwick tree over blocks of a text: units that end in each, and code points."""

    def __init__(self, text: str, block: int):
        self.ends = unit_ends(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        self.block, size = block, len(self.ends)
        begins = np.arange(0, size, block)
        upto = np.zeros((len(begins) + 1, 2), np.int64)
        if size:
            upto[1:, 0] = np.cumsum(np.add.reduceat(self.ends, begins, dtype=np.int64))
            upto[1:, 1] = np.minimum(begins + block, size)
        at = np.arange(len(upto))
        self.sums = (upto - upto[at & (at - 1)]).tolist()  # node i holds the blocks after i without its lowest bit, up to i
        self.units = int(upto[-1, 0])

    def end_of(self, unit: int) -> int:
        """The code points up to the end of the ``unit``-th unit, counted from 1; 0 for none."""
        if not unit:
            return 0
        at, units, points = 0, 0, 0
        step = 1 << len(self.sums).bit_length()
        while step := step >> 1:
            if at + step < len(self.sums) and units + self.sums[at + step][0] < unit:
                at += step
                units, points = units + self.sums[at][0], points + self.sums[at][1]
        within = np.flatnonzero(self.ends[points : points + self.block])
        return points + int(within[unit - units - 1]) + 1


def rearrange(docs: DataFrame, forms: Forms = Forms(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars, middle_chars`` (code points,
    null if plain), ``output``.

    What becomes of a text depends on the seed, its id and the text alone, so that reruns and repeated rows agree. Texts that
    are empty or hold one of the three marks stay plain, for they could not be restored. A null text counts as empty, a null
    id as the empty string; an empty table gives no rows; other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{forms.seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))), 256)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), digest.alias("d"))
    h = [F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= forms.share), "plain").when(h[3] % 100 < forms.spm, "spm").otherwise("psm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                made = [_written(*row, forms.block) for row in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                n, before, between, output = zip(*made, strict=True)
                numbers = [pa.array(c, pa.int64()) for c in (n, before, between)]
                columns = [part.column(0), numbers[0], part.column(2), *numbers[1:], pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.select("id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2")).mapInArrow(run, schema)


def _written(text: str, form: str, h1: int, h2: int, block: int) -> tuple[int, int | None, int | None, str]:
    tree = UnitTree(text, block)
    if form == "plain":
        return tree.units, None, None, text
    first, last = (tree.end_of(u) for u in sorted((h1 % (tree.units + 1), h2 % (tree.units + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    output = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return tree.units, first, last - first, output


def restored(output: Column, form: Column) -> Column:
    """The text that ``rearrange`` wrote, from its output and form. No part holds a mark and marks don't overlap, so that the
    first of each kind is the one that was written."""
    body = F.substring(output, len(PREFIX) + 1, 1 << 30)
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(PREFIX)
    one, rest = F.split_part(body, second, F.lit(1)), F.split_part(body, second, F.lit(2))
    other, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    whole = F.when(form == "psm", F.concat(one, middle, other)).otherwise(F.concat(other, middle, one))
    return F.when(form == "plain", output).otherwise(whole)
