"""Removal of repeated byte strings by suffix arrays of shards.

A string of ``length`` bytes counts as repeated if it starts anywhere else, in the same document or another. Suffix
arrays of whole texts would cost far more than the work needs: two equal strings of ``length`` bytes also share the
place of their least hashed piece (``anchor``, half as long as the string, a third of a passage), so text whose anchors
come up once has no repeat. The steps:

1. every document is cut into stretches: the strings whose anchor is the same piece, one after the other, with the bytes
   that they cover. Equal stretches are one class; a class of two or more is repeated as a whole;
2. an anchor with one class is settled. The different stretches of an anchor go to a shard of bounded size by the anchor;
   an anchor with more stretches than a shard holds is spread over several;
3. each shard sorts the suffixes of its stretches (Larsson-Sadakane refinement: by seven bytes, then by the rank of the
   suffix that many bytes on, groups of one left alone, twice as far each time) and takes common prefixes by Kasai's
   rule (a suffix whose left neighbour in the text continues the same match has one byte less; only the others are
   compared byte by byte);
4. shards that share a spread anchor hand on one digest for each of their groups, with the number of its places; digests
   are dealt out in order, and each is looked up among the others by binary search.

Where shorter passages are asked for too, they come first: a repeated string is made of repeated passages, one at each place, so
that it lies in one run of them, and only those runs are cut and sorted again for the longer strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

LENGTH = 400
#: Bytes of a repeated passage: fifty words are longer but where they average under 3.8 bytes.
PASSAGE = 240
#: Bytes of text that a task hashes at once (a longer document is taken alone), stretches of one anchor and bytes in a shard. The
#: arrays of a batch or shard are eight times as large and stay in a core's cache: with eight times these bytes either step takes twice as long.
BATCH, SPREAD, SHARD = 1 << 18, 2000, 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base & (1 << 64) - 1, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def stretches(raw: bytes, lengths: np.ndarray, length: int, pieces: int = 2) -> tuple[np.ndarray, ...]:
    """Documents joined to ``raw`` -> document, anchor, first and last start of each stretch, and the anchor's hash; an anchor is
    one of ``pieces`` parts of ``length``."""
    piece = length // pieces
    window = length - piece + 1
    n = len(raw)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    ends = np.cumsum(lengths)
    rolled = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * _powers(_BASE, n), out=rolled[1:])
    h = (rolled[piece:] - rolled[:-piece]) * _powers(_INVERSE, n - piece + 1)
    del rolled
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    m = len(h)
    low = np.uint64((1 << max(24, m.bit_length())) - 1)  # the place breaks ties: the first of equal pieces
    key = np.full(m + -m % window, np.uint64((1 << 64) - 1))
    key[:m] = (h & ~low) | np.arange(m, dtype=np.uint64)
    rows = key.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[: m - window + 1], ahead[window - 1 : m]) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(anchor)]
    ok = np.flatnonzero(np.arange(len(anchor)) + length <= ends[doc])
    anchor, doc = anchor[ok], doc[ok]
    if not len(ok):
        return none, none, none, none, none.astype(np.uint64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(anchor)] - 1
    return doc[first], anchor[first], ok[first], ok[last], h[anchor[first]]


#: Bytes in the first key of a suffix: nine bits each, so that an end differs from a zero byte.
SYMBOLS = 7


def suffix_array(text: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Order of all suffixes; the suffix at i ends at ``stop[i]``, a place of its own rank (stretches end there)."""
    n = len(text)
    place = np.arange(n)
    at_stop = stop == place
    padded = np.zeros(n + SYMBOLS, np.uint64)
    padded[:n] = text + np.uint64(1)
    key = np.zeros(n, np.uint64)
    left = stop - place
    for k in range(SYMBOLS):  # beyond the end is less than any byte
        key = key << np.uint64(9) | np.where(left > k, padded[k : n + k], np.uint64(0))
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # ends are different from each other, in the order of their place
    ends = np.flatnonzero(at_stop)
    order[: len(ends)] = ends
    rank[ends] = np.arange(len(ends))
    far = SYMBOLS
    size = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(size[rank[order]] > 1)  # places in the order whose group isn't sorted yet
    while len(open_):
        suffix = order[open_]
        group = rank[suffix]
        then = rank[np.minimum(suffix + far, stop[suffix])]
        by = np.argsort(group * n + then) if n < 1 << 31 else np.lexsort((then, group))
        suffix, group, then = suffix[by], group[by], then[by]
        order[open_] = suffix
        new = np.r_[True, (group[1:] != group[:-1]) | (then[1:] != then[:-1])]
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rank[suffix] = open_[head]
        single = new & np.r_[new[1:], True]
        open_ = open_[~single]
        far *= 2
    return order


def common_prefixes(text: np.ndarray, stop: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of each place in the order and the one before it, by Kasai's rule; values over ``most`` may be given as any over it."""
    n = len(text)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    # a pair that goes on the match of the pair one byte earlier: both moved by one byte, with equal bytes before
    carried = np.zeros(n, bool)
    if n > 1:
        carried[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (stop[:-1] == stop[1:])
        carried[1:] &= stop[np.maximum(before[:-1], 0)] == stop[np.maximum(before[1:], 0)]
        carried[1:] &= text[:-1] == text[np.maximum(before[:-1], 0)]
    first = np.flatnonzero(~carried & (before >= 0))
    match = np.zeros(n, np.int64)
    a, b = first, before[first]
    room = np.minimum(stop[a] - a, stop[b] - b)
    # eight bytes at a time while all eight agree, then the last bytes one by one
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    got, live, limit = np.zeros(len(a), np.int64), np.arange(len(a)), np.minimum(room, most + 2 * 400)
    while len(live):
        x, y = a[live] + got[live], b[live] + got[live]
        same = (eight[np.minimum(x, n)] == eight[np.minimum(y, n)]).cumprod(axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
        got[live] = np.minimum(got[live] + same, limit[live])
        live = live[(same == 8) & (got[live] < limit[live])]
    match[first] = got
    start = np.where(~carried, np.arange(n), 0)
    origin = np.maximum.accumulate(start)
    match = np.where(carried, np.maximum(match[origin] - (np.arange(n) - origin), 0), match)
    out = match[order]
    out[before[order] < 0] = 0
    return out


def shard_repeats(pieces: list[bytes], place: np.ndarray, several: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated strings of a shard: (piece, start in it) of every string found at two places or in a repeated class,
    and per string the number of its group in suffix order, -1 if it is too short.

    ``place``: the place of each piece's first byte, unlike for different documents; ``several``: pieces of repeated classes.
    """
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    stop = (begins + sizes)[piece]
    order = suffix_array(text, stop)
    prefix = common_prefixes(text, stop, order, length)
    fits = stop[order] - order >= length
    group = np.cumsum(prefix < length)
    order, group = order[fits], group[fits]
    at = place[piece[order]] + (order - begins[piece[order]])
    several = several[piece[order]]
    if not len(order):
        return order, order, order
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    repeated = (np.minimum.reduceat(at, starts) != np.maximum.reduceat(at, starts)) | np.maximum.reduceat(several, starts)
    number = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
    return piece[order], order - begins[piece[order]], np.where(repeated[number], number, -1 - number)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(values) != 1)
    return values[np.r_[0, cut + 1]], values[np.r_[cut, len(values) - 1]]


def repeated_spans(texts: DataFrame, length: int = LENGTH, pieces: int = 2) -> DataFrame:
    """``id, text`` (string or binary) -> ``id, first, after``: byte ranges that cover every repeated string; ranges of an id may
    overlap. ``pieces``: how many anchors a string could hold side by side; shorter anchors make fewer and longer stretches."""
    texts = texts.select("id", F.col("text").cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list, data: list[bytes]) -> pa.RecordBatch:
            raw, sizes = b"".join(data), np.array([len(x) for x in data])
            begins = np.cumsum(sizes) - sizes
            doc, anchor, first, last, key = stretches(raw, sizes, length, pieces)
            cls = np.array(
                [xxhash.xxh3_64_intdigest(raw[a : b + length], m - a) for m, a, b in zip(anchor.tolist(), first.tolist(), last.tolist(), strict=True)],
                np.uint64,
            )
            off = begins[doc]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, dtype=np.int64)[doc]), pa.array(key.view(np.int64)), pa.array(cls.view(np.int64)),
                 pa.array(first - off), pa.array(last - off + length)],
                names=["id", "anchor", "cls", "first", "after"],
            )

        ids, data, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                raw = t.as_py() or b""
                if len(raw) < length:
                    continue
                if data and size + len(raw) > BATCH:
                    yield flush(ids, data)
                    ids, data, size = [], [], 0
                ids.append(i.as_py())
                data.append(raw)
                size += len(raw)
        if data:
            yield flush(ids, data)

    all_ = stored(texts.mapInArrow(cut, "id long, anchor long, cls long, first long, after long"), "stretches")
    one = F.min(F.struct("id", "first", "after")).alias("one")
    classes = all_.groupBy("anchor", "cls").agg(F.count("*").alias("n"), one)
    by_anchor = classes.groupBy("anchor").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    known = stored(classes.join(by_anchor.where("all > 1").drop("all"), "anchor"), "classes")
    # classes that hold a thousandth of all stretches are a thousand at most: they go to every task instead of one
    often = max(1, all_.count() // 1000)
    hot = known.where(F.col("n") > often).select("anchor", "cls", F.lit(True).alias("hot"))
    marked = all_.join(F.broadcast(hot), ["anchor", "cls"], "left")
    rare = marked.where("hot is null").join(known.where(F.col("n").between(2, often)).select("anchor", "cls"), ["anchor", "cls"])
    whole = marked.where("hot").unionByName(rare).select("id", "first", "after")
    return whole.unionByName(_shard_spans(texts, known.where("m > 1"), length))


def _shard_spans(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The repeats that stretches of one anchor share in part."""
    spread = F.when(F.col("m") > SPREAD, F.pmod(F.xxhash64("cls"), F.ceil(F.col("m") / SPREAD))).otherwise(F.lit(0))
    wanted = asked.select(
        F.col("one.id").alias("id"),
        F.struct("anchor", spread.alias("part"), (F.col("m") > SPREAD).alias("spread"), (F.col("n") > 1).alias("several"),
                 F.col("one.first").alias("first"), F.col("one.after").alias("after")).alias("w"),
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("anchor", "part", "spread", "several", "id", "first", "piece")}
            for i, t, ws in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw = t.as_py() or b""
                for w in ws.as_py():
                    for k in ("anchor", "part", "spread", "several", "first"):
                        out[k].append(w[k])
                    out["id"].append(i.as_py())
                    out["piece"].append(raw[w["first"] : w["after"]])
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    lists = wanted.groupBy("id").agg(F.collect_list("w").alias("ws"))
    pieces = texts.join(lists, "id").select("id", "text", "ws").mapInArrow(
        fetch, "anchor long, part long, spread boolean, several boolean, id long, first long, piece binary"
    )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[dict]) -> pa.RecordBatch:
            pieces = [r["piece"] for r in rows]
            # places of different documents don't meet: each document begins where no other ends
            docs = {d: n for n, d in enumerate(dict.fromkeys(r["id"] for r in rows))}
            ids, first = np.array([r["id"] for r in rows]), np.array([r["first"] for r in rows])
            place = np.array([docs[d] for d in ids.tolist()]) * (1 << 40) + first
            several = np.array([r["several"] for r in rows])
            piece, at, number = shard_repeats(pieces, place, several, length)
            spans = [np.empty(0, np.int64)] * 3
            hit = number >= 0
            if hit.any():
                start = np.unique(place[piece[hit]] + at[hit])
                lo, hi = _runs(start)
                name = np.array(list(docs))
                spans = [name[lo >> 40], lo & (1 << 40) - 1, (hi & (1 << 40) - 1) + length]
            # strings of spread anchors, one for each group: other shards need not know how often this one has it
            spread = np.flatnonzero(np.array([r["spread"] for r in rows])[piece]) if len(piece) else np.empty(0, np.int64)
            handed = spread[np.unique(number[spread], return_index=True)[1]]
            digests = [hashlib.blake2b(pieces[p][a : a + length], digest_size=16).digest() for p, a in zip(piece[handed].tolist(), at[handed].tolist(), strict=True)]
            k, none = len(spans[0]), len(handed)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.r_[spans[0], ids[piece[handed]]], pa.int64()), pa.array(np.r_[spans[1], first[piece[handed]] + at[handed]], pa.int64()),
                 pa.array(np.r_[spans[2], first[piece[handed]] + at[handed] + length], pa.int64()),
                 pa.array([None] * k + digests, pa.binary()), pa.array([None] * k + hit[handed].tolist(), pa.bool_())],
                names=["id", "first", "after", "digest", "hit"],
            ) if k or none else None

        rows: list[dict] = []
        size, key = 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if size > SHARD and (r["anchor"], r["part"]) != key:
                    if (found := flush(rows)) is not None:
                        yield found
                    rows, size = [], 0
                key = (r["anchor"], r["part"])
                rows.append(r)
                size += len(r["piece"])
        if rows and (found := flush(rows)) is not None:
            yield found

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small tasks stay apart
    found = stored(
        pieces.repartition(parts, "anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(
            sort, "id long, first long, after long, digest binary, hit boolean"
        ),
        "repeats",
    )
    return found.where("digest is null").select("id", "first", "after").unionByName(_merged(found.where("digest is not null")))


def _merged(handed: DataFrame) -> DataFrame:
    """Strings that their own shard has once and another shard has too. A digest comes once from each shard of its anchor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "first", "after"]

        def looked_up(digest: np.ndarray, hit: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
            shards = np.searchsorted(digest, digest, "right") - np.searchsorted(digest, digest, "left")
            chosen = spans[(shards > 1) & ~hit]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in chosen.T], names=names)

        digest, hit, spans = np.empty(0, "S16"), np.empty(0, bool), np.empty((0, 3), np.int64)
        for batch in batches:
            if batch.num_rows:
                digest = np.concatenate([digest, np.array(batch.column("digest").to_pylist(), dtype="S16")])
                hit = np.concatenate([hit, batch.column("hit").to_numpy(zero_copy_only=False)])
                spans = np.concatenate([spans, np.stack([batch.column(c).to_numpy() for c in names], axis=1)])
                cut = int(np.searchsorted(digest, digest[-1]))  # the last digest may go on in the next batch
                yield looked_up(digest[:cut], hit[:cut], spans[:cut])
                digest, hit, spans = digest[cut:], hit[cut:], spans[cut:]
        yield looked_up(digest, hit, spans)

    return handed.repartition("digest").sortWithinPartitions("digest").mapInArrow(search, "id long, first long, after long")


def _merged_runs(found: list[dict] | None) -> list[dict]:
    """Ranges merged where they overlap or touch, in order."""
    out: list[dict] = []
    for first, after in sorted((x["first"], x["after"]) for x in found or ()):
        if out and first <= out[-1]["after"]:
            out[-1]["after"] = max(out[-1]["after"], after)
        else:
            out.append({"first": first, "after": after})
    return out


def _lists(spans: DataFrame) -> DataFrame:
    return spans.groupBy("id").agg(F.collect_set(F.struct("first", "after")).alias("found"))


def _runs_of(spans: DataFrame) -> DataFrame:
    """``id, first, after`` -> ``id, found``: the merged ranges of each id."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_merged_runs(x.as_py()) for x in batch.column(1)], _SPANS)], names=["id", "found"])

    return _lists(spans).mapInArrow(merge, "id long, found array<struct<first: long, after: long>>")


def _spans_within(texts: DataFrame, passages: DataFrame, length: int) -> DataFrame:
    """``repeated_spans`` of ``length``, looked for in the runs of shorter ones alone: every place of such a string is in a run."""
    long_ones = F.filter("found", lambda s: s["after"] - s["first"] >= length)
    runs = passages.select("id", long_ones.alias("runs")).where(F.size("runs") > 0)
    cut = "substring(cast(text AS binary), cast(run.first + 1 AS int), cast(run.after - run.first AS int))"
    each = texts.join(runs, "id").select("id", "text", F.explode("runs").alias("run"))
    part = F.xxhash64("id", "run.first").alias("part")
    parts = stored(each.select(part, F.col("id").alias("doc"), F.col("run.first").alias("off"), F.expr(cut).alias("text")), "runs")
    found = repeated_spans(parts.select(F.col("part").alias("id"), "text"), length).withColumnRenamed("id", "part")
    places = parts.select("part", "doc", "off").dropDuplicates(["part"])  # rows that repeat have their runs alike
    first, after = (F.col("first") + F.col("off")).alias("first"), (F.col("after") + F.col("off")).alias("after")
    return found.join(places, "part").select(F.col("doc").alias("id"), first, after)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, passage: int | None = None
) -> DataFrame:
    """``id, n_bytes, spans`` (array of struct<first, after>, merged, in order), ``kept`` (binary) and ``kept_text`` of each
    row; with the name of a column in ``carry`` also that column, as ``row``. With a shorter length in ``passage`` also
    ``passages``: the spans of repeated strings of that length, which stay in what is kept (none: empty). In ``kept`` a cut
    may split a character, which ``kept_text`` leaves out.

    A null text is empty; texts under ``length`` bytes have no repeat. Matches never cross documents. Rows that repeat
    are copies of each other, so that their texts go. A row is known by a hash of 64 bits of its id and text together, so
    null ids and different texts under one id are told apart. Other columns are not read; an empty table gives no row.
    """
    row = [docs[carry].alias("row")] if carry else []
    rows = docs.select(F.xxhash64(docs[id_col], docs[text_col]).alias("key"), docs[id_col].alias("id"), docs[text_col].alias("text"), *row)
    texts = rows.select(F.col("key").alias("id"), "text")
    some = texts.where("text is not null")
    if passage:
        shorter = stored(_runs_of(repeated_spans(some, passage, pieces=3)), "passages")
        lists = _lists(_spans_within(some, shorter, length)).join(shorter.withColumnRenamed("found", "passages"), "id", "right")
    else:
        lists = _lists(repeated_spans(some, length))
    lists = lists.withColumnRenamed("id", "key")
    more = [*(["passages"] if passage else []), *(["row"] if carry else [])]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, merged, kept = [], [], []
            for t, found in zip(batch.column(1), batch.column(2), strict=True):
                raw, spans = (t.as_py() or "").encode(), _merged_runs(found.as_py())
                at, left = 0, []
                for x in spans:
                    left.append(raw[at : x["first"]])
                    at = x["after"]
                sizes.append(len(raw))
                merged.append(spans)
                kept.append(b"".join([*left, raw[at:]]))
            texts = [k.decode("utf-8", "ignore") for k in kept]  # a character that a cut has split goes
            made = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(merged, _SPANS), pa.array(kept, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[3:]], names=["id", "n_bytes", "spans", "kept", "kept_text", *more])

    joined = rows.join(lists, "key", "left").select("id", "text", "found", *more)
    spans_type = T.ArrayType(T.StructType().add("first", T.LongType()).add("after", T.LongType()))
    schema = T.StructType().add("id", joined.schema["id"].dataType).add("n_bytes", T.LongType()).add("spans", spans_type)
    schema = schema.add("kept", T.BinaryType()).add("kept_text", T.StringType())
    for name in more:
        schema = schema.add(name, joined.schema[name].dataType)
    done = joined.mapInArrow(take, schema)
    return done.withColumn("passages", F.coalesce("passages", F.array().cast(spans_type))) if passage else done
