"""Nearest neighbours through an inverted multi-index.

Both halves of the vectors are quantised by centroids of their own; a pair of centroids is a cell. A query takes cells in
order of the summed distance of its halves, from a heap that holds the next pair of every row begun, until the cells hold
a share of all rows; what they hold is ranked by the exact distance. The share is measured on a sample, whose neighbours
are known. Cells are dealt out to blocks of bounded size; a row goes to one block, a query to the blocks of its cells, and a
task holds one block's rows while that block's queries pass by.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class MultiIndex:
    """``sample``: vectors that the centroids are fitted to; ``centroids`` of each half; ``share`` of the rows that a query looks
    at, measured where it is None: so many that ``recall`` of the neighbours in the sample are among them, for ``probes`` of its
    vectors, with ``errors`` standard errors of such a measurement added, so that few probes ask for more. ``block``: rows of
    one, about."""

    sample: int = 8192
    centroids: int = 128
    rounds: int = 12
    share: float | None = None
    recall: float = 0.95
    probes: int = 256
    errors: float = 2.0
    block: int = 20000
    nearest: int = 10


def fit(half: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means; no more centroids than different vectors. An empty one stays where it is."""
    points = np.unique(half, axis=0)
    centroids = points[np.random.default_rng(seed).choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        nearest = closest(half, centroids)
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, half)
        count = np.bincount(nearest, minlength=len(centroids))
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def _apart(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * points @ centroids.T


def closest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([_apart(points[i : i + 4096], centroids).argmin(1) for i in range(0, len(points), 4096)] or [np.empty(0, np.int64)])


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells (row * columns + column) in order of first[row] + second[column] until they hold ``enough`` rows."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, found, held = [(first[rows[0]] + second[columns[0]], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(rows[i] * len(second) + columns[j])
        if counts[cell]:
            found.append(cell)
            held += int(counts[cell])
        if j + 1 < len(second):
            heapq.heappush(heap, (first[rows[i]] + second[columns[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (first[rows[i + 1]] + second[columns[0]], i + 1, 0))
    return found


def measured_share(sample: np.ndarray, halves: list[np.ndarray], index: MultiIndex) -> float:
    """The share of the sample that must be looked at so that ``recall`` of the probes' neighbours in it are, and as many more as
    ``errors`` standard errors of so many probes are. A larger table has nearer neighbours than its sample, in nearer cells, so
    that this share is enough there."""
    if len(sample) < 2:
        return 1.0
    middle, columns, probes = len(halves[0][0]), len(halves[1]), min(index.probes, len(sample))
    wanted = min(1.0, index.recall + index.errors * (index.recall * (1 - index.recall) / probes) ** 0.5)
    cell = closest(sample[:, :middle], halves[0]) * columns + closest(sample[:, middle:], halves[1])
    counts, needed = np.bincount(cell, minlength=len(halves[0]) * columns), []
    for p in np.linspace(0, len(sample) - 1, probes).astype(int):
        far = ((sample - sample[p]) ** 2).sum(1)
        far[p] = np.inf
        near = np.argsort(far, kind="stable")[: min(index.nearest, len(sample) - 1)]
        v = sample[p : p + 1]
        order = np.argsort((_apart(v[:, :middle], halves[0])[0][:, None] + _apart(v[:, middle:], halves[1])[0]).ravel(), kind="stable")
        upto = np.empty(len(order), np.int64)
        upto[order] = np.cumsum(counts[order])
        needed.append(upto[cell[near]])
    return float(np.quantile(np.concatenate(needed), wanted, method="higher") / len(sample))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: without null, zero or non-finite vectors and null components; of the most frequent length."""
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & F.col("id").isNotNull() & (F.size(v) > 0)).where(finite & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (lengths["n"] if lengths else 0))


def blocks_of(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each cell and over how many it is dealt: cells next to each other fill one, a larger cell several."""
    first, parts, last, room = np.full(len(counts), -1), np.ones(len(counts), np.int64), -1, 0
    for cell in np.flatnonzero(counts):
        n = int(counts[cell])
        if n > block:
            parts[cell], first[cell] = -(-n // block), last + 1
            last, room = last + int(parts[cell]), 0
        else:
            if room < n:
                last, room = last + 1, block
            first[cell], room = last, room - n
    return first, parts


def _part(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which of a cell's blocks a row goes to, by a hash of its id."""
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def search(
    vectors: DataFrame, every: int = 100, index: MultiIndex = MultiIndex(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``: their nearest others found, all others
    if there are fewer.

    Ties go to the smaller id. Equal vectors are equally near, so the index holds no more of them than can be among the
    nearest. Rows that repeat an id count once, with the least of their vectors. Vectors that are not usable() take no part; no usable vector: no row.
    """
    spark: SparkSession = vectors.sparkSession
    good = usable(vectors, id_col, vector_col)
    sample = good.orderBy(F.xxhash64("id")).limit(index.sample).select("v").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = np.stack(sample["v"].to_numpy())
    middle = max(1, fitted.shape[1] // 2)
    halves = [fit(fitted[:, :middle], index.centroids, index.rounds, 1)]
    halves.append(fit(fitted[:, middle:], index.centroids, index.rounds, 2) if fitted.shape[1] > 1 else np.zeros((1, 0)))
    shared = spark.sparkContext.broadcast(halves)  # two tables of at most ``centroids`` rows
    columns = len(halves[1])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = shared.value
        for batch in batches:
            if len(batch):
                v = np.stack(batch["v"].to_numpy())
                yield batch.assign(cell=closest(v[:, :middle], one) * columns + closest(v[:, middle:], two))

    few = Window.partitionBy("v").orderBy("id")
    distinct = good.select("id", "v").groupBy("id").agg(F.min("v").alias("v"))
    held = distinct.withColumn("n", F.row_number().over(few)).where(F.col("n") <= index.nearest + 1).select("id", "v")
    placed = stored(held.mapInPandas(place, "id long, v array<double>, cell long"), "cells")
    counts = np.zeros(len(halves[0]) * columns, np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        counts[r.cell] = r["count"]
    share = measured_share(fitted, halves, index) if index.share is None else index.share
    enough = max(int(np.ceil(share * counts.sum())), index.nearest + 1)  # beside the query itself, as many as are asked for
    plan = spark.sparkContext.broadcast((counts, *blocks_of(counts, index.block)))  # as many numbers as there are cells

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, first, parts = plan.value
        for batch in batches:
            cell, ids = batch["cell"].to_numpy(), batch["id"].to_numpy()
            yield batch.assign(block=first[cell] + _part(ids, parts[cell]), asks=False, cells=[[]] * len(batch))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = shared.value
        counts, first, parts = plan.value
        for batch in batches:
            for qid, v in zip(batch["id"], batch["v"], strict=True):
                cells = np.sort(traverse(_apart(v[None, :middle], one)[0], _apart(v[None, middle:], two)[0], counts, enough))
                to = np.repeat(first[cells], parts[cells]) + np.arange(parts[cells].sum()) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                order = np.argsort(to, kind="stable")
                blocks, at = np.unique(to[order], return_index=True)
                lists = np.split(np.repeat(cells, parts[cells])[order], at[1:])
                yield pd.DataFrame({"id": qid, "v": [v] * len(blocks), "cell": -1, "block": blocks, "asks": True, "cells": lists})

    def nearest(rows: tuple[np.ndarray, ...], asked: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x, cell, ids = rows
        for qid, v, cells in zip(asked["id"], asked["v"], asked["cells"], strict=True):
            lo, hi = np.searchsorted(cell, cells, "left"), np.searchsorted(cell, cells, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = at[ids[at] != qid]
            far = np.sqrt(((x[at] - v) ** 2).sum(1))
            if len(at) > 4 * index.nearest:  # ties at the edge stay in
                near = far <= np.partition(far, index.nearest)[index.nearest]
                at, far = at[near], far[near]
            best = np.lexsort((ids[at], far))[: index.nearest]
            yield pd.DataFrame({"query_id": qid, "vec_id": ids[at[best]], "score": far[best]})

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's rows come first, in order of cell, then its queries, however many."""
        block, held, rows = None, [], None
        for batch in batches:
            out = []
            for b, group in batch.groupby("block", sort=False):
                if b != block:
                    block, held, rows = b, [], None
                own, asked = group[~group["asks"]], group[group["asks"]]
                if len(own):
                    held.append((np.stack(own["v"].to_numpy()), own["cell"].to_numpy(), own["id"].to_numpy()))
                if len(asked) and held:
                    rows = rows or tuple(np.concatenate(c) for c in zip(*held, strict=True))
                    out += nearest(rows, asked)
            yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    schema = "id long, v array<double>, cell long, block long, asks boolean, cells array<long>"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that blocks stay apart, and queries, which cost far more than their bytes
    asked = good.select("id", "v").where(F.col("id") % every == 0).repartition(parts, "id").groupBy("id").agg(F.min("v").alias("v"))
    both = placed.mapInPandas(deal, schema).unionByName(asked.mapInPandas(ask, schema))
    dealt = both.repartition(parts, "block").sortWithinPartitions("block", "asks", "cell", "id")
    found = dealt.mapInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= index.nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")
