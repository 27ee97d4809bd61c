"""Quality by a sparse ensemble of rules over text statistics.

Small trees are boosted on a bounded labelled sample; every path from a root is a rule, a conjunction of bounds on
statistics. A logistic model with lasso weights chooses among the rules; what is left is one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of


@dataclass(frozen=True)
class Fit:
    """``rows`` of the labelled sample, at most; trees and their depth; bounds tried for a statistic; lasso penalty."""

    rows: int = 8000
    trees: int = 24
    depth: int = 3
    bounds: int = 24
    rate: float = 0.3
    penalty: float = 0.002
    rounds: int = 400


@dataclass(frozen=True)
class Rules:
    """``terms``: (weight, ((statistic, above, bound), ...)); the score is the logistic of bias and weights that hold."""

    bias: float
    terms: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]


def statistics(text: Column) -> dict[str, Column]:
    """All are numbers, 0 for null and empty texts."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / chars

    return {
        "chars": F.length(t).cast("double"),
        "marks": share(r"[#*$%&<>=~^_{}\\]"),
        "bars": share(r"\|"),
        "bangs": share("!"),
        "capitals": share(r"[A-ZÀ-ÖØ-Þ]"),
        "digits": share("[0-9]"),
        "stops": share("[.,;:?]"),
        "lines": share("\n"),
    }


def word_statistics(text: Column) -> Column:
    """Words, and the share of different ones."""
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("double").alias("words"),
            (F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))).alias("distinct"),
        ),
    )


NAMES = ("chars", "marks", "bars", "bangs", "capitals", "digits", "stops", "lines", "words", "distinct", "length")


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the statistics of each row."""
    text = docs[text_col]
    first = docs.select(docs[id_col].alias("id"), *[c.alias(n) for n, c in statistics(text).items()], word_statistics(text).alias("w"))
    flat = first.select("*", "w.words", "w.distinct").drop("w")
    return flat.withColumn("length", F.col("chars") / F.greatest(F.col("words"), F.lit(1.0)))


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, depth: int, path: tuple, rows: np.ndarray, out: list, values: np.ndarray) -> None:
    """A regression tree on the residuals ``g``; adds every path to ``out`` and the leaves' means to ``values``."""
    if path:
        out.append(path)
    best = (1e-9, -1, -1)
    if depth and len(rows) >= 20:
        total, n = g[rows].sum(), len(rows)
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            b = bins[rows, f]
            s = np.bincount(b, g[rows], len(edge) + 1).cumsum()[:-1]
            c = np.bincount(b, minlength=len(edge) + 1).cumsum()[:-1]
            ok = (c >= 10) & (n - c >= 10)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total**2 / n, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
    if best[1] < 0:
        values[rows] = g[rows].mean() if len(rows) else 0.0
        return
    _, f, k = best
    above = bins[rows, f] > k
    for side in (False, True):
        _grow(x, bins, edges, g, depth - 1, (*path, (f, side, float(edges[f][k]))), rows[above == side], out, values)


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    held = np.ones(len(x), bool)
    for f, above, bound in path:
        held &= (x[:, f] > bound) if above else (x[:, f] <= bound)
    return held


def fit(x: np.ndarray, y: np.ndarray, how: Fit = Fit()) -> Rules:
    """``x``: statistics in the order of NAMES; ``y``: 0 or 1. Without labels of both kinds the score is their share."""
    if not len(y) or y.min() == y.max():
        share = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.5
        return Rules(float(np.log(share / (1 - share))), ())
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, how.bounds + 2)[1:-1], method="lower")) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T, strict=True)]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-margin))
        values = np.zeros(len(y))
        _grow(x, bins, edges, y - p, how.depth, (), np.arange(len(y)), paths, values)
        margin += how.rate * 4 * values
    paths = list(dict.fromkeys(tuple(sorted(p)) for p in paths))
    rules = np.stack([_holds(x, p) for p in paths], axis=1).astype(np.float64) if paths else np.zeros((len(y), 0))
    # lasso by accelerated proximal steps; the bias is not penalised
    w, b = np.zeros(rules.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, vb, t = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(rules, 2) ** 2 / len(y) + 1.0)
    for _ in range(how.rounds):
        p = 1 / (1 + np.exp(-(rules @ v + vb)))
        to = v - step * (rules.T @ (p - y) / len(y))
        new, nb = np.sign(to) * np.maximum(np.abs(to) - step * how.penalty, 0), vb - step * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return Rules(b, tuple((float(w[i]), tuple((NAMES[f], a, c) for f, a, c in paths[i])) for i in np.flatnonzero(w)))


def score(rules: Rules) -> Column:
    """The ensemble as an expression over the columns of described()."""

    def holds(path: tuple[tuple[str, bool, float], ...]) -> Column:
        out = F.lit(True)
        for name, above, bound in path:
            out = out & ((F.col(name) > bound) if above else (F.col(name) <= bound))
        return out

    total = F.lit(rules.bias)
    for weight, path in rules.terms:
        total = total + F.when(holds(path), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, how: Fit = Fit(), id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> Rules:
    """From the labelled rows with the least hash of their id among those allowed; at most ``how.rows`` reach the driver, also
    where ids repeat. Other columns of either table are not read."""
    known = labels.where(allowed & labels[label_col].isNotNull() & labels[id_col].isNotNull()).select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "y").limit(how.rows)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
    few = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "y", F.xxhash64("text")).limit(how.rows)
    rows = described(few.select(F.struct("id", "y").alias("k"), "text"), "k").orderBy("id").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(NAMES))), np.zeros(0), how)
    y = np.array([k["y"] if isinstance(k, dict) else k[1] for k in rows["id"]])
    return fit(rows[list(NAMES)].to_numpy(np.float64), y, how)


def score_of(rules: Rules, x: np.ndarray) -> np.ndarray:
    """The score of statistics in the order of NAMES, as score() gives it in a query."""
    total = np.full(len(x), rules.bias)
    for weight, path in rules.terms:
        total += weight * _holds(x, tuple((NAMES.index(name), above, bound) for name, above, bound in path))
    return 1 / (1 + np.exp(-total))
