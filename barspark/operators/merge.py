"""Merges of stored and new rows as functions of DataFrames; applying one twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last in the given order. Partial on the map side, whatever the key's frequency."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return best.select(*key, *[F.col("v").getField(c).alias(c) for c in rest])


def last_writer_wins(old: DataFrame, new: DataFrame, key: list[str], order: str, place: str) -> DataFrame:
    """By batch (``order``), and within one by the row's ``place`` in it, so that rows of one batch and key give the same however
    they are partitioned."""
    return latest(old.unionByName(new), key, [F.col(order), F.col(place)])


def keep_old_where_missing(old: DataFrame, new: DataFrame, key: list[str], fixed: tuple[str, ...] = ()) -> DataFrame:
    """New values, old ones where the new is null; ``fixed`` columns never change once there."""
    columns = [c for c in old.columns if c not in key]
    o = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in columns])
    both = o.join(new.select(*key, *columns), key, "full_outer")
    pick = [F.coalesce(*([f"old_{c}", c] if c in fixed else [c, f"old_{c}"])).alias(c) for c in columns]
    return both.select(*key, *pick)


def final_over_prelim(rows: DataFrame, key: list[str], place: str) -> DataFrame:
    """A final row is never replaced by a preliminary one; of one kind the newer batch wins, and in a batch the later ``place``."""
    return latest(rows, key, [F.col("kind") == "final", F.col("batch"), F.col(place)])


def balance_outcomes(kept: DataFrame, batch: DataFrame, registered: DataFrame) -> DataFrame:
    """What a batch of balances does for each registered symbol: its row with ``outcome`` saved, skipped (it is preliminary and a
    final one is kept for its day) or missing (the batch has no row).

    ``kept``: symbol, date, kind and others; ``batch``: code, ``place`` and the columns of ``kept`` but the symbol, of a code the row of
    the last place counts; ``registered``: symbol, code, a row a symbol.
    """
    last = latest(batch, ["code"], [F.col("place")])
    had = kept.select("symbol", "date", F.col("kind").alias("_had"))
    asked = registered.select("symbol", "code").join(last.withColumn("_there", F.lit(True)), "code", "left").join(had, ["symbol", "date"], "left")
    over = (F.col("_had") == "final") & (F.col("kind") != "final")
    outcome = F.when(F.col("_there").isNull(), "missing").when(over, "skipped").otherwise("saved")
    return asked.withColumn("outcome", outcome).drop("_there", "_had", "place")


def save_balances(kept: DataFrame, batch: DataFrame, registered: DataFrame, counts: Observation) -> DataFrame:
    """``kept`` after the batch; ``counts`` has saved, skipped and missing once the result was computed, by the same pass."""
    counted = [F.count_if(F.col("outcome") == k).alias(k) for k in ("saved", "skipped", "missing")]
    judged = balance_outcomes(kept, batch, registered).observe(counts, *counted)
    saved = judged.select(*kept.columns, "outcome")
    both = kept.withColumn("outcome", F.lit("kept")).unionByName(saved)
    # only a saved row replaces; a skipped one and that of a missing symbol have no say, but are counted on their way here
    best = latest(both.withColumn("_rank", F.when(F.col("outcome") == "saved", 1).otherwise(0)), ["symbol", "date"], [F.col("outcome").isin("kept", "saved"), F.col("_rank")])
    return best.where(F.col("outcome").isin("kept", "saved")).select(*kept.columns)


def replace_linked(old: DataFrame, new: DataFrame, links: DataFrame, key: str, place: str) -> DataFrame:
    """Rows whose key has a link are taken over whole, whatever was there; new rows without a link are dropped. Of several new rows of
    a key the last ``place`` counts."""
    linked = latest(new.join(links.select(key).distinct(), key, "left_semi"), [key], [F.col(place)])
    return old.join(linked.select(key), key, "left_anti").unionByName(linked.select(*old.columns))


def replace_suffix(old: DataFrame, new: DataFrame, group: str, date: str) -> DataFrame:
    """From the first new date of a group on, only new rows; groups without new rows stay."""
    start = new.groupBy(group).agg(F.min(date).alias("from_date"))
    kept = old.join(start, group, "left").where(F.col("from_date").isNull() | (F.col(date) < F.col("from_date"))).drop("from_date")
    return kept.unionByName(new)


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Groups with new rows have only those; the others stay."""
    return old.join(new.select(group).distinct(), group, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key is not there; of several new ones of a key the first by all columns."""
    fresh = new.join(old.select(*key).distinct(), key, "left_anti")
    rest = [c for c in fresh.columns if c not in key]
    one = fresh.groupBy(*key).agg(F.min(F.struct(*rest)).alias("v")).select(*key, "v.*")
    return old.unionByName(one.select(*old.columns))


def withdrawals(docs: DataFrame, stubs: DataFrame) -> DataFrame:
    """Documents with the state of the last stub that names them or follows from them, none before their own day, and
    whether it changed."""
    named = stubs.select(F.explode(F.array_distinct(F.array("doc_id", "parent"))).alias("doc_id"), "status", "date", F.col("doc_id").alias("stub"))
    known = docs.select("doc_id", F.to_date("submit_at").alias("day"))
    last = named.join(known, "doc_id").where("date >= day").groupBy("doc_id").agg(F.max_by("status", F.struct("date", "stub")).alias("status"))
    out = docs.join(last, "doc_id", "left")
    changed = F.col("status").isNotNull() & ~F.col("status").eqNullSafe(F.col("withdrawal"))
    return out.withColumn("changed", changed).withColumn("withdrawal", F.coalesce("status", "withdrawal")).drop("status")


def without_orphans(rows: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(parents.select(*on).distinct(), on, "left_semi")


def orphans(rows: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(parents.select(*on).distinct(), on, "left_anti")


def needs_reload(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``symbol, reload``: a later bar with a split asks for the whole history, otherwise a merge will do."""
    last = stored.groupBy("symbol").agg(F.max("date").alias("last"))
    split = (F.col("date") > F.col("last")) & (F.coalesce(F.nanvl("splits", F.lit(0.0)), F.lit(0.0)) != 0)
    return fresh.join(last, "symbol").groupBy("symbol").agg(F.bool_or(split).alias("reload"))
