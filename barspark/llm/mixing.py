"""Mixing sources to target weights by pivotal rounding of copy numbers.

Every document of a source gets the expected number of copies target / size of the source. The whole part is taken;
the fractions are rounded by a tournament: within a group of documents of a source the fractions meet one after the
other, words move from one to the other until one of the two is whole, in a random direction that keeps both
expectations, and the group's last fraction goes on to the next round. The words of a source stay constant in every
meeting, so that the sum ends within one document of the target. Groups hold a bounded number of rows at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (5, 2, 1)
#: Documents that meet in one group of the tournament.
FAN_IN = 128
LIMIT = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``source``, ``source_size``, ``target``: the whole size shared by weight, no source over ``limit`` times its size.

    The share of a unit of weight, ``level``, solves sum(min(limit * size, level * weight)) = whole size: sources in order
    of limit * size / weight reach their limit one after the other. One row a source meets here, not one a document.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    by = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), nth).cast("double"))
    by = by.withColumn("most", F.col("source_size") * F.lit(float(limit))).withColumn("at", F.col("most") / F.col("weight"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    up = Window.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.select(
        "*",
        F.sum("source_size").over(everything).alias("whole"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.sum("most").over(up).alias("below"),
        F.sum("weight").over(up).alias("weight_below"),
    )
    # the level if exactly the sources up to this one are at their limit
    open_weight = F.col("all_weight") - F.col("weight_below")
    by = by.withColumn("filled", F.col("below") + F.col("at") * open_weight <= F.col("whole"))
    level = (F.col("whole") - F.sum(F.when(F.col("filled"), F.col("most")).otherwise(0.0)).over(everything)) / F.nullif(
        F.sum(F.when(F.col("filled"), F.lit(0.0)).otherwise(F.col("weight"))).over(everything), F.lit(0.0)
    )
    target = F.when(F.col("filled"), F.col("most")).otherwise(F.least("most", level * F.col("weight")))
    return by.select("source", "source_size", target.alias("target"))


def _meet(acc: Column, x: Column) -> Column:
    """The fraction that goes on meets the next one: its place, size and share, and who is whole by now."""
    a, b = acc["open"], x
    # words that can go from a to b, and from b to a
    ab = F.least(a["size"] * a["part"], b["size"] * (1 - b["part"]))
    ba = F.least(b["size"] * b["part"], a["size"] * (1 - a["part"]))
    draw = F.pmod(F.xxhash64(a["key"], b["key"], F.lit("pivot")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    forth = draw * (ab + ba) < ba
    moved = F.when(forth, ab).otherwise(-ba)
    pa = F.when(forth & (ab == a["size"] * a["part"]), 0.0).when(~forth & (ba == a["size"] * (1 - a["part"])), 1.0)
    pb = F.when(forth & (ab == b["size"] * (1 - b["part"])), 1.0).when(~forth & (ba == b["size"] * b["part"]), 0.0)
    pa = F.coalesce(pa, a["part"] - moved / a["size"])
    pb = F.coalesce(pb, b["part"] + moved / b["size"])
    both = F.array(
        F.struct(a["key"].alias("key"), a["size"].alias("size"), pa.alias("part")),
        F.struct(b["key"].alias("key"), b["size"].alias("size"), pb.alias("part")),
    )

    def settled(two: Column) -> Column:
        whole = lambda y: (y["part"] <= 0.0) | (y["part"] >= 1.0)
        rest = F.filter(two, lambda y: ~whole(y))
        done = F.concat(acc["done"], F.filter(two, whole))
        return F.struct(F.get(rest, 0).alias("open"), done.alias("done"))

    return F.when(a.isNull(), F.struct(b.alias("open"), acc["done"].alias("done"))).otherwise(
        F.element_at(F.transform(F.array(both), settled), 1)
    )


ENTRY = "struct<key:struct<id:bigint,size:bigint,nth:bigint>,size:double,part:double>"


def round_parts(parts: DataFrame, fan_in: int, rows: int) -> DataFrame:
    """``source, key, size, part`` with part strictly between 0 and 1 -> ``source, key, up`` (0 or 1 more copies)."""
    entry = F.struct("key", "size", "part").cast(ENTRY)
    settled, level, left = None, 0, rows
    while True:
        last = left <= fan_in
        groups = max(1, -(-left // (fan_in // 2)))
        room = F.lit(0) if last else F.pmod(F.xxhash64("key", F.lit(level)), F.lit(groups))
        group = parts.groupBy("source", room.alias("room")).agg(F.array_sort(F.collect_list(entry)).alias("all"))
        start = F.struct(F.lit(None).cast(ENTRY).alias("open"), F.array().cast(f"array<{ENTRY}>").alias("done"))
        fold = group.select("source", F.aggregate("all", start, _meet).alias("r"))
        whole = fold.select("source", F.explode("r.done").alias("x"))
        open_ = fold.where("r.open is not null").select("source", "r.open.key", "r.open.size", "r.open.part")
        here = whole.select("source", F.col("x.key").alias("key"), (F.col("x.part") >= 1.0).alias("up"))
        if last:  # one fraction a source remains: it is drawn by itself
            draw = F.pmod(F.xxhash64("key", F.lit("last")), F.lit(1 << 53)) / F.lit(float(1 << 53))
            here = here.unionByName(open_.select("source", "key", (draw < F.col("part")).alias("up")))
        settled = here if settled is None else settled.unionByName(here)
        if last:
            return settled
        parts, left, level = open_, groups, level + 1


def size_of(text: Column) -> Column:
    """Words of a text; none of a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    limit: int = LIMIT,
    fan_in: int = FAN_IN,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row for each row of ``docs``: id, source, size (words), source_size, target, copies.

    Null and blank texts have size 0, no copies, and don't count. A null source is a source, the last. Rows that
    repeat are told apart by their number among equal ids, so each gets copies of its own; other columns are not read;
    an empty table gives no row. The same input gives the same copies, however it is partitioned.
    """
    sized = docs.select(
        docs[id_col].cast("long").alias("id"),
        docs[source_col].alias("source"),
        size_of(docs[text_col]).alias("size"),
    )
    # equal rows are one row with their number: no key depends on the order of the input
    sized = stored(sized.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    targets = source_targets(sized.select("source", (F.col("size") * F.col("n")).alias("size")), weights, limit)
    by_source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("skey")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit))))
    copied = sized.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    joined = (
        copied.select("*", by_source)
        .join(targets.select(by_source, "source_size", "target"), "skey")
        .withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        .withColumn("whole", F.floor("rate"))
        .withColumn("part", F.col("rate") - F.col("whole"))
        .withColumn("key", F.struct(F.coalesce("id", F.lit(-(1 << 62))).alias("id"), "size", "nth"))
    )
    parts = joined.where("part > 0 and size > 0").select("source", "key", F.col("size").cast("double").alias("size"), "part")
    ups = round_parts(parts, fan_in, copied.count()).select(by_source, "key", "up")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.coalesce(F.col("up").cast("int"), F.lit(0)))
    return joined.join(ups, ["skey", "key"], "left").select(
        "id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")
    )
