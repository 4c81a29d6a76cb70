"""Class balancing, stratified trims and splits in an order fixed by a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.scans import meet
from eventlens.schema import NORMAL


def shuffled(key: str, seed: int) -> list[Column]:
    """An order by the MD5 of seed and key, ties by the key: the same in any SQL engine."""
    return [F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), "UTF-8")), F.col(key)]


def upper_median(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: the element at size div 2 of the sorted counts (one per class), 0 if there are none."""
    packed = counts.agg(F.array_sort(F.collect_list(n)).alias("a"))
    return packed.select(F.coalesce(F.get("a", F.floor(F.size("a") / 2).cast("int")), F.lit(0)).cast("bigint").alias("cap"))


#: Hex digits of the hash a level of counts looks at; rows that are ranked by sorting, about, at most.
DIGITS, CELL = 3, 256


def cuts(rows: DataFrame, group: list[str], key: str, seed: int, quota: DataFrame, largest: int) -> DataFrame:
    """group, cut: the (hash, key) of each group's quota-th row in shuffled order; compare rows with it.

    quota: group, quota (1 to the group's rows), one row a group. largest: rows of the largest group. Rows are counted by the first digits of their
    hash; a running sum of these few counts finds the cell with the cut, whose rows alone are counted by further digits. What is left in the last cell,
    some CELL rows a group at most, is ranked; smaller groups are ranked at once. So no group is sorted or gathered, and what is shuffled are counts.
    """
    order = shuffled(key, seed)
    r = rows.select(*group, F.col(key).alias("_k"), order[0].alias("_h"))
    state = quota.select(*group, F.lit("").alias("_prefix"), F.col("quota").cast("bigint").alias("_left"))
    level = 0
    while largest > CELL * 16 ** (DIGITS * level):
        level += 1
        inside = r if level == 1 else meet(r, state.drop("_left"), group).where(F.startswith("_h", "_prefix")).drop("_prefix")
        counts = inside.groupBy(*group, F.substring("_h", 1, DIGITS * level).alias("_next")).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*group).orderBy("_next")))
        state = meet(counts, state.drop("_prefix"), group).where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
        state = state.select(*group, F.col("_next").alias("_prefix"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"))
    cell = meet(r, state, group).where(F.startswith("_h", "_prefix"))
    ranked = cell.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("_h", "_k")))
    return ranked.where("_rank = _left").select(*group, F.struct("_h", "_k").alias("cut"))


def upto(rows: DataFrame, group: list[str], key: str, seed: int, found: DataFrame, name: str) -> DataFrame:
    """rows with `name`: whether they are at or before their group's cut; false in groups without one."""
    each = meet(rows, found, group, "left")
    own = F.struct(shuffled(key, seed)[0].alias("_h"), F.col(key).alias("_k"))
    return each.withColumn(name, F.coalesce(own <= F.col("cut"), F.lit(False))).drop("cut")


def balance(windows: DataFrame, key: str, seed: int = 0, ratio: float = 1.5, cap: int | None = None, cls: str = "class_name") -> DataFrame:
    """At most cap rows of each anomaly class (default: the upper median of their sizes), and ratio normals for each row kept.

    key is unique; rows that share one stay or go together. Quotas come from one row a class, and rows are compared with their class's cut.
    """
    counts = windows.groupBy(F.col(cls).alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["_c"]: r.n for r in counts.collect()}
    events = sorted(n for c, n in sizes.items() if c is not None and c != NORMAL)
    if cap is None:
        cap = events[len(events) // 2] if events else 0
    normals = int(sum(min(n, cap) for n in events) * ratio)
    quotas = [(c, min(n, normals if c == NORMAL else cap)) for c, n in sizes.items() if c is not None]
    quota = windows.sparkSession.createDataFrame([q for q in quotas if q[1] > 0], "_c string, quota long")
    rows = windows.withColumn("_c", F.col(cls))
    found = cuts(rows, ["_c"], key, seed, quota, max(sizes.values(), default=0))
    return upto(rows, ["_c"], key, seed, found, "_in").where("_in").drop("_c", "_in")


def stratified(windows: DataFrame, key: str, limit: int, seed: int = 0, cls: str = "class_name") -> DataFrame:
    """About limit rows in the proportions of the classes, one at least of each, cut to limit in shuffled order."""
    counts = windows.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    quota = counts.select(F.col(cls).alias("_c"), F.greatest(F.lit(1), F.bround(limit * F.col("n") / total, 0)).cast("int").alias("_quota"))
    rank = F.row_number().over(Window.partitionBy(cls).orderBy(*shuffled(key, seed)))
    ranked = windows.withColumn("_rank", rank).where(F.col("_rank") <= limit + 1)
    kept = ranked.join(F.broadcast(quota), F.col(cls) == F.col("_c")).where("_rank <= _quota").drop("_c", "_quota", "_rank")
    return kept.orderBy(*shuffled(key, seed)).limit(limit)


def holdout(rows: DataFrame, key: str, share: float = 0.3, seed: int = 0, by: list[Column] | None = None) -> DataFrame:
    """rows with held_out: the first floor(n * share) keys of each group in shuffled order.

    The group's cut is the hash (and key) of its last held-out key, found among distinct keys by counts; rows are then compared with it.
    """
    group = F.concat_ws("|", *by) if by else F.lit("")
    tagged = rows.withColumn("_g", group)
    keys = tagged.select("_g", key).distinct()
    quota = keys.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    largest = quota.agg(F.max("n")).first()[0] or 0
    quota = quota.select("_g", F.floor(F.col("n") * share).alias("quota")).where("quota > 0")
    return upto(tagged, ["_g"], key, seed, cuts(keys, ["_g"], key, seed, quota, largest), "held_out").select(*rows.columns, "held_out")


def quota_flags(ids: DataFrame, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """ids with pure: the first floor(n * share) in shuffled order get no events."""
    return holdout(ids, key, share, seed).withColumnRenamed("held_out", "pure")
