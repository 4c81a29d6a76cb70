"""Enrichment, range and membership joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.intervals import iou, overlap
from eventlens.operators.lineage import cut
from eventlens.operators.scans import running


def enrich(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a key that is unique on the right and known for every row; otherwise ValueError.

    Both checks are aggregates and an anti join; at most ten offending keys reach the driver.
    """
    twice = [r[0] for r in right.groupBy(key).count().where("count > 1").select(key).limit(10).collect()]
    if twice:
        raise ValueError(f"{key} isn't unique on the right: {twice}")
    lost = [r[0] for r in left.join(right, key, "left_anti").select(key).distinct().limit(10).collect()]
    if lost:
        raise ValueError(f"{key} unknown on the right: {lost}")
    return left.join(right, key, "left")


def overlap_join(left: DataFrame, right: DataFrame, key: str, l: tuple[str, str], r: tuple[str, str], how: str = "left", bin_sec: float | None = None) -> DataFrame:
    """Pairs with a common key and a common part of positive length.

    bin_sec: cut both sides into time bins and join on (key, bin), so one key with very many intervals is dealt out;
    a pair is kept in the first bin it shares.
    """
    # Both sides keep their columns; names on the right must differ from those on the left, but for the key.
    right = right.withColumnRenamed(key, "_key")
    cond = F.col(key) == F.col("_key")
    touch = overlap(F.col(l[0]), F.col(l[1]), F.col(r[0]), F.col(r[1])) > 0
    if bin_sec is None:
        return left.join(right, cond & touch, how).drop("_key")

    def bins(s: str, e: str):
        first = F.floor(F.col(s) / bin_sec)
        return F.explode_outer(F.sequence(first, F.greatest(first, F.ceil(F.col(e) / bin_sec) - 1)))

    # Numbered rows are written before they meet anything, as a task that is run again may number them otherwise.
    a = left if how == "inner" else cut(left.withColumn("_row", F.monotonically_increasing_id()))
    a = a.withColumn("_bin", bins(*l))
    b = right.withColumn("_bin2", bins(*r))
    first = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / bin_sec) == F.col("_bin")
    hits = a.join(b, cond & (F.col("_bin") == F.col("_bin2")) & touch & first).drop("_key", "_bin", "_bin2")
    if how == "inner":
        return hits
    rest = a.drop("_bin").dropDuplicates(["_row"]).join(hits.select("_row").distinct(), "_row", "left_anti")
    return hits.unionByName(rest, allowMissingColumns=True).drop("_row")


def similar_pairs(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], least: float) -> DataFrame:
    """Pairs with common keys whose common part is `least` (above 0) of their hull or more, with iou. Other names must differ.

    Such intervals are of like length, within a factor of 1 / least. Time is cut into cells of every power of two; a left interval lies in the few cells of its own
    length, a right one in those of all lengths it can meet. So the join is on equal keys and cells, and one key with very many intervals is dealt out by
    time; a pair is kept in the first cell it shares.
    """
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}

    def cells(df: DataFrame, s: str, e: str, reach: int, level: str, cell: str, first: str) -> DataFrame:
        own = F.floor(F.log2(F.col(e) - F.col(s))).cast("int")
        df = df.where(F.col(e) > F.col(s)).withColumn(level, F.explode(F.sequence(own - reach, own + reach)))
        width = F.pow(F.lit(2.0), F.col(level))
        return df.withColumn(first, F.floor(F.col(s) / width)).withColumn(cell, F.explode(F.sequence(F.col(first), F.floor(F.col(e) / width))))

    reach = math.ceil(math.log2(1 / least) + 1e-9)
    a = cells(left, *l, 0, "_level", "_cell", "_first")
    b = cells(right.withColumnsRenamed(names), *r, reach, "_level2", "_cell2", "_first2")
    same = reduce(Column.__and__, (F.col(k) == F.col(n) for k, n in names.items()))
    size = iou(F.col(l[0]), F.col(l[1]), F.col(r[0]), F.col(r[1]))
    hits = a.join(b, same & (F.col("_level") == F.col("_level2")) & (F.col("_cell") == F.col("_cell2")) & (F.greatest("_first", "_first2") == F.col("_cell")) & (size >= least))
    return hits.withColumn("iou", size).drop(*names.values(), "_level", "_level2", "_cell", "_cell2", "_first", "_first2")


def point_in_interval(points: DataFrame, segments: DataFrame, key: str, t: str, width: float | None = None) -> DataFrame:
    """Of segments (key, start, end, source_start, source_path): each point's first segment with start <= t < end, or null.

    First is the least start, then the least end, then source. Adds seg_path and seg_offset (where in the source the point lies).

    Segments may overlap. In that order only one that ends later than all before it is ever the first to hold a point, and the one that holds it is the one of least
    end after it. So a scan over the segments keeps those, and a scan backwards over ends and points in one order carries the next end to each point.
    No pair of a point and a segment is made, and no row needs a number. width: of a range, for keys too long for one task (scans.running).
    """
    names = points.columns
    whole = F.struct(*names)
    kept = segments.where(F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    seg = kept.select(F.col(key).alias("_key"), F.col("start").cast("double").alias("_s"), F.col("end").cast("double").alias("_e"), F.struct("source_path", "source_start").alias("_from"))
    seg = seg.withColumn("_path", F.struct("_from"))
    records = running(seg, ["_key"], ["_s", "_e", "_path"], "_e", "_most", how="max", current=False, width=width)
    records = records.where(F.col("_most").isNull() | (F.col("_e") > F.col("_most"))).where("_e > _s")
    none = F.lit(None)
    hit = F.struct("_s", "_from")
    ends = records.select("_key", (-F.col("_e")).alias("_at"), F.lit(1).alias("_kind"), hit.alias("_seg"), none.cast(points.select(whole.alias("p")).schema["p"].dataType).alias("_p"))
    # A point comes before the end at its time: a segment doesn't hold its own end.
    asked = points.select(F.col(key).alias("_key"), (-F.coalesce(F.col(t).cast("double"), F.lit(0.0))).alias("_at"), F.lit(0).alias("_kind"), none.cast(ends.schema["_seg"].dataType).alias("_seg"), whole.alias("_p"))
    both = running(ends.unionByName(asked), ["_key"], ["_at", "_kind"], "_seg", "_hit", width=width).where("_kind = 0")
    time = F.col("_p")[t]
    found = F.when(F.col("_hit._s") <= time, F.col("_hit"))
    return both.select(*(F.col("_p")[n].alias(n) for n in names), found["_from"]["source_path"].alias("seg_path"), (time - found["_s"] + found["_from"]["source_start"]).alias("seg_offset"))


def with_members(spine: DataFrame, rows: DataFrame, key: str, members: list[str], order: list[str], name: str = "items") -> DataFrame:
    """The spine with each key's rows as an ordered array; empty where it has none."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[m for m in members if m not in order]))).alias(name))
    kind = packed.schema[name].dataType
    return spine.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def in_levels(rows: DataFrame, manifest: DataFrame | None, levels: list[int], key: str = "video_id") -> DataFrame:
    """Rows whose video has one of the levels; all rows without a manifest."""
    if manifest is None:
        return rows
    return rows.join(manifest.where(F.col("level").isin(levels)).select(key).distinct(), key, "left_semi")
