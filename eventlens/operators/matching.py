"""Greedy one-to-one matching of predicted to true intervals by overlap, in order of score.

Only overlapping intervals can match, so a video and class is cut into islands of intervals that hang together in time: one sort by start and a running
maximum of ends. Each island of FOLD rows or fewer is packed and folded over its predictions, so the order that decides is explicit and
no row-at-a-time code runs. Events without times stand apart: what no island has matched meets them by rank.

Larger islands are matched in rounds of joins. A pair in which each side is the other's first choice (the greatest overlap for the prediction, the greatest score for the
true event) is part of the greedy matching whatever else there is; all such pairs are settled at once, and what is left falls into smaller islands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.intervals import iou, timed
from eventlens.operators.joins import similar_pairs
from eventlens.operators.lineage import cut
from eventlens.operators.scans import meet

KEYS = ["video_id", "class_name"]
#: Rows of an island that is folded at most; rows of a task that sorts and packs the events of a sweep, about.
FOLD, ROWS = 128, 250_000

_FOUND = "array<struct<pid:bigint,gid:bigint,iou:double,real:boolean>>"
_REST = "array<struct<neg:double,pid:bigint>>"
_ROW = [*KEYS, "is_p", "ord", "s", "e", "neg"]


def _rows(truth: DataFrame, preds: DataFrame) -> DataFrame:
    """Both sides in one: KEYS, is_p, ord, s, e, neg (the negated score)."""

    def side(df: DataFrame, is_p: bool, neg: Column) -> DataFrame:
        return df.select(*KEYS, F.lit(is_p).alias("is_p"), F.col("ord").cast("bigint").alias("ord"), F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"), neg.cast("double").alias("neg"))

    return side(preds, True, -F.col("score")).unionByName(side(truth, False, F.lit(None)))


def _tagged(rows: DataFrame, official: bool, whole: bool, sized: bool) -> DataFrame:
    """rows with island, spare (its group has true events without times) and, if sized, n, the rows of the island.

    Islands count from 1. Under the general rules untimed rows are in pieces of FOLD rows from -1 downwards; a group where an untimed prediction may take a timed
    event (or `whole`: any group) is the one island 0.
    """
    has = timed(F.col("s"), F.col("e"))
    group = Window.partitionBy(*KEYS)
    order = group.orderBy("_timed", "s", "e", "is_p", "ord")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = rows.withColumn("_timed", has)
    if official:
        t = t.where("_timed")
    hull = F.max(F.when(F.col("_timed"), F.greatest("s", "e"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_new", (F.col("_timed") & F.coalesce(F.col("s") >= hull, F.lit(True))).cast("int"))
    island = F.sum("_new").over(upto)
    if official:
        t = t.withColumns({"island": island, "spare": F.lit(False)})
    else:
        mixed = F.lit(True) if whole else F.bool_or(F.col("is_p") & ~F.col("_timed")).over(group) & F.bool_or(~F.col("is_p") & F.col("_timed")).over(group)
        piece = -1 - F.floor((F.row_number().over(order) - 1) / FOLD)
        t = t.withColumns({"_mixed": mixed, "spare": F.bool_or(~F.col("is_p") & ~F.col("_timed")).over(group), "_island": island, "_piece": piece})
        t = t.withColumn("island", F.when(F.col("_mixed"), 0).when(F.col("_timed"), F.col("_island")).otherwise(F.col("_piece")))
    if sized:
        t = t.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "island")))
    return t.select(*rows.columns, "island", "spare", *(["n"] if sized else []))


def _packed(tagged: DataFrame) -> DataFrame:
    """KEYS, island, spare, ps (predictions by falling score), gs (true events by ord): one row an island."""
    p = F.when(F.col("is_p"), F.struct("neg", F.col("ord").alias("pid"), "s", "e", *(["len"] if "len" in tagged.columns else [])))
    g = F.when(~F.col("is_p"), F.struct(F.col("ord").alias("gid"), "s", "e"))
    return tagged.groupBy(*KEYS, "island").agg(F.any_value("spare").alias("spare"), F.array_sort(F.collect_list(p)).alias("ps"), F.array_sort(F.collect_list(g)).alias("gs"))


def _folded(tau: float, official: bool) -> Column:
    """struct<found, rest>: the matches made between ps and gs, and the predictions without one."""
    first = 0.0 if official else -1.0
    none = F.lit(None).cast("bigint")

    def choose(one: Column, free: Column) -> Column:
        def better(best, cand):
            both = timed(one["s"], one["e"]) & timed(cand["s"], cand["e"])
            size = iou(one["s"], one["e"], cand["s"], cand["e"])
            good = both & (size >= tau) & (size > best["iou"])
            if not official:
                good = good | (~both & best["gid"].isNull())
            return F.when(good, F.struct(one["pid"].alias("pid"), cand["gid"].alias("gid"), size.alias("iou"), timed(cand["s"], cand["e"]).alias("real"))).otherwise(best)

        return F.aggregate(free, F.struct(one["pid"].alias("pid"), none.alias("gid"), F.lit(first).alias("iou"), F.lit(False).alias("real")), better)

    def step(acc, one):
        # The one best is an array, so that it is worked out once.
        def put(acc, best):
            hit = F.struct(F.filter(acc["free"], lambda x: x["gid"] != best["gid"]).alias("free"), F.concat(acc["found"], F.array(best)).alias("found"), acc["rest"].alias("rest"))
            miss = F.struct(acc["free"].alias("free"), acc["found"].alias("found"), F.concat(acc["rest"], F.array(F.struct(one["neg"].alias("neg"), one["pid"].alias("pid")))).alias("rest"))
            return F.when(best["gid"].isNotNull(), hit).otherwise(miss)

        return F.aggregate(F.array(choose(one, acc["free"])), acc, put)

    start = F.struct(F.col("gs").alias("free"), F.array().cast(_FOUND).alias("found"), F.array().cast(_REST).alias("rest"))
    folded = F.aggregate("ps", start, step, lambda acc: F.struct(acc["found"].alias("found"), acc["rest"].alias("rest")))
    # Nothing meets in a piece of untimed rows, nor where one side is missing.
    apart = F.struct(F.array().cast(_FOUND).alias("found"), F.transform("ps", lambda p: F.struct(p["neg"].alias("neg"), p["pid"].alias("pid"))).cast(_REST).alias("rest"))
    return F.when((F.col("island") >= 0) & (F.size("ps") > 0) & (F.size("gs") > 0), folded).otherwise(apart)


def _hot(rows: DataFrame, fold: int) -> bool:
    """Whether any video and class has more rows than an island may: counts only, added up before the shuffle."""
    return not rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fold).isEmpty()


def _settled(rows: DataFrame, tau: float) -> DataFrame:
    """KEYS, pid, gid, iou of timed rows of islands of any size.

    A round pairs what overlaps enough, settles all pairs that are each other's first choice and cuts what is left into islands again.
    Every round settles a pair of each island at least; small islands are folded as they come up.
    """
    out: list[DataFrame] = []
    while True:
        t = cut(_tagged(rows, True, False, True))
        small = _packed(t.where(F.col("n") <= FOLD)).select(*KEYS, F.explode(_folded(tau, True)["found"]).alias("m"))
        out.append(small.select(*KEYS, "m.pid", "m.gid", "m.iou"))
        rest = t.where(F.col("n") > FOLD)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, out)
        p = rest.where("is_p").select(*KEYS, F.col("ord").alias("pid"), "s", "e", "neg")
        g = rest.where("not is_p").select(*KEYS, F.col("ord").alias("gid"), F.col("s").alias("s2"), F.col("e").alias("e2"))
        pairs = cut(similar_pairs(p, g, KEYS, ("s", "e"), ("s2", "e2"), tau).select(*KEYS, "pid", "gid", "iou", "neg"))
        of_p = pairs.groupBy(*KEYS, "pid").agg(F.max(F.struct("iou", (-F.col("gid")).alias("n"))).alias("b")).select(*KEYS, "pid", (-F.col("b.n")).alias("gid"), "b.iou")
        of_g = pairs.groupBy(*KEYS, "gid").agg(F.min(F.struct("neg", "pid")).alias("b")).select(*KEYS, "gid", "b.pid")
        first = cut(of_p.join(of_g, [*KEYS, "pid", "gid"]))
        out.append(first.select(*KEYS, "pid", "gid", "iou"))
        left = pairs.join(first.select(*KEYS, "pid"), [*KEYS, "pid"], "left_anti").join(first.select(*KEYS, "gid"), [*KEYS, "gid"], "left_anti")
        alive = left.select(*KEYS, F.explode(F.array(F.struct(F.lit(True).alias("is_p"), F.col("pid").alias("ord")), F.struct(F.lit(False).alias("is_p"), F.col("gid").alias("ord")))).alias("x")).select(*KEYS, "x.*").distinct()
        rows = rest.select(*_ROW).join(alive, [*KEYS, "is_p", "ord"], "left_semi")


def _split(rows: DataFrame, official: bool, whole: bool, fold: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The tagged rows that are folded and, if there are any, those of larger islands (of more than `fold` rows, FOLD by default)."""
    fold = fold or FOLD
    if not _hot(rows, fold):
        return _tagged(rows, official, whole, False), None
    t = _tagged(rows, official, whole, True)
    large = (F.col("island") > 0) & (F.col("n") > fold)
    return t.where(~large).drop("n"), cut(t.where(large).drop("n"))


def match(truth: DataFrame, preds: DataFrame, tau: float, official: bool = False) -> DataFrame:
    """video_id, class_name, pred_ord, gt_ord, iou of the pairs.

    truth: video_id, class_name, ord, start, end; preds: the same and score. ord is unique within a video and class.
    General rules: the best remaining overlap of tau or more, the earlier of equals; where a side is untimed, the first remaining
    one with overlap 0, unless a timed one beats it. Official rules: timed pairs only. A group in which untimed predictions may
    take timed events is folded whole, as such a prediction takes the first event left wherever it is; so is any group if tau isn't positive.
    """
    rows = _rows(truth, preds)
    small, large = _split(rows, official, not official and tau <= 0)
    answer = _packed(small).select(*KEYS, "island", "spare", "gs", _folded(tau, official).alias("f"))
    big = None if large is None else _settled(large.select(*_ROW), max(tau, 1e-9))
    if official:
        found = answer.select(*KEYS, F.explode("f.found").alias("m")).select(*KEYS, "m.pid", "m.gid", "m.iou")
        found = found if big is None else found.unionByName(big)
        return found.select(*KEYS, F.col("pid").alias("pred_ord"), F.col("gid").alias("gt_ord"), "iou")
    # kind 0: pairs; 1: predictions left, in order of score; 2: untimed true events, by ord. Those of kinds 1 and 2 with one rank are pairs.
    none, zero = F.lit(None).cast("bigint"), F.lit(0.0)
    entry = lambda kind, neg, pid, gid, size: F.struct(F.lit(kind).alias("kind"), neg.alias("neg"), pid.alias("pid"), gid.alias("gid"), size.alias("iou"))
    pairs = F.transform("f.found", lambda m: entry(0, zero, m["pid"], m["gid"], m["iou"]))
    left = F.transform("f.rest", lambda p: entry(1, p["neg"], p["pid"], none, zero))
    untimed = F.transform("gs", lambda g: entry(2, zero, none, g["gid"], zero))
    nothing = F.filter(pairs, lambda _: F.lit(False))
    each = F.concat(pairs, F.when(F.col("spare") & (F.col("island") != 0), left).otherwise(nothing), F.when(F.col("island") < 0, untimed).otherwise(nothing))
    all_ = answer.select(*KEYS, F.explode(each).alias("x")).select(*KEYS, "x.*")
    if big is not None:
        big = cut(big)
        alone = large.where("is_p and spare").select(*KEYS, F.lit(1).alias("kind"), "neg", F.col("ord").alias("pid"), none.alias("gid"), zero.alias("iou")).join(big.select(*KEYS, "pid"), [*KEYS, "pid"], "left_anti")
        all_ = all_.unionByName(big.select(*KEYS, F.lit(0).alias("kind"), zero.alias("neg"), "pid", "gid", "iou")).unionByName(alone)
    rank = F.row_number().over(Window.partitionBy(*KEYS, "kind").orderBy("neg", "pid", "gid"))
    slot = F.when(F.col("kind") == 0, F.struct(F.lit(0).alias("k"), F.col("pid").alias("at"))).otherwise(F.struct(F.lit(1).alias("k"), rank.cast("bigint").alias("at")))
    met = all_.withColumn("slot", slot).groupBy(*KEYS, "slot").agg(F.max("pid").alias("pred_ord"), F.max("gid").alias("gt_ord"), F.max("iou").alias("iou"))
    return met.where("pred_ord is not null and gt_ord is not null").drop("slot")


def tallies(truth: DataFrame, preds: DataFrame, taus: list[float]) -> DataFrame:
    """video_id, class_name, tau, tp, fp, fn, timed (pairs with times), iou (their sum) under the general rules.

    Both sides are packed once; every threshold is a fold over the same islands, so thresholds cost no scan or shuffle of their own.
    """
    small, large = _split(_rows(truth, preds), False, min(taus) <= 0)

    def tally(tau: float) -> Column:
        f = _folded(tau, False)
        real = F.filter(f["found"], lambda m: m["real"])
        return F.struct(F.lit(float(tau)).alias("tau"), F.size(f["found"]).alias("tp"), F.size(real).alias("timed"), F.aggregate(real, F.lit(0.0), lambda a, m: a + m["iou"]).alias("iou"), F.when(F.col("island") != 0, F.size(f["rest"])).otherwise(0).alias("left"))

    counts = [F.size("ps").alias("n_p"), F.size("gs").alias("n_g"), F.when(F.col("island") < 0, F.size("gs")).otherwise(0).alias("untimed")]
    each = _packed(small).select(*KEYS, *counts, F.explode(F.array(*(tally(t) for t in taus))).alias("t")).select(*KEYS, "n_p", "n_g", "untimed", "t.*")
    if large is not None:
        n = large.groupBy(*KEYS).agg(F.count_if("is_p").alias("n_p"), F.count_if(~F.col("is_p")).alias("n_g"))
        for tau in taus:
            hits = _settled(large.select(*_ROW), tau).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("tp"), F.sum("iou").alias("iou"))
            more = n.join(hits, KEYS, "left").na.fill(0, ["tp"]).na.fill(0.0, ["iou"])
            each = each.unionByName(more.select(*KEYS, "n_p", "n_g", F.lit(0).alias("untimed"), F.lit(float(tau)).alias("tau"), "tp", F.col("tp").alias("timed"), "iou", (F.col("n_p") - F.col("tp")).alias("left")))
    total = each.groupBy(*KEYS, "tau").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("n_p", "n_g", "untimed", "tp", "timed", "left")), F.sum("iou").alias("iou"))
    tp = F.col("tp") + F.least("left", "untimed")
    return total.select(*KEYS, "tau", tp.alias("tp"), (F.col("n_p") - tp).alias("fp"), (F.col("n_g") - tp).alias("fn"), "timed", "iou")


def by_policy(truth: DataFrame, found: DataFrame, policies: DataFrame, tau: float, official: bool) -> DataFrame:
    """policy_id, video_id, class_name, n (its events), tp, iou of policies that have events there; general or official rules.

    found: KEYS, combo, start, end, score, len; all timed. policies: policy_id, combo, least: a policy's events are those of its combo that have a len of
    `least` or more. Equal scores go in order of time. The truth is packed once an island, and every policy is a fold over the events that are its own; islands too large to
    fold are matched policy by policy in rounds.
    """
    own = policies.select("policy_id", "combo", "least").collect()
    p = found.select(*KEYS, F.lit(True).alias("is_p"), F.col("combo").cast("bigint").alias("ord"), F.col("start").alias("s"), F.col("end").alias("e"), (-F.col("score")).alias("neg"), "len")
    g = truth.select(*KEYS, F.lit(False).alias("is_p"), F.col("ord").cast("bigint").alias("ord"), F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"))
    rows = p.unionByName(g, allowMissingColumns=True)
    # Sorted and packed rows take far more memory than their shuffled size tells.
    n = rows.count() // ROWS + 1
    rows = rows if n == 1 else rows.repartition(n, *KEYS)
    small, large = _split(rows, official, False, FOLD * max(1, len({r.combo for r in own})))
    asked = policies.groupBy("combo").agg(F.collect_list(F.struct("policy_id", F.col("least").cast("double").alias("least"))).alias("l"))
    asked = asked.agg(F.map_from_entries(F.collect_list(F.struct(F.col("combo").cast("bigint").alias("combo"), "l"))).alias("_q"))
    islands = _packed(small)
    untimed = islands.where("island < 0").groupBy(*KEYS).agg(F.sum(F.size("gs")).alias("untimed")).where("untimed > 0")
    # An island's events by combo, then by policy; the truth stays where it is.
    each = islands.select(*KEYS, "island", "gs", "ps", F.explode(F.array_distinct(F.transform("ps", lambda e: e["pid"]))).alias("combo"))
    each = each.select(*KEYS, "island", "gs", F.filter("ps", lambda e: e["pid"] == F.col("combo")).alias("ps"), "combo").crossJoin(F.broadcast(asked))
    each = each.select(*KEYS, "island", "gs", "ps", F.explode(F.element_at("_q", F.col("combo"))).alias("q"))
    each = each.select(*KEYS, "island", "gs", F.col("q.policy_id").alias("policy_id"), F.filter("ps", lambda e: e["len"] >= F.col("q.least")).alias("ps")).where(F.size("ps") > 0)
    each = each.select(*KEYS, "policy_id", F.size("ps").alias("n"), _folded(tau, official).alias("f"))
    each = each.select(*KEYS, "policy_id", "n", F.size("f.found").alias("tp"), F.aggregate("f.found", F.lit(0.0), lambda a, m: a + m["iou"]).alias("iou"), F.size("f.rest").alias("left"))
    if large is not None:
        mine = policies.select("policy_id", F.col("combo").cast("bigint").alias("ord"), "least")
        key = F.concat_ws("/", "policy_id", "video_id").alias("video_id")
        lp = large.where("is_p").join(F.broadcast(mine), "ord").where(F.col("len") >= F.col("least"))
        n = lp.groupBy("policy_id", *KEYS).agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("policy_id", *KEYS).orderBy("s", "e", "neg")
        lp = lp.withColumn("ord", F.row_number().over(order).cast("bigint")).select("policy_id", *_ROW)
        lg = large.where("not is_p").join(n.select("policy_id", *KEYS), KEYS).select("policy_id", *_ROW)
        both = lp.unionByName(lg).select(F.col("policy_id"), F.col("video_id").alias("v"), key, *_ROW[1:])
        names = cut(both.select("policy_id", "v", "video_id").distinct())
        hits = _settled(both.select(*_ROW), tau).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("tp"), F.sum("iou").alias("iou")).join(names, "video_id")
        hits = hits.select("policy_id", F.col("v").alias("video_id"), "class_name", "tp", "iou")
        more = n.join(hits, ["policy_id", *KEYS], "left").na.fill(0, ["tp"]).na.fill(0.0, ["iou"])
        each = each.unionByName(more.select(*KEYS, "policy_id", "n", "tp", "iou", (F.col("n") - F.col("tp")).alias("left")))
    total = each.groupBy("policy_id", *KEYS).agg(*(F.sum(c).alias(c) for c in ("n", "tp", "iou", "left")))
    if official:
        return total.drop("left")
    # Untimed true events go to what is left, one each.
    return meet(total, untimed, KEYS, "left").withColumn("tp", F.col("tp") + F.least("left", F.coalesce("untimed", F.lit(0)))).drop("left", "untimed")


def outcomes(truth: DataFrame, preds: DataFrame, pairs: DataFrame) -> DataFrame:
    """outcome (tp, fp, fn), video_id, class_name, pred_ord, gt_ord, iou of every event of both sides."""
    tp = pairs.select(F.lit("tp").alias("outcome"), *KEYS, "pred_ord", "gt_ord", "iou")
    p = preds.select(*KEYS, F.col("ord").cast("bigint").alias("pred_ord"))
    g = truth.select(*KEYS, F.col("ord").cast("bigint").alias("gt_ord"))
    none = F.lit(None)
    fp = p.join(pairs, [*KEYS, "pred_ord"], "left_anti").select(F.lit("fp").alias("outcome"), *KEYS, "pred_ord", none.cast("bigint").alias("gt_ord"), none.cast("double").alias("iou"))
    fn = g.join(pairs, [*KEYS, "gt_ord"], "left_anti").select(F.lit("fn").alias("outcome"), *KEYS, none.cast("bigint").alias("pred_ord"), "gt_ord", none.cast("double").alias("iou"))
    return tp.unionByName(fp).unionByName(fn)
