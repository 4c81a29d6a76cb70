"""Mixing sources to target weights by entropy balancing, as DataFrame expressions only.

A source's target is its weight's share of all words, stopped at `most` times its own words; what is
over is shared out again by weight until no target is above (the level of that filling is found from
running sums over the sources, one row each).

Rates: of all rates r between 0 and `most` whose words meet every source's target, those of least entropy
relative to taking each document once, sum of w * (r log r - r + 1). A document of n words weighs
w = n / log2(1 + n), so that what long documents lose grows with their words but for a logarithm. The solution tilts
each document exponentially, r = min(most, exp(multiplier * log2(1 + n))), one multiplier a source. The multipliers maximise the
concave dual: its gradient is the tilted word sum less the target, its second derivative the word sum
weighted by log2(1 + n). Each Newton step aggregates both over all documents (counted by source and size first, which is exact),
keeps within the bracket found so far and ends when every source's words are within TOLERANCE of its target; multipliers
are rounded to ten places then, so that the order of sums doesn't show.

Rounding: a document is taken floor(rate) times, and once more in order of hash / fraction (sequential
Poisson sampling), as far as the source's target needs it. The threshold is found from histograms of that order, words
summed per cell, in two levels; what is left is made up by the documents whose sizes are nearest to it, one after the other (a copy
more, or a copy fewer after too many), until it is below NEAR of the target or no document brings it closer. Documents are never sorted. Hashes are of ids, so reruns agree.

Null texts have size 0 and are never taken; a null source is a source, the last one. Repeated rows
are taken alike. If there are no words all targets are 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.llm.common import BROADCAST_ROWS, cut, lookup

#: Cells of each of the two histogram levels; Newton steps at most.
CELLS, NEWTON = 1024, 60
#: Relative gap at which Newton's method ends; gap that is left alone at the end; documents that make up for a gap, at most.
TOLERANCE, NEAR, FILL = 1e-9, 1e-3, 12
#: log2 of a common length, for the first guess of a multiplier.
START = 8.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target of every source; weights repeat over the sources in order of code point, null last."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    by = by.withColumn("weight", F.element_at(cycle, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    by = by.withColumn("level", level)
    final = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    goal = F.when(F.col("ratio") > F.col("level"), F.col("weight") * F.col("final")).otherwise(F.least("cap", F.col("weight") * F.coalesce("final", F.lit(float("inf")))))
    return by.withColumn("final", final).select("source", "source_size", goal.alias("target"))


def tilt(size: Column) -> Column:
    return F.log2(size + F.lit(1.0))


def rate(multiplier: Column, size: Column, most: float) -> Column:
    """A document's rate; a null multiplier stands for the limit, `most`. Rates next to a whole number are that number."""
    r = F.coalesce(F.least(F.lit(float(most)), F.exp(multiplier * tilt(size))), F.lit(float(most)))
    return F.when(F.abs(r - F.round(r)) < 1e-9, F.round(r)).otherwise(r)


def multipliers(sizes: DataFrame, by_source: DataFrame, most: float = 3.0, few: bool | None = None) -> DataFrame:
    """key, multiplier, gap (tilted words less the target) of every source (key, source_size, target) with words.

    sizes: key, size. Sources that need `most` times all their words have a null multiplier.
    """
    counted = cut(sizes.where("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    none = F.lit(None).cast("double")
    state = by_source.where("source_size > 0").select("key", "target", F.when(full, none).otherwise(F.log(F.col("target") / F.col("source_size")) / START).alias("multiplier"), none.alias("low"), none.alias("high"), none.alias("gap"), full.alias("done"))
    state = cut(state.coalesce(1) if few else state)
    for _ in range(NEWTON):
        now = lookup(counted, state.where("not done").select("key", "multiplier"), "key", small=few)
        r = F.least(F.lit(float(most)), F.exp(F.col("multiplier") * tilt(F.col("size"))))
        words = F.col("n") * F.col("size") * r
        sums = now.groupBy("key").agg(F.sum(words).alias("words"), F.sum(F.when(r < most, words * tilt(F.col("size"))).otherwise(0.0)).alias("slope"))
        told = lookup(state, sums, "key", "left", small=few)
        gap = F.col("words") - F.col("target")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        told = told.select("key", "target", "multiplier", "done", low.alias("low"), high.alias("high"), F.coalesce(gap, "gap").alias("gap"), "slope")
        newton = F.col("multiplier") - F.col("gap") / F.nullif("slope", F.lit(0.0))
        newton = F.greatest(F.col("multiplier") - 2, F.least(F.col("multiplier") + 2, newton))
        inside = (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf"))))
        then = F.when(inside, newton).otherwise((F.coalesce("low", F.col("high") - 2) + F.coalesce("high", F.col("low") + 2)) / 2)
        done = F.col("done") | (F.abs("gap") <= TOLERANCE * F.col("target"))
        state = cut(told.select("key", "target", F.when(done, F.round("multiplier", 10)).otherwise(then).alias("multiplier"), "low", "high", "gap", done.alias("done")))
        if not state.agg(F.bool_or(~F.col("done")).alias("more")).first().more:
            break
    return state.select("key", "multiplier", "gap")


def _crossing(cells: DataFrame, name: str) -> DataFrame:
    """The first cell of each source at which the running sum reaches the need, and what is still needed there."""
    run = cells.withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy(name)))
    return run.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """id, source, size, source_size, target, rate, copies and taken of every document."""
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sizes = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words.alias("size"))
    sizes = cut(sizes.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))))

    plan = cut(targets(sizes, weights, most).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source"))
    few = plan.count() <= BROADCAST_ROWS
    plan = cut(lookup(plan, multipliers(sizes, plan, most, few), "key", "left", small=few))
    goal = plan.select("key", "source_size", "target", "multiplier")
    dealt = lookup(sizes, goal, "key", small=few).withColumn("rate", F.when((F.col("size") > 0) & (F.col("target") > 0), rate(F.col("multiplier"), F.col("size"), most)).otherwise(0.0))
    # One more copy goes in order of hash / fraction: place is that order, mapped to 0 to 1.
    base, chance = F.floor("rate"), (F.pmod(F.xxhash64("id", "size"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    share = F.col("rate") - F.col("base")
    dealt = dealt.withColumn("base", base.cast("int")).withColumn("open", (share > 0) & (F.col("base") < most))
    cell = F.least(F.lit(CELLS * CELLS - 1), F.floor(chance / (chance + share) * CELLS * CELLS))
    dealt = cut(dealt.withColumns({"outer": F.floor(cell / CELLS).cast("int"), "inner": F.pmod(cell, F.lit(CELLS)).cast("int")}))

    sure = dealt.groupBy("key").agg(F.sum(F.col("base") * F.col("size")).alias("sure"))
    plan = lookup(goal, sure, "key", small=few).withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("sure")))
    plan = cut(plan.select("key", "target", "need"))
    first = dealt.where("open").groupBy("key", "outer").agg(F.sum("size").alias("words"))
    first = lookup(first, plan.select("key", "need"), "key", small=few)
    first = _crossing(first, "outer").select("key", F.col("outer").alias("at_outer"), (F.col("need") - (F.col("upto") - F.col("words"))).alias("need"))
    second = lookup(dealt.where("open"), cut(first), "key", small=few).where("outer = at_outer").groupBy("key", "inner", "at_outer", "need").agg(F.sum("size").alias("words"))
    second = _crossing(second, "inner").select("key", "at_outer", (F.col("inner") - 1).alias("at_inner"), (F.col("need") - (F.col("upto") - F.col("words"))).alias("left"))
    picked = f"array<struct<it:struct<outer:int,inner:int,size:bigint,id:{sizes.schema['id'].dataType.simpleString()}>,more:int>>"
    # Without a crossing (sums of doubles may fall short by a hair) all open documents are taken.
    plan = lookup(plan, second, "key", "left", small=few).select("key", "target", F.coalesce("at_outer", F.when(F.col("need") > 0, CELLS).otherwise(-1)).alias("at_outer"), F.coalesce("at_inner", F.lit(-1)).alias("at_inner"),
                                                   F.coalesce("left", F.lit(0.0)).alias("left"), F.array().cast(picked).alias("picks"))
    plan = cut(plan)

    # What is left at the threshold goes document by document, of the nearest size each: one copy more, or one fewer after too many.
    # Repeated rows count together.
    below = F.col("open") & ((F.col("outer") < F.col("at_outer")) | ((F.col("outer") == F.col("at_outer")) & (F.col("inner") <= F.col("at_inner"))))
    off_target = F.abs("left") > NEAR * F.col("target")
    short = plan.where(off_target).select("key", "at_outer", "at_inner", F.col("left").alias("most_left"))
    rest = lookup(dealt, short, "key", small=few).withColumn("copies", F.col("base") + below.cast("int")).where((F.col("size") > 0) & (F.col("size") < 2 * F.col("most_left")))
    rest = rest.groupBy("key", F.struct("outer", "inner", "size", "id").alias("it"), "copies").agg(F.sum("size").alias("words"))
    rest = cut(rest)
    for _ in range(FILL):
        now = plan.where(off_target).select("key", "left", "picks")
        near = lookup(rest, now, "key", small=few)
        fits = F.when(F.col("left") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        off = F.abs(F.col("words") - F.abs("left"))
        near = near.where(fits & (off < F.abs("left")) & ~F.exists("picks", lambda p: p["it"].eqNullSafe(F.col("it"))))
        best = near.groupBy("key").agg(F.min(F.struct(off.alias("off"), "it", "words")).alias("best"))
        best = cut(best.select("key", "best.it", "best.words"))
        if best.isEmpty():
            break
        told = lookup(plan, best, "key", "left", small=few)
        pick = F.struct("it", F.signum("left").cast("int").alias("more"))
        told = told.withColumn("picks", F.when(F.col("it").isNotNull(), F.concat("picks", F.array(pick))).otherwise(F.col("picks")))
        plan = cut(told.select("key", "target", "at_outer", "at_inner", (F.col("left") - F.signum("left") * F.coalesce("words", F.lit(0))).alias("left"), "picks"))

    out = lookup(dealt, plan.select("key", "at_outer", "at_inner", "picks"), "key", small=few)
    mine = F.filter("picks", lambda p: p["it"].eqNullSafe(F.struct("outer", "inner", "size", "id")))
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("base") + below.cast("int") + F.coalesce(F.get(mine, F.lit(0))["more"], F.lit(0))).otherwise(0)
    out = out.withColumn("copies", copies.cast("int"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
