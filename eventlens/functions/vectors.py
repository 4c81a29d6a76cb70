"""Expressions over array<double> vectors and a prototype classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), size))


def mean_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, mean: the mean vector of each group; partial sums per dimension before the shuffle."""
    each = df.select(*keys, F.posexplode(vector).alias("dim", "x"))
    means = each.groupBy(*keys, "dim").agg(F.avg("x").alias("m"))
    pooled = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("d"))
    return pooled.select(*keys, F.transform("d", lambda x: x["m"]).alias("mean"))


def classify(df: DataFrame, prototypes: DataFrame, id_col: str, vector: str, scale: float = 10.0, bias: float = 0.0, normal: str = "normal", top: int = 3) -> DataFrame:
    """id, best, p_anomaly, score, top (classes by probability). prototypes: class_name, proto; one row a class.

    The prototypes are packed into one row, so each vector meets all of them in place, with no shuffle of vectors.
    """
    book = prototypes.select("class_name", unit(F.col("proto")).alias("proto"))
    book = book.agg(F.array_sort(F.collect_list(F.struct("class_name", "proto"))).alias("book"))
    logits = F.transform("book", lambda b: dot(F.col(vector), b["proto"]) * scale + bias)
    out = df.select(id_col, vector).crossJoin(F.broadcast(book)).withColumn("logits", logits)
    highest = F.array_max("logits")
    powers = F.transform("logits", lambda x: F.exp(x - highest))
    out = out.withColumn("powers", powers).withColumn("total", F.aggregate("powers", F.lit(0.0), lambda s, x: s + x))
    probs = F.zip_with("book", "powers", lambda b, x: F.struct((-x / F.col("total")).alias("np"), b["class_name"].alias("class_name")))
    out = out.withColumn("ranked", F.array_sort(probs))
    best = F.get("ranked", F.lit(0))
    p_normal = F.aggregate(F.filter("ranked", lambda r: r["class_name"] == normal), F.lit(0.0), lambda s, r: s - r["np"])
    return out.select(
        id_col,
        best["class_name"].alias("best"),
        (1 - p_normal).alias("p_anomaly"),
        F.when(best["class_name"] == normal, 0.0).otherwise(1 - p_normal).alias("score"),
        F.transform(F.slice("ranked", 1, top), lambda r: r["class_name"]).alias("top"),
    )


def novelty(df: DataFrame, keys: list[str], id_col: str, vector: str) -> DataFrame:
    """keys, id, novelty: cosine distance of each vector from the mean of its own group."""
    means = mean_pool(df, keys, vector)
    joined = df.join(means, keys)
    return joined.select(*keys, id_col, (1 - F.try_divide(dot(F.col(vector), F.col("mean")), norm(F.col(vector)) * norm(F.col("mean")))).alias("novelty"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc by rank sum with mid-ranks; counts per distinct score are summed first, and running sums are taken within ranges of scores."""
    counts = df.groupBy(F.col(score).alias("_x")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    ranged = counts.repartitionByRange("_x").withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("_here", F.coalesce(F.sum("n").over(within), F.lit(0)))
    # One row a range; a range's total is what lies below the later ones.
    sums = ranked.groupBy("_part").agg(F.sum(F.col("p") * (F.col("_here") + F.col("n") / 2)).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("_below", earlier).agg(F.try_divide(F.sum(F.col("won") + F.col("p") * F.col("_below")), F.sum("p") * F.sum("n")).alias("auc"))
