"""Domain tables from the driver's star-schema tables, in hours instead of seconds where they come from events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Value from which on a detection is sure.
SURE = 50.0


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that executors share; a temporary one only in a local session without it (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _hours():
    base = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return (F.unix_micros(F.col("ts").cast("timestamp")) - base) / 3600000000.0


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.when(F.col("event_type") == "view", "normal").otherwise(F.col("event_type"))
    score = F.when(F.col("event_type") == "view", 0.0).otherwise(F.least(F.lit(1.0), F.col("value") / 100))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("seq"), _hours().alias("start"), cls.alias("class_name"), score.alias("score"), "ts")
    return e.select("video_id", "seq", "start", (F.col("start") + 4).alias("end"), "class_name", "score", "ts")


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or((F.col("value") >= SURE) & (F.col("event_type") != "view")).alias("has_anomaly"))
    return ids.select(F.col("user_id").alias("video_id"), (F.col("user_id") % 3 + 1).cast("int").alias("level"), "has_anomaly")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a sure value are the truth."""
    e = table(spark, sf_dir, "events").where((F.col("value") >= SURE) & (F.col("event_type") != "view")).withColumn("h", _hours())
    timed = F.col("user_id") % 3 != 0
    return e.select(
        F.col("user_id").alias("video_id"), F.col("event_type").alias("class_name"), F.col("event_id").alias("ord"),
        F.when(timed, F.col("h") - 1).alias("start"), F.when(timed, F.col("h") + 3 + F.col("event_id") % 5).alias("end"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections are predictions."""
    e = table(spark, sf_dir, "events").where("event_type <> 'view'").withColumn("h", _hours())
    return e.select(
        F.col("user_id").alias("video_id"), F.col("event_type").alias("class_name"), F.col("event_id").alias("ord"),
        (F.col("h") - 0.5 + F.col("event_id") % 3).alias("start"), (F.col("h") + 2.5 + F.col("event_id") % 4).alias("end"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as clips: p_size seconds, a dwell class for some, an event interval for most."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    cls = F.when(k % 5 == 0, "fighting_or_violence").when(k % 5 == 1, "fire").when(k % 5 == 2, "smoke").when(k % 5 == 3, "wrong_way_driving").otherwise("normal")
    s = F.when((k % 5 != 4) & (k % 11 != 0), (F.col("p_size") * (k % 4) / 8.0))
    e = F.when((k % 5 != 4) & (k % 11 != 0), F.when(k % 13 == 0, F.col("p_size") * (k % 4) / 8.0).otherwise(F.col("p_size") * (k % 4 + 4) / 8.0))
    return p.select(k.alias("video_id"), cls.alias("class_name"), s.alias("start"), e.alias("end"), F.col("p_size").cast("double").alias("duration"), F.col("p_name").alias("path"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.when(F.col("label") == 0, "normal").otherwise(F.concat(F.lit("c"), F.col("label"))).alias("class_name"))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels: quality and toxicity as the class; labelled clean ones of good quality are normal."""
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    cls = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "normal").otherwise(F.concat_ws("/", F.coalesce(F.col("quality").cast("string"), F.lit("?")), F.coalesce(F.col("toxic").cast("string"), F.lit("?")), "lang"))
    return j.select("doc_id", "source", cls.alias("class_name"))


#: Seconds that arrivals may come late; steps they come in.
LATE, STEPS = 6 * 3600, 3


def arrivals(df: DataFrame, name: str, end: dict | None = None) -> DataFrame:
    """df (with a timestamp `at`) as a stream whose rows come out of order by up to LATE seconds, a step a batch.

    df is worked out once, into a scratch folder, from which the rows are written step by step. end: a row with these values (null where it has none) and a time far on
    follows, which moves the watermark past all others; keys of it shouldn't be null, as joins pass over those before the watermark sees them.
    """
    spark, out = df.sparkSession, scratch(df.sparkSession, name)
    seconds = F.col("at").cast("double")
    late = df.withColumn("_come", seconds + F.pmod(F.xxhash64(*df.columns), F.lit(LATE)))
    late.write.parquet(f"{out}/all")
    late = spark.read.schema(late.schema).parquet(f"{out}/all")
    span = late.agg(F.min("_come").alias("a"), F.max("_come").alias("b")).first()
    step = F.least(F.floor((F.col("_come") - (span.a or 0.0)) / (((span.b or 0.0) - (span.a or 0.0)) / STEPS + 1e-6)), F.lit(STEPS - 1))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(STEPS):
        late.where(step == k).drop("_come").repartition(n).write.parquet(f"{out}/step={k}")
    if end is not None:
        last = late.agg(F.max("at").alias("m")).select(*((F.col("m") + F.expr("INTERVAL 30 DAYS")).alias(c) if c == "at" else F.lit(end.get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns))
        last.write.parquet(f"{out}/step={STEPS}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(f"{out}/step=*")


#: The same tables for DuckDB.
SQL = {
    "verdicts": """verdicts AS (SELECT user_id AS video_id, event_id AS seq, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 AS "start",
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 + 4 AS "end", CASE event_type WHEN 'view' THEN 'normal' ELSE event_type END AS class_name,
  CASE event_type WHEN 'view' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, value / 100) END AS score FROM events)""",
    "meta": """meta AS (SELECT user_id AS video_id, (user_id % 3 + 1)::INT AS level, bool_or(value >= 50 AND event_type <> 'view') AS has_anomaly FROM events GROUP BY user_id)""",
    "truth": """truth AS (SELECT user_id AS video_id, event_type AS class_name, event_id AS ord,
  CASE WHEN user_id % 3 <> 0 THEN h - 1 END AS "start", CASE WHEN user_id % 3 <> 0 THEN h + 3 + event_id % 5 END AS "end"
  FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 AS h FROM events) WHERE value >= 50 AND event_type <> 'view')""",
    "preds": """preds AS (SELECT user_id AS video_id, event_type AS class_name, event_id AS ord, h - 0.5 + event_id % 3 AS "start", h + 2.5 + event_id % 4 AS "end",
  least(1.0::DOUBLE, value / 100) AS score
  FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 AS h FROM events) WHERE event_type <> 'view')""",
    "clips": """clips AS (SELECT p_partkey AS video_id,
  CASE p_partkey % 5 WHEN 0 THEN 'fighting_or_violence' WHEN 1 THEN 'fire' WHEN 2 THEN 'smoke' WHEN 3 THEN 'wrong_way_driving' ELSE 'normal' END AS class_name,
  CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 11 <> 0 THEN p_size * (p_partkey % 4) / 8.0::DOUBLE END AS "start",
  CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 13 = 0 THEN p_size * (p_partkey % 4) / 8.0::DOUBLE ELSE p_size * (p_partkey % 4 + 4) / 8.0::DOUBLE END END AS "end",
  p_size::DOUBLE AS duration, p_name AS path FROM part)""",
    "emb": """emb AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN label = 0 THEN 'normal' ELSE 'c' || label END AS class_name FROM embeddings)""",
    "strata": """strata AS (SELECT doc_id, source, CASE WHEN quality = 1 AND toxic = 0 THEN 'normal' ELSE coalesce(quality::VARCHAR, '?') || '/' || coalesce(toxic::VARCHAR, '?') || '/' || lang END AS class_name
  FROM documents LEFT JOIN labels USING (doc_id))""",
}
