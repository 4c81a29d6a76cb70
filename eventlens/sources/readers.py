"""File sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens import schema as S
from eventlens.operators.joins import enrich


def csv(spark: SparkSession, path: str | list[str], kind: T.StructType, optional: T.StructType | None = None) -> DataFrame:
    """A CSV with a header, by column name; required columns must be there (ValueError), optional ones are null where they aren't.

    The header is read on its own, so types are never inferred from the data.
    """
    head = spark.read.option("header", True).csv(path).columns
    lost = [f.name for f in kind if f.name not in head]
    if lost:
        raise ValueError(f"{path}: columns missing: {lost}")
    known = {f.name: f.dataType for f in [*kind, *(optional or [])]}
    read = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in head])
    df = spark.read.schema(read).option("header", True).option("nullValue", "").csv(path)
    return df.select(*(F.col(n) if n in head else F.lit(None).cast(t).alias(n) for n, t in known.items()))


def split(spark: SparkSession, root: str, name: str = "test") -> DataFrame:
    """Events of one split: ground_truth.csv with each video's path from videos.csv (every video must be known)."""
    rows = csv(spark, f"{root}/{name}/ground_truth.csv", S.GROUND_TRUTH, T.StructType([T.StructField("level", T.IntegerType())]))
    videos = csv(spark, f"{root}/{name}/videos.csv", S.VIDEOS)
    return enrich(rows, videos, "video_id").withColumn("video_path", F.concat_ws("/", F.lit(f"{root}/{name}"), "filename")).drop("filename")


def train(spark: SparkSession, root: str) -> DataFrame:
    """Events of all known class folders under root/train, with the folder as class_dir; other folders are passed over.

    The folders come from a glob that Spark's file index resolves; a root without one fails as unresolved path.
    """
    level = T.StructType([T.StructField("level", T.IntegerType())])
    known = "{" + ",".join(S.CLASSES) + "}"

    def read(file: str, kind: T.StructType, more: T.StructType | None = None) -> DataFrame:
        path = f"{root}/train/{known}/{file}"
        head = spark.read.option("header", True).csv(path).columns
        lost = [f.name for f in kind if f.name not in head]
        if lost:
            raise ValueError(f"{path}: columns missing: {lost}")
        names = {f.name: f.dataType for f in [*kind, *(more or [])]}
        raw = spark.read.schema(T.StructType([T.StructField(n, names.get(n, T.StringType())) for n in head])).option("header", True).option("nullValue", "").csv(path)
        cls = F.regexp_extract(F.col("_metadata.file_path"), r"/train/([^/]+)/(?:ground_truth|videos)\.csv", 1).alias("class_dir")
        return raw.select(*(F.col(n) if n in head else F.lit(None).cast(t).alias(n) for n, t in names.items()), cls)

    rows, videos = read("ground_truth.csv", S.GROUND_TRUTH, level), read("videos.csv", S.VIDEOS)
    key = F.concat_ws("/", "class_dir", "video_id")
    joined = enrich(rows.withColumn("_id", key), videos.select(key.alias("_id"), "filename"), "_id").drop("_id")
    return joined.withColumn("video_path", F.concat_ws("/", F.lit(f"{root}/train"), "class_dir", "filename")).drop("filename")


def truth(rows: DataFrame) -> DataFrame:
    """Anomalous rows other than normal: video_id, class_name, start, end, level."""
    return rows.where(F.col("is_anomaly") & (F.col("class_name") != S.NORMAL)).select("video_id", "class_name", F.col("start_time_sec").alias("start"), F.col("end_time_sec").alias("end"), "level")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predicted events of a CSV or JSON-lines file (by suffix); times, score and is_anomaly may be missing, the file may be empty."""
    if path.rstrip("/").endswith((".jsonl", ".json")):
        df = spark.read.schema(S.PREDICTION).json(path)
    else:
        need = T.StructType(S.PREDICTION.fields[:2])
        df = csv(spark, path, need, T.StructType(S.PREDICTION.fields[2:])) if spark.read.option("header", True).csv(path).columns else spark.createDataFrame([], S.PREDICTION)
    keep = F.coalesce("is_anomaly", F.lit(True)) & (F.col("class_name") != S.NORMAL)
    return df.where(keep).select("video_id", "class_name", F.col("start_time_sec").alias("start"), F.col("end_time_sec").alias("end"), F.coalesce("score", F.lit(1.0)).alias("score"))


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Window verdicts of JSON lines; missing timings count 0. seq orders rows by file, then by position, however files are dealt to tasks."""
    df = spark.read.schema(S.VERDICT).json(path)
    # Within a piece of a file the running number grows with the position; pieces are told apart by file and offset.
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("row"))
    return df.select(
        "video_id", seq.alias("seq"), F.col("start_time_sec").alias("start"), F.col("end_time_sec").alias("end"), "class_name", "score",
        F.coalesce("window_ms", F.lit(0.0)).alias("window_ms"), F.coalesce("n_frames", F.lit(0)).alias("n_frames"),
    )


def export_index(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.schema(S.EXPORT_INDEX).json(path)
    return df.orderBy("id").limit(limit) if limit else df


def span_map(spark: SparkSession, path: str) -> DataFrame:
    """video_id, span_no, start, end of a JSON object of lists of pairs (a file is one object)."""
    text = spark.read.text(path, wholetext=True)
    m = text.select(F.from_json("value", "map<string,array<array<double>>>").alias("m"))
    each = m.select(F.explode("m").alias("video_id", "l")).select("video_id", F.posexplode("l").alias("span_no", "p"))
    return each.select("video_id", "span_no", F.get("p", F.lit(0)).alias("start"), F.get("p", F.lit(1)).alias("end"))


def level_manifest(spark: SparkSession, path: str) -> DataFrame:
    kind = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("level", T.IntegerType())])
    return csv(spark, path, kind).where("level is not null")


def timelines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.TIMELINE).json(path)


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """video_id, events, runtime_metadata of a whole-file result document."""
    df = spark.read.schema(S.SUBMISSION).option("multiLine", True).json(path)
    return df.select(F.explode("predictions").alias("p")).select("p.*")


def submission_lines(spark: SparkSession, path: str) -> DataFrame:
    """As submissions, of a document that writers.document_lines wrote: its lines are read apart, as a part of the text may be."""
    lines = spark.read.text(path).where(F.substring("value", 1, 2).isin(" {", ",{"))
    kind = S.SUBMISSION["predictions"].dataType.elementType
    return lines.select(F.from_json(F.expr("substring(value, 2)"), kind).alias("p")).select("p.*")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """dir, frame_no, path, content of f<N>.jpg files; order by frame_no, not by name."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "f*.jpg").option("recursiveFileLookup", True).load(path)
    return df.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", r"f(\d+)\.jpg$", 1).cast("int").alias("frame_no"), "path", "content")


def duration(n_frames: str = "n_frames", fps: str = "fps"):
    """Seconds of a clip; 0 where the frame rate is 0 or unknown."""
    return F.coalesce(F.try_divide(F.col(n_frames).cast("double"), F.col(fps)), F.lit(0.0))


def newest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row: the path with the largest numeric suffix."""
    step = F.regexp_extract(path, r"(\d+)/?$", 1)
    return paths.where(step != "").agg(F.max_by(path, step.cast("bigint")).alias("path"))
