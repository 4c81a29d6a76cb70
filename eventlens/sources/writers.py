"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of an event file.
EVENT_COLUMNS = ["video_id", "class_name", "start_time_sec", "end_time_sec", "score"]


def events_csv(events: DataFrame, path: str) -> None:
    """Fixed columns with a header, even if there are no rows."""
    out = events.withColumnsRenamed({"start": "start_time_sec", "end": "end_time_sec"}).select(*EVENT_COLUMNS)
    (out if not out.isEmpty() else out.coalesce(1)).write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def compact_json(df: DataFrame, path: str) -> None:
    """One compact JSON object a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def embeddings(df: DataFrame, path: str) -> None:
    """Vectors beside their metadata, in one table."""
    df.write.mode("overwrite").parquet(path)


def document(doc: DataFrame, path: str, warn: int = 5 * 1024 * 1024) -> bool:
    """Writes a one-row document as indented JSON; true if it is larger than the platform takes."""
    text = doc.select(F.to_json(F.struct(*doc.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    text.write.mode("overwrite").text(path)
    return bool(text.select((F.octet_length("value") > warn).alias("large")).first().large)


def document_lines(entries: DataFrame, head: DataFrame, path: str, key: str = "video_id", warn: int = 5 * 1024 * 1024) -> bool:
    """Writes a document with its list of predictions (entries, in order of a unique key) as part files, which in order of name are one JSON text; true if it is larger than the platform takes.

    head: one row, the document's other fields. The text has the head in its first line, then an entry a line and the closing brackets; entries are sorted in ranges
    and never gathered, so only the platform's own limit bounds a document.
    """
    json = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    none = F.lit(None).cast(entries.schema[key].dataType)
    first = entries.agg(F.min(key).alias("_first"))
    rows = entries.select(F.lit(1).alias("_part"), F.col(key).alias("_key"), json(entries).alias("_json")).crossJoin(F.broadcast(first))
    rows = rows.select("_part", "_key", F.concat(F.when(F.col("_key") == F.col("_first"), " ").otherwise(","), "_json").alias("value"))
    opening = F.concat(F.left(json(head), F.length(json(head)) - 1), F.lit(',"predictions":['))
    ends = head.select(F.lit(0).alias("_part"), none.alias("_key"), opening.alias("value")).unionByName(head.select(F.lit(2).alias("_part"), none.alias("_key"), F.lit("]}").alias("value")))
    rows.unionByName(ends).orderBy("_part", "_key").select("value").write.mode("overwrite").text(path)
    size = entries.sparkSession.read.text(path).agg(F.sum(F.octet_length("value") + 1).alias("n")).first().n
    return size > warn


def keyed_json(df: DataFrame, key: str, value: str, path: str) -> None:
    """One JSON object from key to value."""
    packed = df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("m"))
    packed.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


def timelines(tl: DataFrame, path: str) -> None:
    """Ground truth and videos as CSV and the manifest as JSON lines, from one evaluation."""
    from eventlens.operators.synth import manifest_tables

    tl = tl.cache()
    truth, videos, manifest = manifest_tables(tl)
    truth.write.mode("overwrite").option("header", True).csv(f"{path}/ground_truth.csv")
    videos.write.mode("overwrite").option("header", True).csv(f"{path}/videos.csv")
    manifest.write.mode("overwrite").text(f"{path}/manifest.jsonl")
    tl.unpersist()
