"""A corpus pipeline of five stages, each a call of one corpus operator.

quality rules -> SimHash near-dedup -> secret scan -> mixing to target weights -> byte-level BPE.
All stages but the last return the columns of documents; each is written and read again before the next.

Stages decide by row, not by doc_id, which may be null or repeated: a row's key is a digest of all its columns. Rows of one key
are equal, so a stage's verdict on one holds for all, and the key is the same whenever the input is read.

What stages do in odd cases (all are tested):

* null or repeated doc_id: rows are judged, deduplicated, redacted and mixed by themselves; near-dedup keeps the row of the smallest
  doc_id (nulls last) and, among equal ids, the smallest key.
* null and empty texts, texts of under 50 words: rejected by the quality rules; in later stages, run alone, they are near-duplicates
  of each other (no words at all), have no secrets, are never taken by the mix and have no tokens.
* very long texts are read whole by every stage.
* rows equal in every column: near-dedup keeps one; the other stages treat them alike.
* an empty table gives an empty table with the same columns.
* other columns, whatever their names, stay as they are in all stages but the last; names that start with _pipeline are reserved.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import bpe, mixing, quality, secrets, simhash
from eventlens.llm.common import shared_dir
from eventlens.llm.vectors import quoted

#: Estimates, fingerprints, mixing and BPE have no SQL form; tests/llm compares every stage with a plain-Python one.
ORACLE_SQL = None


KEY = "_pipeline_key"


def columns(docs: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [quoted(c) for c in docs.columns]


def read(rows: DataFrame) -> DataFrame:
    """What the operators read of keyed rows."""
    return rows.select(KEY, "doc_id", "text", "lang", "source")


def keyed(docs: DataFrame) -> DataFrame:
    """Adds each row's key: SHA-256 over the digests of its columns, nulls apart."""
    each = [F.coalesce(F.sha2(F.encode(c.cast("string"), "UTF-8"), 256), F.lit("-")) for c in columns(docs)]
    return docs.withColumn(KEY, F.sha2(F.encode(F.concat_ws(",", *each), "UTF-8"), 256))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail the base rule and the outliers of their language and source."""
    rows = keyed(docs)
    kept = quality.judge(read(rows), KEY).where("kept").select(KEY).distinct()
    return rows.join(kept, KEY, "left_semi").select(*columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) one row stays: of the smallest doc_id (nulls last), then key."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", KEY)
    rows = keyed(docs)
    first = simhash.first_rows(rows.select(order.alias("place"), "text"), "place").select(F.col("place")[KEY].alias(KEY))
    return rows.join(first, KEY, "left_semi").dropDuplicates([KEY]).select(*columns(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are replaced in the text; n_chars follows."""
    rows = keyed(docs)
    found = secrets.find(read(rows), KEY).where(F.size("all") > 0).select(KEY, F.col("all").alias("_pipeline_found")).dropDuplicates([KEY])
    told = rows.join(found, KEY, "left")
    text = F.when(F.col("_pipeline_found").isNotNull(), secrets.redact(F.col("text"), F.col("_pipeline_found"))).otherwise(F.col("text"))
    return told.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the mix says; those taken zero times go."""
    rows = keyed(docs)
    taken = mixing.mix(read(rows), KEY).where("copies > 0").select(KEY, F.col("copies").alias("_pipeline_copies")).dropDuplicates([KEY])
    each = rows.join(taken, KEY)
    return each.withColumn("_pipeline_copy", F.explode(F.sequence(F.lit(1), F.col("_pipeline_copies")))).select(*columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every whole text as token ids."""
    import public_tokenizers

    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("bpe encoding", tokens),
]


def _files(spark: SparkSession, path: str):
    """The file system of a folder and the folder, for questions that Spark has no function for."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def made_from(docs: DataFrame) -> str:
    """A digest of the files behind the documents (name, size, time of change) and of the stages' names."""
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    told = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((tuple(map(str, told)), docs.schema.json(), [name for name, _ in STAGES])).encode()).hexdigest()


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows over the documents of sf_dir.

    Each stage is written to the shared folder and read again. With a folder of one's own, stages that are complete there and were made
    from the same files aren't run again, so an interrupted run goes on where it stopped, and all stay; otherwise only the last stage's
    rows stay. Which code made a stage isn't noted: take a new folder after a change of code.
    """
    at = folder or f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = made_from(docs) if folder else None

    def complete(k: int) -> bool:
        """Whether the stage and the note of its input, which is written after it, are whole and the input is this one."""
        for path in (f"{at}/{k}/_SUCCESS", f"{at}/{k}.made/_SUCCESS"):
            files, done = _files(spark, path)
            if not files.exists(done):
                return False
        return spark.read.text(f"{at}/{k}.made").first()[0] == made

    def delete(path: str) -> None:
        files, old = _files(spark, path)
        files.delete(old, True)

    going_on = folder is not None
    for k, (_, stage) in enumerate(STAGES):
        going_on = going_on and complete(k)
        if not going_on:
            if folder:
                delete(f"{at}/{k}.made")
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{at}/{k}")
            if folder:
                spark.createDataFrame([(made,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/{k}.made")
        docs = spark.read.parquet(f"{at}/{k}")
    if folder is None:
        for k in range(len(STAGES) - 1):
            delete(f"{at}/{k}")
    return docs
