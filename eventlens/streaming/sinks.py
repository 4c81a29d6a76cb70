"""Streams into several tables, each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Writes a batch to a folder, replacing what is there (any of sources.writers).
Writer = Callable[[DataFrame, str], None]


def start(stream: DataFrame, out: str, checkpoint: str, tables: dict[str, Writer], output: str = "append") -> StreamingQuery:
    """Writes every batch of a stream to each table, as out/<table>/batch=<id>.

    A batch that is run again after a failure has the same rows and id, and writers replace their folder: whatever part of it was written before, no row is there twice.
    The batch is computed once for all tables. Runs what is there and stops.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            for name, write in tables.items():
                write(batch, f"{out}/{name}/batch={n}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(output).trigger(availableNow=True).start()


def batches(spark: SparkSession, out: str, table: str, inside: str = "") -> list[str]:
    """The folders of a table's complete batches, in order (inside: a part of what the writer makes); those whose writer was stopped aren't listed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{out}/{table}/batch=*{inside}/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    folders = [f.getPath().getParent().toString() for f in found]
    return sorted(folders, key=lambda f: int(f.rsplit("batch=", 1)[1].split("/", 1)[0]))
