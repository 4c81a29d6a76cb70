"""Small helpers the corpus operators share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a look-up table that are broadcast; keys that hold more than this part of the rows are looked up apart.
BROADCAST_ROWS, HEAVY = 20_000, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Without one a local session (tests) gets a temporary folder; a cluster is an error."""
    named, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Hands this package's modules to the Python workers, once a session: they may start without it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_eventlens_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="eventlens-")) / "eventlens.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((top / "eventlens").rglob("*.py")):
            z.write(f, f.relative_to(top))
    sc.addPyFile(str(target))
    sc._eventlens_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Evaluates df once into the shared checkpoint folder and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def buckets(spark: SparkSession) -> int:
    """Hash buckets for packed shuffles: a power of two of at least twice the shuffle partitions."""
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(5, (n - 1).bit_length())


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n: the fold of a row. A null key is in no fold (null)."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % n


def lookup(rows: DataFrame, book: DataFrame, key: str | list[str], how: str = "inner", small: bool | None = None) -> DataFrame:
    """rows joined (inner or left) with book, which has one row a key; keys aren't null. small: whether it is known to be, else it is counted.

    A small book is broadcast. Otherwise the join shuffles on the key, but for keys that each hold more than a thousandth of the
    rows, of which there can't be more than a thousand: those are broadcast, so that no task gets a hot key's rows.
    """
    if book.count() <= BROADCAST_ROWS if small is None else small:
        return rows.join(F.broadcast(book), key, how)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    heavy = counts.where(F.col("_n") * HEAVY > rows.count()).select(key)
    hot = F.broadcast(cut(book.join(F.broadcast(heavy), key)))
    cold = rows.join(hot.select(key), key, "left_anti").join(book, key, how)
    return cold.unionByName(rows.join(hot, key))
