"""Helpers shared by the operators: the shared folder, written intermediates, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of intermediates, for ``forget``.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests, a laptop) is a temporary folder set where the session names none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is created there yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor never forces the upstream work again.
    """
    path = fresh_dir(df.sparkSession, label)
    WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete the intermediates of all results so far; call it once these are written elsewhere."""
    while WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc32_mod(col: str, n: int):
    """crc32 of the id's decimal text modulo n; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n, F.lit(0))
